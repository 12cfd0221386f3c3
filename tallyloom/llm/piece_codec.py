"""SentencePiece BPE encoding by backtracking, and decoding.

Encoding of a text piece by piece: an Aho-Corasick pass over a segment finds every vocabulary piece that starts at each
position; from the left, the longest piece is tried whose pair with the token before it is compatible, that is, whose
concatenation, merged anew by the model's own rules, gives just these two tokens again. If none fits, the last token is
taken back and its next shorter prefix tried; a bitfield of the positions from which no way led to the end stops a
position from being tried twice. A sequence of tokens whose neighbours are all compatible is the sequence that merging
yields: the first merge across a boundary would have to happen in the pair alone, too.

Texts are cut before each space mark that follows another character. This is exact for a vocabulary in which no piece
has the space mark after another character, which is checked; else a text is one segment. Short segments are cached.
Merging order: highest score, then leftmost. Characters that the vocabulary lacks become bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, documents, shared, ship_package, slices, worker_state

SPACE = "▁"


def read_model(path: str) -> dict:
    """Pieces, scores and kinds of a BPE model with identity normalisation and a dummy prefix; others are refused."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "piece" for i in range(len(sp))]
    probe = " Ａ́  b\tﬁ "
    if sp.decode(sp.encode(probe)) != probe or not sp.encode("a", out_type=str)[0].startswith(SPACE):
        raise ValueError("only models with identity normalisation and a dummy prefix are supported")
    if kinds.count("byte") != 256:
        raise ValueError("only models with byte fallback are supported")
    return {"pieces": [sp.id_to_piece(i) for i in range(len(sp))], "scores": [sp.get_score(i) for i in range(len(sp))], "kinds": kinds, "key": hashlib.sha256(open(path, "rb").read()).hexdigest()}


class PieceCodec:
    """Encodes and decodes with a model read by read_model. ids fit in 32 bits."""

    def __init__(self, model: dict):
        self.ids = {p: i for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"], strict=True)) if k in ("piece", "unused")}
        self.score = {p: model["scores"][i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"], strict=True)) if k == "byte"}
        self.machine = ahocorasick.Automaton()
        for p in self.ids:
            self.machine.add_word(p, len(p))
        self.machine.make_automaton()
        values = {i: bytes([b]) for b, i in self.bytes.items()}
        self.text = [values.get(i, b"" if k == "control" else b" \xe2\x81\x87 " if k == "unknown" else p.replace(SPACE, " ").encode()) for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"], strict=True))]
        self.is_byte = np.array([k == "byte" for k in model["kinds"]])
        self.number = [str(i) for i in range(len(model["pieces"]))]
        self.separable = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.pairs = Memo(lambda ab: self.merged(ab[0] + ab[1]) == list(ab), 200_000)
        self.segments = Memo(self._segment, 1_000_000, longest=32)  # about 200 MB when full; longer segments aren't kept

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored pair of neighbours, leftmost first, until no pair forms a piece."""
        parts: list[str | None] = list(text)
        right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                whole = parts[i] + parts[j]
                if whole in self.score:
                    heapq.heappush(heap, (-self.score[whole], i, j, whole))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def tokens(self, text: str) -> list[str]:
        """The pieces (or single unknown characters) of a segment, by backtracking."""
        n = len(text)
        lengths: list[list[int]] = [[] for _ in range(n)]
        for end, size in self.machine.iter(text):
            lengths[end - size + 1].append(size)
        for own in lengths:  # found in order of their ends, so of their lengths; single characters always match
            if not own or own[0] != 1:
                own.insert(0, 1)
        failed = bytearray((n >> 3) + 1)  # the bitfield: positions from which no way led to the end
        out: list[str] = []
        at, choice = 0, len(lengths[0]) - 1 if n else -1
        chosen: list[int] = []
        while at < n:
            while choice >= 0:
                size = lengths[at][choice]
                token = text[at : at + size]
                if not failed[(at + size) >> 3] >> ((at + size) & 7) & 1 and (not out or self.pairs[out[-1], token]):
                    break
                choice -= 1
            if choice >= 0:
                out.append(token)
                chosen.append(choice)
                at += size
                choice = len(lengths[at]) - 1 if at < n else -1
            else:
                if not out:
                    raise AssertionError("no compatible sequence")  # merging always has one
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())
                choice = chosen.pop() - 1
        return out

    def _segment(self, text: str) -> bytes:
        ids: list[int] = []
        for t in self.tokens(text):
            i = self.ids.get(t)
            ids += [i] if i is not None else [self.bytes[b] for b in t.encode("utf-8", "replace")]
        return np.array(ids, np.int32).tobytes()

    def cut(self, text: str) -> list[str]:
        """The segments of a text, marks in place; none for an empty text."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if not self.separable:
            return [text]
        # A cut before each mark that follows another character; marks in a row stay with what follows them.
        found = text.split(SPACE)
        if "" not in found[1:]:
            return [SPACE + w for w in found[1:]]
        out, marks = [], 0
        for w in found[1:]:
            marks += 1
            if w:
                out.append(SPACE * marks + w)
                marks = 0
        return out + [SPACE * marks] if marks else out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.segments.__getitem__, self.cut(text or ""))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks become spaces, one leading space goes, bytes join to characters, invalid ones become U+FFFD."""
        if len(ids) and ids.dtype != object and (ids.min() < 0 or ids.max() >= len(self.text)):
            raise IndexError("id outside the vocabulary")
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        if raw[:1] == b" " and not self.is_byte[ids[0]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(self._lossy(raw))

    @staticmethod
    def _lossy(raw: bytes):
        at = 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    yield raw[at : at + size].decode()
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                yield "�"
                at += 1


def _codec(broadcast) -> PieceCodec:
    model = broadcast.value
    return worker_state(("pieces", model["key"]), lambda: PieceCodec(model))


def _round_trip(broadcast, keep: bool):
    def run(batches):
        codec = _codec(broadcast)
        for batch in slices(batches):
            ids, n, id_digest, text_digest, texts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = codec.encode(text)
                decoded = codec.decode(found)
                n.append(len(found))
                id_digest.append(hashlib.sha256(",".join(map(codec.number.__getitem__, found.tolist())).encode()).hexdigest())
                text_digest.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if keep:
                    ids.append(found)
                    texts.append(decoded)
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(id_digest, pa.string()), pa.array(text_digest, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                out += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def encode_and_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, outputs: bool = True) -> DataFrame:
    """One row per row of df: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with `outputs`, ids and decoded.

    A null or empty text has no ids and decodes to an empty text. No begin or end ids. Lone surrogates can't occur in
    Spark's strings. Special pieces' names in a text are ordinary characters. The vocabulary (bounded by the model) is
    broadcast.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = documents(df, id_col, text_col)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * outputs
    return docs.mapInArrow(_round_trip(shared(spark, read_model(model_path)), outputs), schema)


__all__ = ["PieceCodec", "encode_and_decode", "read_model"]
