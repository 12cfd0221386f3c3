"""Token ids in a binary format of canonical length-limited Huffman codes.

A written set of ids is a Parquet table of blocks, so it lives in any store that Spark writes to. Block rows hold whole
documents in ascending id order: (shard, block, n_ids, offset, doc_ids, lengths, checkpoints, payload); one row with
shard -1 holds the code lengths. Files are in the order of the ids, too: a shard is the range of ids of one part file, whose
number ascends with it; `offset` counts the ids of earlier blocks of the shard.

payload: big-endian bit string; each document begins at a byte. checkpoints: unsigned 32-bit bit offsets, for each
document those of its ids 0, interval, 2*interval, ...; decoding runs all stretches between checkpoints at once, one
table lookup (the next `limit` bits give symbol and length) for each id. Blocks are decoded independently.

Codes: lengths by package-merge over the global counts, at most `limit` bits (16, or more if the vocabulary needs it);
canonical, that is, ascending by (length, id). The counts cover every document; the code table is bounded by the
vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, Scratch, documents, keyed_join, partitions, shared, ship_package, slices, worker_state

INTERVAL = 256
BLOCK_IDS = 1 << 18
BLOCK_SCHEMA = "shard int, block int, n_ids long, offset long, doc_ids array<long>, lengths array<int>, checkpoints binary, payload binary"


# Codes


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for the symbols with a count, by package-merge; 0 for the others."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n, levels, packages = len(order), [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(np.cumsum(rank < n))
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for leaves in reversed(levels):
        own = int(leaves[take - 1])
        out[order[:own]] += 1
        take = 2 * (take - own)
        if not take:
            break
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, as a number of its length's bits."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[np.count_nonzero(lengths == 0) :].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical_codes(lengths).astype(np.int64)
        self.limit = max(1, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[np.count_nonzero(lengths == 0) :]
        width = 1 << (self.limit - self.lengths[order])
        self.symbol = np.zeros(1 << self.limit, np.int32)
        self.size = np.zeros(1 << self.limit, np.int64)
        filled = int(width.sum())
        self.symbol[:filled], self.size[:filled] = np.repeat(order, width), np.repeat(self.lengths[order], width)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Payload of documents one after the other, their byte bounds, and each one's checkpoints from its own start."""
        size = self.lengths[ids]
        ends = np.cumsum(counts)
        total = np.concatenate(([0], np.cumsum(size)))
        bits = total[ends] - total[ends - counts]
        bounds = np.concatenate(([0], np.cumsum((bits + 7) // 8)))
        local = total[:-1] - np.repeat(total[ends - counts], counts)
        at = local + np.repeat(bounds[:-1] * 8, counts)
        spread = self.codes[ids] << (40 - size - (at & 7))
        first, room = at >> 3, int(bounds[-1]) + 5
        out = np.zeros(room, np.int64)
        for k in range(5 if self.limit > 25 else (self.limit + 14) // 8):  # bytes that a code can touch
            out += np.bincount(first + k, (spread >> (32 - 8 * k)) & 255, room).astype(np.int64)
        marks = [local[e - c : e : INTERVAL].astype(np.uint32) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        return out[: bounds[-1]].astype(np.uint8), bounds, marks

    def decode(self, payload: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of stretches that begin at the given bits, all stretches in step."""
        raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)]).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        at, left, place = starts[order].astype(np.int64), counts[order], (np.cumsum(counts) - counts)[order]
        out, mask = np.empty(int(counts.sum()), np.int32), (1 << self.limit) - 1
        active = np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), side="right")
        for step, n in enumerate(active.tolist()):
            at = at[:n]
            byte = at >> 3
            window = (raw[byte] << 32) | (raw[byte + 1] << 24) | (raw[byte + 2] << 16) | (raw[byte + 3] << 8) | raw[byte + 4]
            found = (window >> (40 - self.limit - (at & 7))) & mask
            out[place[:n] + step] = self.symbol[found]
            at = at + self.size[found]
        return out


# Writing


#: Words of these characters only are normalised and cut here: composed already, with simple lower case, no digits but 0-9.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u012f\u0131-\u017e]*").fullmatch
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017e]+").findall
#: What decides the patterns above, in a tokenizer's file.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """A byte-level tokenizer's letter for each byte, by Latin-1 character: itself if printable, else the next from U+0100."""
    out: dict[int, str] = {}
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out[b] = chr(b) if shown else chr(256 + sum(1 for x in out.values() if ord(x) > 255))
    return out


class _WordIds:
    """Ids of texts by a tokenizers library file that drops white space, so that words can be encoded alone and kept.

    Texts are cut at the six ASCII white-space characters only: no pattern or normalisation of such a tokenizer reaches
    across them. If the file has the word splitting of `_SPLIT`, words of plain Latin letters are cut into its pre-tokens
    here and only those go to its model; all other words go through the whole tokenizer. `word_cut` off encodes whole texts.
    """

    def __init__(self, source: str, word_cut: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.word_cut = Tokenizer.from_str(source), word_cut
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.kind == np.uint16 else "I"
        spec = json.loads(source)
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.plain = (spec.get("normalizer") or {}).get("normalizers") == _NORMAL and len(cut) == 2 and cut[0].get("pattern") == {"Regex": _SPLIT} and cut[0].get("behavior") == "Removed" and cut[0].get("invert") is True and cut[1].get("type") == "ByteLevel" and not cut[1].get("use_regex") and not cut[1].get("add_prefix_space")
        names = [t["content"] for t in spec.get("added_tokens", [])]
        self.marks = re.compile("|".join(map(re.escape, names))) if names else None
        self.letters_only = self.plain and not any(n.isalpha() for n in names)
        self.letters = _byte_letters()
        self.words, self.parts = Memo(self._word, 900_000, 32), Memo(self._part, 700_000, 32)  # about 270 MB when full; longer ones aren't kept

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _word(self, raw: bytes) -> bytes:
        if self.letters_only and raw.isalpha():  # of ASCII letters alone: one pre-token, and no special token's name
            return self.parts[raw.lower().decode()]
        word = raw.decode()
        if not self.plain or not _PLAIN(word) or self.marks and self.marks.search(word):
            return self._whole(word)
        parts = _PARTS(word.lower())
        return self.parts[parts[0]] if len(parts) == 1 else b"".join(map(self.parts.__getitem__, parts))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.word_cut:
            return [self._whole(t or "") for t in texts]
        return [b"".join(map(self.words.__getitem__, t.encode().split())) if t else b"" for t in texts]


def _encode_texts(broadcast, word_cut: bool, end_id: int):
    def run(batches):
        key, source = broadcast.value
        encode = worker_state(("word ids", key, word_cut), lambda: _WordIds(source, word_cut))
        end = np.array([end_id], encode.kind).tobytes()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([i + end for i in encode(batch.column("text").to_pylist())], pa.binary())], ["doc_id", "ids"])

    return run


def _count_ids(kind, size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    return run


def _coder(broadcast) -> Coder:
    key, lengths = broadcast.value
    return worker_state(("huffman", key), lambda: Coder(np.frombuffer(lengths, np.uint8)))


_BLOCK_ROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("offset", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("checkpoints", pa.binary()), ("payload", pa.binary())])


def _blocks(broadcast, kind, block_ids: int):
    """A partition's rows, in order of id, to blocks of coded documents; the shard is the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]):
        coder, width = _coder(broadcast), np.dtype(kind).itemsize
        shard, block, offset, held, docs, blobs = TaskContext.get().partitionId(), 0, 0, 0, [], []

        def full():
            nonlocal block, offset, held, docs, blobs
            counts = np.array([len(b) // width for b in blobs], np.int64)
            payload, bounds, marks = coder.encode(np.frombuffer(b"".join(blobs), kind).astype(np.int64), counts)
            marks = np.concatenate([m + np.uint32(8 * at) for m, at in zip(marks, bounds[:-1].tolist(), strict=True)])
            row = {"shard": [shard], "block": [block], "n_ids": [held], "offset": [offset], "doc_ids": [docs], "lengths": [counts], "checkpoints": [marks.tobytes()], "payload": [payload.tobytes()]}
            block, offset, held, docs, blobs = block + 1, offset + held, 0, [], []
            return pa.RecordBatch.from_pydict(row, _BLOCK_ROW)

        for batch in slices(batches):
            for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                n = len(blob) // width
                if docs and held + n > block_ids:
                    yield full()
                docs.append(doc)
                blobs.append(blob)
                held += n
        if docs:
            yield full()

    return run


def write_ids(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, word_cut: bool = True, limit: int = 16, block_ids: int = BLOCK_IDS) -> None:
    """Encodes the texts, appends end_id to each, and writes the blocks and the code table to `path` (which must be new).

    A null or empty text is the end id alone. Ids ascend, null ids first; documents of one id stand together, in order
    of a hash of their ids, by which a hot id is split over parts. The code lengths of an empty table are all 0, and it has no blocks. word_cut needs a
    tokenizer that drops white space.
    """
    from tokenizers import Tokenizer

    spark = df.sparkSession
    ship_package(spark)
    source = open(tokenizer_path, encoding="utf-8").read()
    vocabulary = Tokenizer.from_str(source).get_vocab_size()
    size, kind = max(end_id + 1, vocabulary), np.uint16 if vocabulary <= 1 << 16 else np.uint32
    docs = documents(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = shared(spark, (hashlib.sha256(source.encode()).hexdigest(), source))
    with Scratch(spark) as scratch:
        ids = scratch.written(docs.mapInArrow(_encode_texts(texts, word_cut, end_id), "doc_id long, ids binary"), "ids")
        counts = np.zeros(size, np.int64)
        for row in ids.mapInArrow(_count_ids(kind, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
            counts[row["id"]] = row["n"]
        lengths = code_lengths(counts, max(limit, int(np.count_nonzero(counts)).bit_length()))
        code = shared(spark, (hashlib.sha256(lengths.tobytes()).hexdigest(), lengths.tobytes()))
        order = (F.asc_nulls_first("doc_id"), F.xxhash64("ids"))
        ordered = ids.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "ids")
        ordered.mapInArrow(_blocks(code, kind, block_ids), BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(path)
    table = [(-1, 0, 0, 0, [], [], b"", lengths.tobytes())]
    spark.createDataFrame(table, BLOCK_SCHEMA).coalesce(1).write.mode("append").parquet(path)


# Reading


def _read(broadcast, keep: bool):
    def run(batches):
        coder = _coder(broadcast)
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                stretches = -(-lengths // INTERVAL)
                counts = np.full(int(stretches.sum()), INTERVAL, np.int64)
                last = np.cumsum(stretches) - 1
                counts[last] = lengths - (stretches - 1) * INTERVAL
                ids = coder.decode(row["payload"], np.frombuffer(row["checkpoints"], np.uint32), counts).astype("<u4")
                ends = np.cumsum(lengths)
                each = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array([i.astype(np.int32) for i in each], pa.list_(pa.int32()))] * keep, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + keep])

    return run


def read_ids(spark, path: str, *, outputs: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with `outputs`, ids of each document."""
    ship_package(spark)
    rows = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    lengths = bytes(rows.filter("shard = -1").select("payload").first()[0])
    blocks = rows.filter("shard >= 0")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each part file
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    placed = keyed_join(blocks, starts, "shard", "inner").withColumn("first", F.col("before") + F.col("offset"))
    code = shared(spark, (hashlib.sha256(lengths).hexdigest(), lengths))
    return placed.select("doc_ids", "lengths", "checkpoints", "payload", "first").mapInArrow(_read(code, outputs), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * outputs)
