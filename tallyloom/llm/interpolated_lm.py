"""Language-model scores by deleted interpolation, by default of bigrams.

The maximum-likelihood estimates of all orders are mixed from below: p_k(w) = m * c(context w)/c(context) + (1-m) * p_k-1(w),
where m depends on the order and on the bucket floor(log2 c(context)), and p_0 = 1/(V+1) (V known tokens and one unknown).
The weights are learned by expectation-maximisation on held-out counts, order by order: training documents of one residue of
crc32(id) are held out, estimates come from the others, and each bucket's likelihood depends only on the ratio of the two
estimates, of which a histogram with a fixed number of bins is gathered over all held-out tokens. Final scores use the
counts of all training documents. A text begins after end marks as its context and closes with one.

Nothing that grows with the vocabulary is broadcast or collected. Texts are read once, into chunks of about CHUNK_TOKENS
tokens (packed columns of a table). A chunk asks each cell (a hash of the n-gram) once for each of its distinct n-grams,
with its own counts of it; the cell adds up what all chunks sent and answers each. So the commonest n-gram costs one entry
for each chunk, not for each document, and the number of cells follows from the number of tokens (CELL_KEYS asked for in
each), so that a task's memory stays the same at any size. Words are known by 62-bit hashes, longer n-grams by hashes with
20 bits more than their number has (62 at most), so that one in a million shares its count with another, at any size. A
document isn't split: memory is bounded by the chunk or by the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Memo, Scratch, ascii_lower_words, crc_residue, documents, partitions, ship_package, slices, worker_state

_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9))
END = xxhash.xxh3_64_intdigest(b" end ")
BINS, PER_OCTAVE, LOWEST = 2048, 32, -20 * 32
CHUNK_TOKENS, CELL_KEYS = 1 << 18, 1 << 20
NO_CONTEXT = 63


# Packed columns


def pack(*columns: np.ndarray, ascending: bool = False) -> bytes:
    """Whole-number columns, of any lengths, compressed; the first as differences if ascending.

    Each is stored in the fewest of 1, 2, 4 or 8 bytes, bytes of equal weight side by side, which compress well where the
    numbers are small.
    """
    head, body = [len(columns), int(ascending)], []
    for k, c in enumerate(columns):
        c = np.ascontiguousarray(c).astype(_U)
        if ascending and k == 0 and len(c):
            c = np.diff(c, prepend=_U(0))
        top = int(c.max()) if len(c) else 0
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        head += [len(c), width]
        body.append(np.ascontiguousarray(c.astype(f"<u{width}").view(np.uint8).reshape(len(c), width).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, _U).tobytes() + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, ascending = raw[:16].view(_U).tolist()
    sizes, at, out = raw[16 : 16 + 16 * n].view(_U).tolist(), 16 + 16 * n, []
    for length, width in zip(sizes[::2], sizes[1::2], strict=True):
        planes = raw[at : at + length * width].reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(length).astype(_U))
        at += length * width
    if ascending:
        out[0] = np.cumsum(out[0], dtype=_U)
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)


# Chunks of documents


def _table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _chunks(modulus: int, test: int, held: int, kind: pa.DataType):
    """Texts to rows (chunk, n_tokens, docs, tokens): the documents' table, and their tokens as places in a list of hashes. Held-out documents have chunks of their own, of odd numbers."""

    schema = pa.schema([("chunk", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.binary()), ("tokens", pa.binary())])

    def packed(number, ids, roles, hashes):
        lengths = np.array([len(h) for h in hashes], np.int64)
        docs = pa.table({"doc_id": pa.array(ids, kind), "n": lengths, "role": pa.array(roles, pa.int8())})
        found, place, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        rank = np.argsort(-times, kind="stable")  # common words get small numbers
        to = np.empty(len(rank), np.int64)
        to[rank] = np.arange(len(rank))
        return pa.RecordBatch.from_pydict({"chunk": [number], "n_tokens": [int(lengths.sum())], "docs": [_table_bytes(docs)], "tokens": [pack(found[rank], to[place])]}, schema)

    def run(batches):
        memo = worker_state("lm hashes", lambda: Memo(xxhash.xxh3_64_intdigest))
        number = TaskContext.get().partitionId() << 24
        open_chunks = {False: ([], [], []), True: ([], [], [])}
        size = {False: 0, True: 0}
        for batch in slices(batches):
            own = batch.column("doc_id").to_pylist()
            residue = crc_residue(own, modulus)
            for i, r, text in zip(own, residue.tolist(), batch.column("text").to_pylist(), strict=True):
                words = ascii_lower_words(text)
                h = np.empty(len(words) + 1, _U)
                h[:-1] = np.fromiter(map(memo.__getitem__, words), _U, len(words))
                h[-1] = END
                aside = r == held != test
                for column, value in zip(open_chunks[aside], (i, 0 if r == test else 1 if aside else 2, h), strict=True):  # not trained on; held out while weights are learned; retained
                    column.append(value)
                size[aside] += len(h)
                if size[aside] >= CHUNK_TOKENS:
                    yield packed(number << 1 | aside, *open_chunks[aside])
                    number, open_chunks[aside], size[aside] = number + 1, ([], [], []), 0
        for aside, columns in open_chunks.items():
            if columns[0]:
                yield packed(number << 1 | aside, *columns)
                number += 1

    return run


class Chunk:
    """A chunk's documents, and for each order of n-grams the distinct keys and each token's place among them."""

    def __init__(self, docs: bytes, tokens: bytes, order: int, bits: int):
        self.docs = pa.ipc.open_stream(docs).read_all()
        self.n, role = (self.docs.column(c).to_numpy() for c in ("n", "role"))
        self.starts = np.cumsum(self.n) - self.n
        self.role = np.repeat(role, self.n)
        hashes, place = unpack(tokens)
        h, pad, gram, self.keys, self.places = hashes[place.astype(np.int64)], _U(END), None, [], []
        with np.errstate(over="ignore"):
            for k in range(1, order + 1):
                if k == 1:
                    gram = h
                else:
                    context = np.empty_like(gram)
                    context[1:] = gram[:-1]
                    context[self.starts] = pad
                    gram = self._mixed(context, h)
                    pad = self._mixed(pad, _U(END))
                found, at = np.unique((gram & ~_U(3) if k == 1 else gram >> _U(64 - bits) << _U(2)) | _U(k), return_inverse=True)
                self.keys.append(found)
                self.places.append(at)

    @staticmethod
    def _mixed(context, h):
        x = context * _MIX[0] + h
        x = (x ^ (x >> _U(32))) * _MIX[1]
        return x ^ (x >> _U(29))

    def cells(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All keys; their order by (cell, key); and the bounds of each cell in that order."""
        keys = np.concatenate(self.keys)
        with np.errstate(over="ignore"):
            cell = (((keys ^ (keys >> _U(31))) * _MIX[0] >> _U(32)) % _U(n)).astype(np.uint16 if n <= 65536 else np.uint32)
        order = np.argsort(keys, kind="stable")
        order = order[np.argsort(cell[order], kind="stable")]
        return keys, order, np.searchsorted(cell[order], np.arange(n + 1))

    def totals(self, answers: list[tuple[int, bytes]], cells: int, column: int) -> list[np.ndarray]:
        """Of each order, each token's count over all documents: column 0 in all training ones, 1 in the retained ones (known to held-out chunks)."""
        _, order, _ = self.cells(cells)
        values = np.empty(len(order), _U)
        parts = [unpack(blob) for _, blob in sorted(answers)]
        values[order] = np.concatenate([p[0] if column == 0 else p[0] - p[1] for p in parts])
        out, at = [], 0
        for found, place in zip(self.keys, self.places, strict=True):
            out.append(values[at : at + len(found)][place])
            at += len(found)
        return out


def _requests(order: int, bits: int, cells: int):
    def run(batches):
        for batch in batches:
            for number, docs, tokens in zip(*(batch.column(c) for c in ("chunk", "docs", "tokens")), strict=True):
                own = Chunk(docs.as_py(), tokens.as_py(), order, bits)
                keys, by_cell, bounds = own.cells(cells)
                sums = [np.concatenate([np.bincount(p[own.role >= r], minlength=len(k)) for p, k in zip(own.places, own.keys, strict=True)]) for r in (1, 2)]
                full = np.flatnonzero(np.diff(bounds))
                blobs = [pack(keys[part], *(s[part] for s in sums), ascending=True) for part in (by_cell[bounds[c] : bounds[c + 1]] for c in full)]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([number.as_py()] * len(full), pa.int64()), pa.array(blobs, pa.binary())], ["cell", "chunk", "blob"])

    return run


def _answers(table: pa.Table) -> pa.Table:
    """Of one cell: the sums of what chunks sent, to each of them; and a row of the cell's known tokens and all tokens, in all and in retained documents."""
    cell = table.column("cell")[0].as_py()
    chunks, parts = table.column("chunk").to_pylist(), [unpack(b.as_py()) for b in table.column("blob")]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys)
    at = _runs(keys[order])
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
    every, kept = (np.add.reduceat(np.concatenate([p[c] for p in parts])[order], at) for c in (1, 2))
    word = (keys[order][at] & _U(3)) == 1
    rows = [(-1, b"", int((every[word] > 0).sum()), int(every[word].sum()), int((kept[word] > 0).sum()), int(kept[word].sum()))]
    start = 0
    for chunk, p in zip(chunks, parts, strict=True):
        own = place[start : start + len(p[0])]
        rows.append((chunk, pack(every[own], *[every[own] - kept[own]] * (chunk & 1)), 0, 0, 0, 0))
        start += len(own)
    names = ["chunk", "blob", "v_all", "n_all", "v_ret", "n_ret"]
    columns = [pa.array(c, pa.binary() if n == "blob" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
    return pa.table([pa.array([cell] * len(rows), pa.int32()), *columns], names=["cell", *names])


# The mixture


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), NO_CONTEXT - 1), NO_CONTEXT)


def _levels(counts: list[np.ndarray], starts: np.ndarray, n: int, v: int, weights: list[np.ndarray]):
    """For each order that has weights, and the next: each token's context bucket, and its estimate over the mixture below; then the mixture of all with weights."""
    below = np.full(len(counts[0]), 1.0 / (v + 1))
    ends = np.append(starts[1:], len(below)) - 1
    for k in range(min(len(counts), len(weights) + 1)):
        if k == 0:
            context = np.full(len(below), float(n))
            bucket = np.zeros(len(below), np.int64)
        else:
            context = np.empty(len(below))
            context[1:] = counts[k - 1][:-1]
            context[starts] = counts[0][ends]  # as many end marks as beginnings
            bucket = _bucket(context)
        ratio = counts[k].astype(float) / np.maximum(context, 1) / below
        yield bucket, ratio
        if k < len(weights):
            m = weights[k][bucket]
            below = below * (m * ratio + 1 - m)
    yield below


def _histogram(weights: list[np.ndarray], n: int, v: int):
    """Held-out tokens by context bucket and bin of the ratio of the next order's estimate to the mixture below."""

    def run(batches):
        size = (NO_CONTEXT + 1) * BINS
        count, total = np.zeros(size), np.zeros(size)
        for batch in batches:
            for blob in batch.column("held"):
                lengths, *counts = unpack(blob.as_py())
                if len(lengths):
                    lengths = lengths.astype(np.int64)
                    bucket, ratio = list(_levels(counts, np.cumsum(lengths) - lengths, n, v, weights))[-2]
                    with np.errstate(divide="ignore"):
                        place = np.where(ratio > 0, 1 + np.clip(np.floor(np.log2(ratio) * PER_OCTAVE) - LOWEST, 0, BINS - 2), 0).astype(np.int64)
                    count += np.bincount(bucket * BINS + place, minlength=size)
                    total += np.bincount(bucket * BINS + place, ratio, size)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(full // BINS), pa.array(full % BINS), pa.array(count[full].astype(np.int64)), pa.array(total[full])], ["bucket", "bin", "n", "total"])

    return run


def mixture_weights(histogram: list[tuple[int, int, float]], rounds: int = 300) -> np.ndarray:
    """Each bucket's weight of the higher estimate, by expectation-maximisation over (bucket, held-out tokens, ratio).

    A bucket without held-out tokens takes the weight of the next lower one that has some, else 0; the bucket of unseen
    contexts always has 0. Weights stay below 1, so that no text has probability 0.
    """
    out = np.zeros(NO_CONTEXT + 1)
    last = 0.0
    for b in range(NO_CONTEXT):
        rows = [(n, ratio) for bucket, n, ratio in histogram if bucket == b]
        if rows:
            n, ratio = (np.array(x, float) for x in zip(*rows, strict=True))
            last = 0.5
            for _ in range(rounds):
                last = float((n * last * ratio / (last * ratio + 1 - last)).sum() / n.sum())
            last = min(last, 1 - 1e-6)
        out[b] = last
    return out


def _chunk_and_answers(table: pa.Table, order: int, bits: int) -> tuple[Chunk, list[tuple[int, bytes]]]:
    own, answers = None, []
    for cell, docs, blob in zip(*(table.column(c) for c in ("cell", "docs", "blob")), strict=True):
        if docs.is_valid:
            own = Chunk(docs.as_py(), blob.as_py(), order, bits)
        else:
            answers.append((cell.as_py(), blob.as_py()))
    return own, answers


def _held_counts(order: int, bits: int, cells: int):
    def run(table: pa.Table) -> pa.Table:
        own, answers = _chunk_and_answers(table, order, bits)
        return pa.table({"held": pa.array([pack(own.n, *own.totals(answers, cells, 1))], pa.binary())})

    return run


def _scores(order: int, bits: int, cells: int, weights: list[np.ndarray], n: int, v: int):
    def run(table: pa.Table) -> pa.Table:
        own, answers = _chunk_and_answers(table, order, bits)
        counts = own.totals(answers, cells, 0)
        words = counts[0].astype(float)
        *_, p = _levels(counts, own.starts, n, v, weights)
        per_doc = lambda x: np.add.reduceat(x, own.starts)
        return pa.table({"doc_id": own.docs.column("doc_id"), "held_out": own.docs.column("role").to_numpy() == 0, "n_tokens": own.n, "n_known": per_doc((words > 0).astype(np.int64)), "train_tokens": np.full(len(own.n), n, np.int64), "base_score": per_doc(np.log10((words + 1.0) / (n + v + 1.0))), "score": per_doc(np.log10(p))})

    return run


def interpolated_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, order: int = 2, modulus: int = 7, test: int = 2, held: int = 3) -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    order: words of the longest n-grams, 1 to 3; with 3 about three times as many n-grams are sent as with 2. Documents with crc32(id) mod `modulus` equal to `test` aren't learned from;
    those with `held` give the held-out counts that the weights are learned on, and count in the final model. A null or
    empty text is the end mark alone. A null id counts as empty text for its residue. Repeated rows count each. Without
    training documents all scores are 0: the one unknown token has probability 1. An empty table gives no rows.
    """
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    spark: SparkSession = df.sparkSession
    ship_package(spark)
    docs = documents(df, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType
    with Scratch(spark) as scratch:
        chunks = docs.mapInArrow(_chunks(modulus, test, held, to_arrow_type(id_type)), "chunk long, n_tokens long, docs binary, tokens binary")
        chunks = scratch.written(chunks, "lm-chunks", "uncompressed")
        tokens = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        cells = max(partitions(spark), -(-tokens * order // (2 * CELL_KEYS)))  # at least half of the n-grams of a chunk are new to it
        bits = min(62, 20 + (tokens * order).bit_length())
        asked = chunks.mapInArrow(_requests(order, bits, cells), "cell int, chunk long, blob binary")
        answers = asked.groupBy("cell").applyInArrow(_answers, "cell int, chunk long, blob binary, v_all long, n_all long, v_ret long, n_ret long")
        answers = scratch.written(answers, "lm-answers", "uncompressed")
        scratch.settle()
        sums = answers.filter("chunk = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v_all", "n_all", "v_ret", "n_ret"))).first()
        own = chunks.select("chunk", F.lit(-1).alias("cell"), "docs", F.col("tokens").alias("blob"))
        told = answers.filter("chunk >= 0").select("chunk", "cell", F.lit(None).cast("binary").alias("docs"), "blob")

        def both(held_only: bool = False):
            rows = own.unionByName(told)
            return (rows.filter("chunk % 2 = 1") if held_only else rows).groupBy("chunk")

        held_out = scratch.written(both(held_only=True).applyInArrow(_held_counts(order, bits, cells), "held binary"), "lm-held", "uncompressed")
        scratch.settle()
        weights: list[np.ndarray] = []
        for _ in range(order):
            found = held_out.mapInArrow(_histogram(weights, sums["n_ret"], sums["v_ret"]), "bucket long, bin long, n long, total double")
            rows = found.groupBy("bucket", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # at most 64 * BINS
            weights.append(mixture_weights([(r["bucket"], r["n"], r["total"] / r["n"]) for r in rows]))
        schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return scratch.result(both().applyInArrow(_scores(order, bits, cells, weights, sums["n_all"], sums["v_all"]), schema), "lm-scores")


__all__ = ["interpolated_scores", "mixture_weights", "pack", "unpack"]
