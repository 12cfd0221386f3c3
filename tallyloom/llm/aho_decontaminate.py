"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test texts, scanning each document once.

Normalised text: A-Z lower-cased, the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ joined by single spaces with one at each
end. The patterns are an item's windows of `window` consecutive words (of a shorter item, its words), likewise with a
space at each end, so a match always covers whole words. Match ends are mapped to word numbers, and those to offsets in
the original text. Words are bytes of UTF-8 decoded as Latin-1, one character for each byte, for the automaton.

The automaton is broadcast as its patterns. A test set of more than `block_windows` distinct windows is worked through in
blocks, each a job of its own whose rows are written before the next one begins, so memory doesn't grow with the test set: the
driver and a worker hold one block's windows at a time.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, documents, shared, ship_package, slices, worker_state

#: Lower-cases A-Z and turns every separator into a space; bytes from 0x80 on belong to words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    # After translate the only ASCII space left is 0x20, and bytes.split knows no other spaces.
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def joined(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""


def _windows(window: int):
    def run(batches):
        for batch in batches:
            items, found = [], []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = normal_words(text)
                if i is not None:
                    own = {joined(words[k : k + window]).encode("latin-1") for k in range(max(1, len(words) - window + 1))} if words else ()
                    items += [i] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([pa.array(items, batch.schema.field("item_id").type), pa.array(found, pa.binary())], ["item_id", "w"])

    return run


class Automaton:
    def __init__(self, windows: list[tuple[bytes, list]]):
        self.machine = ahocorasick.Automaton()
        for w, items in windows:
            self.machine.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(items)))
        if windows:
            self.machine.make_automaton()
        self.empty = not windows

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The merged ranges of hit words, [first, last], and the items found."""
        if self.empty or not words:
            return [], set()
        text, items, ranges, ends = joined(words), set(), [], None
        for end, (n, of) in self.machine.iter(text):
            if ends is None:
                ends = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)[1:]
            last = int(np.searchsorted(ends, end))
            items.update(of)
            ranges.append((last - n + 1, last))
        return merged(ranges), items


def merged(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, ranges)):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def original_offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of ranges of words."""
    spans = [m.span() for m in _WORD.finditer(text)] if ranges else []
    return [(spans[a][0], spans[b][1]) for a, b in ranges]


def _scan(broadcast, id_type, keep_text: bool):
    def run(batches):
        key, windows = broadcast.value
        kept = worker_state("automaton", dict)
        if key not in kept:
            kept.clear()  # one block's at a time
            kept[key] = Automaton(windows)
        automaton = kept[key]
        pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
        for batch in slices(batches):
            n, spans, chars, items = [], [], [], []
            before = (batch.column(c).to_pylist() for c in ("words_hit", "items"))
            for text, hit, had in zip(batch.column("text").to_pylist(), *before, strict=True):
                words = normal_words(text)
                ranges, found = automaton.scan(words)
                ranges = merged([*ranges, *((r["first"], r["last"]) for r in hit)]) if hit else ranges
                n.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in ranges])
                chars.append([{"start": a, "end": b} for a, b in original_offsets(text or "", ranges)])
                items.append(sorted(found | set(had)))
            columns = [batch.column("doc_id"), *[batch.column("text")] * keep_text, pa.array(n, pa.int64()), pa.array(spans, pair("first", "last")), pa.array(chars, pair("start", "end")), pa.array(items, pa.list_(id_type))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *["text"] * keep_text, "n_words", "words_hit", "spans", "items"])

    return run


def scan_benchmark(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = 10, block_windows: int = 500_000) -> DataFrame:
    """One row per row of df: doc_id, n_words, words_hit (ranges of word numbers), spans (their character offsets in the
    original text), items (sorted distinct ids of the items with occurring windows).

    Null and empty texts, of documents or items, have no words and no windows. Items with a null id are left out. Items
    that repeat a window, or an id, count once each. An empty benchmark hits nothing.
    """
    spark = df.sparkSession
    ship_package(spark)
    tests = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    kind = tests.schema["item_id"].dataType
    pair = "array<struct<{}: bigint, {}: bigint>>".format
    schema = f"n_words long, words_hit {pair('first', 'last')}, spans {pair('start', 'end')}, items array<{kind.simpleString()}>"
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    with Scratch(spark) as scratch:
        windows = tests.mapInArrow(_windows(window), f"item_id {kind.simpleString()}, w binary").groupBy("w").agg(F.collect_set("item_id").alias("items"))
        windows = scratch.written(windows.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(2**31))), "windows")
        blocks = max(1, -(-windows.count() // block_windows))
        out = documents(df, id_col, text_col).withColumns({"words_hit": F.lit(None).cast(pair("first", "last")), "items": F.array().cast(f"array<{kind.simpleString()}>")})
        for k in range(blocks):
            rows = [(bytes(r["w"]), r["items"]) for r in windows.filter(F.col("part") % blocks == k).select("w", "items").collect()]  # about block_windows at most
            key = hashlib.sha256(repr(sorted(rows)).encode()).hexdigest()
            more = k + 1 < blocks
            out = out.mapInArrow(_scan(shared(spark, (key, rows)), to_arrow_type(kind), more), f"doc_id {id_type}, " + "text string, " * more + schema)
            if blocks > 1:
                out = scratch.written(out, "hits") if more else scratch.result(out, "hits")
        return out


def contamination(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; options as for scan_benchmark."""
    found = scan_benchmark(df, benchmark, **options)
    hit = F.coalesce(F.aggregate("words_hit", F.lit(0).cast("long"), lambda acc, r: acc + r["last"] - r["first"] + 1), F.lit(0).cast("long"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
