"""Strict JSON lines of files of any size: read by byte ranges in many tasks, numbered and checked in one pass."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json_rules import REPORT, json_report
from ..session import ship_package

#: Most bytes of a line; ranges that are broadcast at most.
LINE_BYTES, BROADCAST_RANGES = 2 << 20, 1_000_000
_ZIPPED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"
_MARK = b"\xef\xbb\xbf"


def _reported(check: Callable[[Any], str | None] | None):
    """Each line's place in its byte range, its text, and its strict reading; rows of a range come in order."""
    names = [field.split(" ")[0] for field in REPORT[7:-1].split(", ")]

    def run(batches):
        at: dict[tuple, int] = {}
        for batch in batches:
            paths, ranges, lines, marks = (batch.column(c).to_pylist() for c in ("path", "range", "raw", "marked"))
            places, texts, reports = [], [], []
            for path, start, raw, marked in zip(paths, ranges, lines, marks, strict=True):
                k = at.get((path, start), 0)
                at[path, start] = k + 1
                raw = _MARK + raw if marked and start == 0 and k == 0 else raw  # what Spark's reader takes away
                try:
                    text = raw.decode("utf-8")
                    report = json_report(text)
                except UnicodeDecodeError:
                    text, report = None, dict.fromkeys(names) | {"rule": "not_utf8"}
                if check is not None and report["rule"] is None and (problem := check(json.loads(report["canonical"]))):
                    report = report | {"rule": problem, "canonical": None}
                places.append(k)
                texts.append(text)
                reports.append(report)
            columns = [batch.column("path"), batch.column("range"), pa.array(places, pa.int64()), pa.array(texts, pa.string()), pa.array([len(x) for x in lines], pa.int64())]
            columns += [pa.array([r[c] for r in reports], pa.int64() if c in ("nodes", "depth") else pa.string()) for c in names]
            yield pa.RecordBatch.from_arrays(columns, ["path", "range", "k", "line", "bytes", *names])

    return run


def read_json_lines(spark: SparkSession, path: str, longest: int = LINE_BYTES, check: Callable[[Any], str | None] | None = None) -> DataFrame:
    """(path, at, line, rule, canonical, kind, nodes, depth): each line as it stands, for byte identity, and its strict reading.

    `at` is the line's place in its file, from 0. Tasks read byte ranges (spark.sql.files.maxPartitionBytes) aligned to line
    ends; a first pass counts lines and bytes of each range, from which places follow, and whether a file's last line has an
    end (else rule `no_line_end`) and the file begins with a byte order mark (which stays in its line). Lines beyond `longest`
    bytes have rule `over_bytes`, bytes that aren't UTF-8 `not_utf8` and a null line. `check` gives a rule that a strict value
    breaks, or None. Empty files have no lines. Files in a compressed format are read whole, each by one task, and the end of
    their last line isn't checked.
    """
    ship_package(spark)
    files = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range")]
    counts = files.select(*at, F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("b")).groupBy("path", "range", "size").agg(F.count("*").alias("n"), F.sum(F.col("b") + 1).alias("bytes"))
    own = Window.partitionBy("path")
    before = F.coalesce(F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.when(~F.col("path").rlike(_ZIPPED), F.col("size") - F.sum("bytes").over(own))  # 0: all is there; -1: no last end; 3 more: a mark
    ranges = counts.select("path", "range", before.alias("before"), F.sum("n").over(own).alias("lines"), over.isin(2, 3).alias("marked"), over.isin(-1, 2).alias("cut"))
    few = F.broadcast(ranges) if counts.count() <= BROADCAST_RANGES else ranges
    raw = files.select(*at, F.col("value").cast("binary").alias("raw")).join(few.select("path", "range", F.coalesce("marked", F.lit(False)).alias("marked")), ["path", "range"]) if _any_marked(ranges) else files.select(*at, F.col("value").cast("binary").alias("raw"), F.lit(False).alias("marked"))
    read = raw.mapInArrow(_reported(check), f"path string, range long, k long, line string, bytes long, {REPORT[7:-1]}")
    placed = read.join(few, ["path", "range"]).withColumn("at", F.col("before") + F.col("k"))
    last = (F.col("at") == F.col("lines") - 1) & F.coalesce("cut", F.lit(False))
    rule = F.when(last, "no_line_end").when(F.col("bytes") > longest, "over_bytes").otherwise(F.col("rule"))
    return placed.withColumn("rule", rule).select("path", "at", "line", "rule", F.when(F.col("rule").isNull(), F.col("canonical")).alias("canonical"), "kind", "nodes", "depth")


def _any_marked(ranges: DataFrame) -> bool:
    return not ranges.filter("marked").isEmpty()


def line_verdicts(lines: DataFrame) -> DataFrame:
    """(path, n_records, n_refused, first_at, first_rule, verdict) of each file that has lines: `valid` only if no line is refused."""
    first = F.min(F.when(F.col("rule").isNotNull(), F.struct("at", "rule")))
    found = lines.groupBy("path").agg(F.count("*").alias("n_records"), F.count("rule").alias("n_refused"), first.alias("f"))
    verdict = F.when(F.col("n_refused") > 0, "invalid").otherwise("valid")
    return found.select("path", "n_records", "n_refused", F.col("f.at").alias("first_at"), F.col("f.rule").alias("first_rule"), verdict.alias("verdict"))
