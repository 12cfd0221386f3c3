"""Packed arrays: sequences of whole numbers as fixed-width little-endian items in blocks, with an index, readable by any range of rows.

A table of blocks: `first` and `rows` (row numbers in the order given), `items` before it, `offsets` (where each row begins in
the block) and `data`. Blocks end at `most` items, so a reader's filter on `first` skips all but the blocks it needs, and a
task holds one block. Row numbers come from ranges of the order and the ranges' sizes; no task sees all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder, ship_package

#: Names of widths.
WIDTHS = {1: "u1", 2: "<u2", 4: "<u4", 8: "<i8"}
#: Items of a block, after which it ends.
BLOCK_ITEMS = 1 << 18
_BLOCK = "part int, at long, rows long, n_items long, ids binary, offsets binary, data binary"


def _packed(width: int, most: int):
    kind = np.dtype(WIDTHS[width])
    limit = np.iinfo(kind)

    def run(batches):
        part, at, ids, sizes, arrays, held = None, 0, [], [], [], 0

        def block():
            offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype("<i8")
            data = b"".join(arrays)
            columns = [[part], [at], [len(sizes)], [held], [np.array(ids, "<i8").tobytes()], [offsets.tobytes()], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "at", "rows", "n_items", "ids", "offsets", "data"])

        for batch in batches:
            for p, i, values in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "items")), strict=True):
                part, values = p, np.array(values or [], dtype=np.int64)
                if len(values) and (values.min() < limit.min or values.max() > limit.max):
                    raise ValueError(f"an item of row {i} doesn't fit {width} bytes")
                ids.append(i)
                sizes.append(len(values))
                arrays.append(values.astype(kind).tobytes())
                held += len(values)
                if held >= most or len(ids) >= most:
                    yield block()
                    at, ids, sizes, arrays, held = at + len(ids), [], [], [], 0
        if ids:
            yield block()

    return run


def write_arrays(df: DataFrame, path: str, id_col: str, items_col: str, width: int = 4, most: int = BLOCK_ITEMS) -> None:
    """Writes the sequences of a column in ascending order of a whole-number id without nulls; a null sequence is an empty one.

    `path` must be new. An item that doesn't fit the width, or is null, fails the write.
    """
    ship_package(df.sparkSession)
    checkpoint_folder(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(items_col).cast("array<bigint>").alias("items"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    blocks = dealt.mapInArrow(_packed(width, most), _BLOCK).checkpoint()
    sizes = blocks.groupBy("part").agg(F.sum("rows").alias("r"), F.sum("n_items").alias("i"))  # a row for each range
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before("r").alias("r0"), before("i").alias("i0"))
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("i1", F.coalesce(F.sum("n_items").over(own), F.lit(0))).join(F.broadcast(starts), "part")
    index = placed.select((F.col("r0") + F.col("at")).alias("first"), "rows", (F.col("i0") + F.col("i1")).alias("items"), "n_items", F.lit(width).alias("width"), "ids", "offsets", "data")
    index.repartitionByRange("first").sortWithinPartitions("first").write.mode("errorifexists").option("parquet.block.size", 1 << 22).parquet(path)


def _unpacked(start: int, stop: int | None):
    def run(batches):
        for batch in batches:
            for first, rows, items, width, ids, offsets, data in zip(*(batch.column(c).to_pylist() for c in ("first", "rows", "items", "width", "ids", "offsets", "data")), strict=True):
                a, b = max(start, first) - first, (rows if stop is None else min(stop, first + rows) - first)
                if a >= b:
                    continue
                at = np.frombuffer(offsets, "<i8")
                values = np.frombuffer(data, WIDTHS[width])[at[a] : at[b]].astype(np.int64)
                own = pa.ListArray.from_arrays(pa.array(at[a : b + 1] - at[a], pa.int32()), pa.array(values))
                columns = [pa.array(np.arange(first + a, first + b)), pa.array(np.frombuffer(ids, "<i8")[a:b]), pa.array(items + at[a:b]), own]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "start", "items"])

    return run


def read_arrays(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """(row, id, start, items) of rows start to stop (exclusive): their number, id, place of the first item among all, and items."""
    ship_package(spark)
    blocks = spark.read.parquet(path).filter(F.col("first") + F.col("rows") > start)
    if stop is not None:
        blocks = blocks.filter(F.col("first") < stop)  # pushed down to the scan
    return blocks.mapInArrow(_unpacked(start, stop), "row long, id long, start long, items array<long>")
