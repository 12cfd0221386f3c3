"""Numbers of rows in a total order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder


def numbered(rows: DataFrame, order: str, out: str) -> DataFrame:
    """rows with their place, from 0, in ascending order of a column without ties.

    Rows are dealt by ranges of the column and numbered within each range; only the ranges' sizes reach the driver.
    """
    checkpoint_folder(rows.sparkSession)
    sorted_rows = rows.repartitionByRange(order).sortWithinPartitions(order)
    local = F.monotonically_increasing_id()
    placed = sorted_rows.select("*", F.shiftright(local, 33).alias("_range"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).checkpoint()
    sizes, starts, at = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}, [], 0
    for k in sorted(sizes):
        starts.append((k, at))
        at += sizes[k]
    first = rows.sparkSession.createDataFrame(starts or [(0, 0)], "_range long, _first long")
    return placed.join(F.broadcast(first), "_range").withColumn(out, F.col("_first") + F.col("_at")).drop("_range", "_first", "_at")  # a row for each range


def running_sums(rows: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """rows with the sum of `value` over their group's rows up to and with them, in an order without ties."""
    return running_totals(rows, group, order, {value: out})


def running_totals(rows: DataFrame, group: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """rows with sums of several columns, named by `values`, over their group's rows up to and with them, in an order without ties.

    Rows are dealt by ranges of (group, order), so a large group spans many tasks: each sums its own part, and the sums of a
    group's parts before it, a row for each part, are added.
    """
    checkpoint_folder(rows.sparkSession)
    dealt = rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    parts = dealt.groupBy(group, "_part").agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), *(F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values))
    upto = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.withColumns({f"_within_{v}": F.sum(v).over(upto) for v in values})
    own = within.join(offsets, (F.col("_of") == F.col("_part")) & F.col("_group").eqNullSafe(F.col(group)))
    summed = own.withColumns({out: F.col(f"_before_{v}") + F.col(f"_within_{v}") for v, out in values.items()})
    return summed.drop("_part", "_of", "_group", *(f"_{kind}_{v}" for kind in ("before", "within") for v in values))
