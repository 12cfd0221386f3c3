"""The deterministic tools as relational queries: lookups, intervals, quorums, closures, units and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import checkpoint_folder
from ..sources.tables import table


def merged_intervals(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end) of half-open whole-number spans after merging overlapping and adjacent ones."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(w)
    return spans.withColumn("reach", reach).withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


@query("WITH s AS (SELECT user_id, epoch(date_trunc('minute', ts))::BIGINT // 60 AS a, epoch(date_trunc('minute', ts))::BIGINT // 60 + 30 AS b FROM events), r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s), i AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM r), j AS (SELECT user_id, g, min(a) AS a, max(b) AS b FROM i GROUP BY ALL) SELECT user_id, count(*) AS n_islands, CAST(sum(b - a) AS BIGINT) AS covered, CAST(max(b) - min(a) - sum(b - a) AS BIGINT) AS gaps FROM j GROUP BY 1")
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    spans = table(spark, d, "events").select("user_id", minute.alias("start")).withColumn("end", F.col("start") + 30)
    found = merged_intervals(spans, "user_id").groupBy("user_id").agg(F.count("*").alias("n_islands"), F.sum(F.col("end") - F.col("start")).alias("covered"), (F.max("end") - F.min("start")).alias("whole"))
    return found.select("user_id", "n_islands", "covered", (F.col("whole") - F.col("covered")).alias("gaps"))


@query("SELECT n_regionkey, stage, n_removed, n_left, n_left * 2 <= total AS unsafe FROM (SELECT n_regionkey, stage, CAST(sum(n) OVER (PARTITION BY n_regionkey ORDER BY stage) AS BIGINT) AS n_removed, CAST(total - sum(n) OVER (PARTITION BY n_regionkey ORDER BY stage) AS BIGINT) AS n_left, total FROM (SELECT n_regionkey, n_nationkey % 4 AS stage, count(*) AS n FROM nation GROUP BY ALL) JOIN (SELECT n_regionkey, count(*) AS total FROM nation GROUP BY 1) USING (n_regionkey))")
def quorum_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Members removed so far at each stage of each partition, and whether a majority is left."""
    nation = table(spark, d, "nation").select("n_regionkey", (F.col("n_nationkey") % 4).alias("stage"))
    total = nation.groupBy("n_regionkey").agg(F.count("*").alias("total"))
    removed = F.sum("n").over(Window.partitionBy("n_regionkey").orderBy("stage"))
    stages = nation.groupBy("n_regionkey", "stage").agg(F.count("*").alias("n")).withColumn("n_removed", removed).join(total, "n_regionkey")
    left = F.col("total") - F.col("n_removed")
    return stages.select("n_regionkey", "stage", "n_removed", left.alias("n_left"), (left * 2 <= F.col("total")).alias("unsafe"))


def closure(edges: DataFrame, limit: int = 64) -> DataFrame:
    """(a, b): b is reached from a over one edge or more, by doubling the reach until nothing is new."""
    checkpoint_folder(edges.sparkSession)
    reach = edges.select("a", "b").distinct().checkpoint()
    n = reach.count()
    for _ in range(limit):
        more = reach.union(reach.alias("l").join(reach.alias("r"), F.col("l.b") == F.col("r.a")).select("l.a", "r.b")).distinct().checkpoint()
        m = more.count()
        if m == n:
            return reach
        reach, n = more, m
    raise ValueError("closure not reached")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey + 5 AS b FROM nation WHERE n_nationkey + 5 < 25 UNION ALL SELECT n_nationkey, n_nationkey + 7 FROM nation WHERE n_nationkey + 7 < 25), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, count(*) AS n_dependents FROM c GROUP BY 1")
def dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"))
    edges = n.withColumn("b", F.explode(F.array(F.col("a") + 5, F.col("a") + 7))).filter("b < 25")
    return closure(edges).groupBy("a").agg(F.count("*").alias("n_dependents"))


@query("SELECT s_nationkey, count(DISTINCT s_suppkey % 10) AS n_shards, count(DISTINCT CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 10 END) AS n_surviving, count(DISTINCT CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 10 END) >= 2 AS recoverable FROM supplier GROUP BY 1")
def shard_recovery(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_nationkey", (F.col("s_suppkey") % 10).alias("shard"), (F.col("s_suppkey") % 3 != 0).alias("alive"))
    alive = F.count_distinct(F.when(F.col("alive"), F.col("shard")))
    return s.groupBy("s_nationkey").agg(F.count_distinct("shard").alias("n_shards"), alive.alias("n_surviving"), (alive >= 2).alias("recoverable"))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first_event FROM events WHERE event_type = 'click' GROUP BY ALL")
def log_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'click'").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT CAST(l_shipdate AS DATE)::VARCHAR AS day, count(*) AS n, round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 6) AS mean, CASE WHEN count(*) = 0 THEN 'no_records' END AS error FROM lineitem GROUP BY 1")
def run_aggregate(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return table(spark, d, "lineitem").groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.lit(None).cast("string").alias("error"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 AS millimetres, round(p_size / 1000.0, 6)::DOUBLE AS kilometres FROM part")
def unit_convert(spark: SparkSession, d: str) -> DataFrame:
    """Sizes in metres, by decimal factors of one dimension."""
    size = F.col("p_size").cast("decimal(20,6)")
    return table(spark, d, "part").select("p_partkey", (size * 1000).cast("bigint").alias("millimetres"), (size / 1000).cast("double").alias("kilometres"))


@query("WITH v AS (SELECT p_partkey, [p_size, p_partkey % 10, p_partkey % 3] AS have, [25, 5, 1] AS want FROM part) SELECT p_partkey, CASE WHEN have[1] <> want[1] THEN have[1] > want[1] WHEN have[2] <> want[2] THEN have[2] > want[2] ELSE have[3] >= want[3] END AS compatible FROM v")
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    """Dotted versions compared as tuples of numbers."""
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    parts = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    return table(spark, d, "part").select("p_partkey", (parts(version) >= parts(F.lit("25.5.1"))).alias("compatible"))


@query("SELECT s_nationkey AS pool, count(*) AS n_members, round(sum(s_acctbal), 2) AS used, round(50000 - sum(s_acctbal), 2) AS remaining, sum(s_acctbal) <= 50000 AS within FROM supplier GROUP BY 1")
def quota_allocation(spark: SparkSession, d: str) -> DataFrame:
    used = F.sum("s_acctbal")
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("pool")).agg(F.count("*").alias("n_members"), F.round(used, 2).alias("used"), F.round(50000 - used, 2).alias("remaining"), (used <= 50000).alias("within"))
