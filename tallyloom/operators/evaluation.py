"""Evaluation statistics: alignment, paired effects, unknown-aware rates, costs, failures, resume and cache pairing."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.tables import table
from .order import numbered


@query("SELECT o_orderkey AS unit_id, CASE WHEN n IS NOT NULL THEN 'completed' WHEN o_orderstatus = 'O' THEN 'not_started' ELSE 'interrupted' END AS status, coalesce(n, 0) AS n_results FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_orderkey = o_orderkey")
def align_left_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every planned unit once; a missing result is interrupted if the unit was started, else not started."""
    results = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    plan = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    status = F.when(F.col("n").isNotNull(), "completed").when(F.col("o_orderstatus") == "O", "not_started").otherwise("interrupted")
    return plan.join(results, "o_orderkey", "left").select(F.col("o_orderkey").alias("unit_id"), status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_results"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """(group_id, left, right) of every labelled document: good quality, and not toxic, by source."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.select(F.col("source").alias("group_id"), (F.col("quality") == 1).cast("int").alias("left"), (F.col("toxic") == 0).cast("int").alias("right"))


_OUT = "o AS (SELECT source AS group_id, CAST(quality = 1 AS INTEGER) AS l, CAST(toxic = 0 AS INTEGER) AS r FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_OUT} SELECT group_id, count(*) AS n, round(sum(l) / count(*), 6) AS left_rate, round(sum(r) / count(*), 6) AS right_rate, round((sum(r) - sum(l)) / count(*), 6) AS delta FROM o GROUP BY 1")
def paired_effect(spark: SparkSession, d: str) -> DataFrame:
    rate = lambda e: F.round(e / F.count("*"), 6)
    return outcomes(spark, d).groupBy("group_id").agg(F.count("*").alias("n"), rate(F.sum("left")).alias("left_rate"), rate(F.sum("right")).alias("right_rate"), rate(F.sum("right") - F.sum("left")).alias("delta"))


@query(f"WITH {_OUT}, g AS (SELECT group_id, sum(r) - sum(l) AS s, count(*) AS n FROM o GROUP BY 1) SELECT group_id, round(((SELECT sum(s) FROM g) - s) / ((SELECT sum(n) FROM g) - n), 6) AS delta_without FROM g")
def leave_one_group_out(spark: SparkSession, d: str) -> DataFrame:
    groups = outcomes(spark, d).groupBy("group_id").agg((F.sum("right") - F.sum("left")).alias("s"), F.count("*").alias("n"))
    total = groups.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return groups.crossJoin(F.broadcast(total)).select("group_id", F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 6).alias("delta_without"))  # the total is one row


def bootstrap_interval(groups: list[tuple[float, int]], draws: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of the effect over draws of whole groups with replacement."""
    rng, n, means = random.Random(seed), len(groups), []
    for _ in range(draws if n else 0):
        picked = [groups[rng.randrange(n)] for _ in range(n)]
        means.append(sum(s for s, _ in picked) / sum(k for _, k in picked))
    means.sort()
    at = lambda q: means[int((len(means) - 1) * q)] * (1 - (len(means) - 1) * q % 1) + means[min(len(means) - 1, int((len(means) - 1) * q) + 1)] * ((len(means) - 1) * q % 1)
    return (at(0.025), at(0.975)) if means else (float("nan"), float("nan"))


def bootstrap_status(groups: list[tuple[int | None, int]]) -> tuple[str, float | None, float | None]:
    """(status, low, high) of groups (sum of differences, rows); a sum is None where a score of the group is unknown."""
    if not groups:
        return "NO_DATA", None, None
    if any(s is None for s, _ in groups):
        return "INCOMPLETE_SCORING", None, None
    return ("NOT_ESTIMABLE", None, None) if len(groups) < 2 else ("CALCULATED", *bootstrap_interval(groups))


@query()
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Whole groups drawn again, 10,000 times. The groups (sources: a bounded number) are drawn on the driver, in order of
    their name, since the one seeded sequence of draws is part of the result."""
    whole = F.when(F.count("right") + F.count("left") == 2 * F.count("*"), F.sum("right") - F.sum("left"))
    rows = outcomes(spark, d).groupBy("group_id").agg(whole.alias("s"), F.count("*").alias("n")).orderBy("group_id").collect()
    return spark.createDataFrame([(len(rows), *bootstrap_status([(r["s"], r["n"]) for r in rows]))], "n_groups long, status string, low double, high double")


@query("SELECT lang, count(*) AS n, count(*) FILTER (toxic = 0) AS n_true, count(*) FILTER (toxic = 1) AS n_false, count(*) FILTER (toxic IS NULL) AS n_unknown FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def tally_tristate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").withColumn("x", F.col("toxic") == 0)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("x").alias("n_true"), F.count_if(~F.col("x")).alias("n_false"), F.count_if(F.col("x").isNull()).alias("n_unknown"))


@query("SELECT source, CASE WHEN count(toxic) = count(*) THEN round(count(*) FILTER (toxic = 0) / count(*), 6) END AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def success_rate_or_unknown(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(T.known_rate(F.col("toxic") == 0), 6).alias("rate"))


@query("SELECT event_type, user_id % 3 AS condition, count(*) AS n, round(sum(value), 4) AS cost FROM events GROUP BY ALL")
def cost_by_condition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("condition")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost"))


@query("SELECT 'event_type' AS metric, event_type AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2")
def status_histogram_long(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    long = lambda name, col: events.groupBy(col.alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "key", "n")
    return long("event_type", F.col("event_type")).union(long("day", F.date_format("ts", "yyyy-MM-dd")))


@query("SELECT event_type AS category, CASE WHEN value > 90 THEN 'too_high' ELSE 'too_low' END AS reason, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events WHERE value > 90 OR value < 2 GROUP BY ALL")
def failure_index(spark: SparkSession, d: str) -> DataFrame:
    failed = table(spark, d, "events").filter("value > 90 or value < 2")
    return failed.groupBy(F.col("event_type").alias("category"), F.when(F.col("value") > 90, "too_high").otherwise("too_low").alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("WITH e AS (SELECT user_id, props, value, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events WHERE event_type IN ('view', 'click')) SELECT a.user_id, a.p AS place, a.props = b.props AS same, round(b.value - a.value, 6) AS delta FROM e a JOIN e b ON a.user_id = b.user_id AND a.p = b.p AND a.event_type = 'view' AND b.event_type = 'click'")
def cache_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Two conditions, a user's views and clicks, paired by place; `same` and `delta` are unknown where either side is."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).select("user_id", "event_type", "props", "value", "event_id", "ts")
    e = e.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("bigint"))
    a, b = (e.filter(F.col("event_type") == s).select("user_id", "place", F.col("props").alias(f"p{k}"), F.col("value").alias(f"v{k}")) for k, s in enumerate(("view", "click")))
    same = F.when(F.col("p0").isNotNull() & F.col("p1").isNotNull(), F.col("p0") == F.col("p1"))
    return a.join(b, ["user_id", "place"]).select("user_id", "place", same.alias("same"), F.round(F.col("v1") - F.col("v0"), 6).alias("delta"))


@query("SELECT event_id, lead(event_type) OVER w AS next_type, CAST(date_diff('second', ts, lead(ts) OVER w) AS BIGINT) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def adjacent_durations(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = lambda c: F.unix_timestamp(F.date_trunc("second", F.col(c)).cast("timestamp"))
    e = table(spark, d, "events").select("event_id", "ts", F.lead("event_type").over(w).alias("next_type"), F.lead("ts").over(w).alias("t2"))
    return e.select("event_id", "next_type", (second("t2") - second("ts")).alias("seconds"))


@query("WITH k AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, props, first_value(props) OVER w AS first_props, row_number() OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id)) SELECT event_id, CASE WHEN p = 1 THEN 'accepted' WHEN props = first_props THEN 'replay' ELSE 'conflict' END AS state FROM k")
def idempotency_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The first request of a key is accepted; a later one with the same payload is a replay, else a conflict."""
    w = Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "props", F.first("props").over(w).alias("f"), F.row_number().over(w).alias("p"))
    return e.select("event_id", F.when(F.col("p") == 1, "accepted").when(F.col("props") == F.col("f"), "replay").otherwise("conflict").alias("state"))


@query("WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'), t AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT coalesce(s.user_id, t.user_id) AS user_id, CASE WHEN t.user_id IS NULL THEN 'interrupted' WHEN s.user_id IS NULL THEN 'unplanned' ELSE 'terminal' END AS state FROM s FULL JOIN t ON s.user_id = t.user_id")
def resume_states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = lambda t, c: e.filter(F.col("event_type") == t).select("user_id").distinct().withColumn(c, F.lit(1))
    state = F.when(F.col("t").isNull(), "interrupted").when(F.col("s").isNull(), "unplanned").otherwise("terminal")
    return kind("signup", "s").join(kind("purchase", "t"), "user_id", "full").select("user_id", state.alias("state"))


@query("SELECT item_id, j AS candidate, 42 + 4 * (row_number() OVER (PARTITION BY j ORDER BY item_id) - 1) + j AS seed FROM benchmark, unnest(range(4)) AS t(j)")
def candidate_cross_plan(spark: SparkSession, d: str) -> DataFrame:
    items = numbered(table(spark, d, "benchmark").select("item_id"), "item_id", "i")
    plan = items.withColumn("candidate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    return plan.select("item_id", "candidate", (42 + 4 * F.col("i") + F.col("candidate")).alias("seed"))


@query("WITH r AS (SELECT source, doc_id, toxic FROM documents JOIN labels USING (doc_id)) SELECT a.source, a.doc_id AS chosen, b.doc_id AS rejected FROM r a JOIN r b ON a.source = b.source AND a.toxic = 0 AND b.toxic = 1 QUALIFY row_number() OVER (PARTITION BY a.source ORDER BY least(a.doc_id, b.doc_id), greatest(a.doc_id, b.doc_id)) = 1")
def first_valid_pair(spark: SparkSession, d: str) -> DataFrame:
    """The first pair of a success and a failure of each source in combination order: no pairs are formed, since the first
    combination's members are the first row of one kind and the first of the other."""
    r = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    both = r.groupBy("source").agg(F.min(F.when(F.col("toxic") == 0, F.col("doc_id"))).alias("chosen"), F.min(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("rejected"))
    return both.filter("chosen is not null and rejected is not null").select("source", "chosen", "rejected")


@query("WITH p AS (SELECT doc_id FROM documents WHERE lang = 'en') SELECT coalesce(p.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN p.doc_id IS NULL THEN 'unplanned' ELSE 'planned' END AS state FROM p FULL JOIN labels l ON p.doc_id = l.doc_id")
def missing_planned(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.lit(1).alias("p"))
    have = table(spark, d, "labels").select("doc_id", F.lit(1).alias("l"))
    state = F.when(F.col("l").isNull(), "missing").when(F.col("p").isNull(), "unplanned").otherwise("planned")
    return plan.join(have, "doc_id", "full").select("doc_id", state.alias("state"))


@query("SELECT doc_id, source, CASE WHEN row_number() OVER w % 2 = 1 THEN 'base,tuned' ELSE 'tuned,base' END AS conditions, 41 + row_number() OVER w AS seed FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def plan_alternating(spark: SparkSession, d: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("bigint")
    return table(spark, d, "documents").select("doc_id", "source", F.when(i % 2 == 1, "base,tuned").otherwise("tuned,base").alias("conditions"), (i + 41).alias("seed"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 2) AS weighted_mean, arg_min(l_linestatus, struct_pack(a := l_discount, b := l_orderkey, c := l_linenumber)) AS best FROM lineitem GROUP BY 1")
def token_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    weighted = F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 2)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(weighted.alias("weighted_mean"), F.min_by("l_linestatus", F.struct("l_discount", "l_orderkey", "l_linenumber")).alias("best"))
