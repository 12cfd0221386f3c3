"""The remaining tools: lookups by key, reads of nested tables, ordered checks, and units by a table.

Each tool answers a table of requests, so that a missing key or an invalid request is a row with an error, not a lost one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table
from .tools import closure, merged_intervals


def looked_up(requests: DataFrame, source: DataFrame, on: list[str], error: str) -> DataFrame:
    """Every request with its row of source, by key; where there is none the columns are null and `error` is set."""
    found = source.withColumn("_found", F.lit(True))
    return requests.join(found, on, "left").withColumn("error", F.when(F.col("_found").isNull(), error)).drop("_found")


@query("SELECT k AS p_partkey, p_name, p_brand, CASE WHEN p_partkey IS NULL THEN 'unknown_resource' END AS error FROM (SELECT p_partkey * 2 AS k FROM part) r LEFT JOIN part ON p_partkey = k")
def version_document(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return looked_up(part.select((F.col("p_partkey") * 2).alias("p_partkey")), part.select("p_partkey", "p_name", "p_brand"), ["p_partkey"], "unknown_resource")


@query("SELECT k AS o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey IS NULL THEN 'unknown_report' END AS error FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) r LEFT JOIN orders ON o_orderkey = k")
def build_report(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    asked = orders.select(F.col("o_custkey").alias("o_orderkey")).distinct()
    return looked_up(asked, orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"], "unknown_report")


@query("SELECT l_orderkey, l_linenumber, n_rows, first_item, CASE WHEN p IS NULL THEN 'unknown_release' END AS error FROM (SELECT l_orderkey + 1 AS l_orderkey, l_linenumber FROM lineitem) a LEFT JOIN (SELECT l_orderkey AS o, l_linenumber AS l, count(*) AS n_rows, min(l_partkey) AS first_item, true AS p FROM lineitem GROUP BY ALL) b ON o = l_orderkey AND l = l_linenumber")
def release_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Lookup by a composite key."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    release = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_rows"), F.min("l_partkey").alias("first_item"))
    return looked_up(lines.select((F.col("l_orderkey") + 1).alias("l_orderkey"), "l_linenumber"), release, ["l_orderkey", "l_linenumber"], "unknown_release")


@query("WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events), dd AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events) SELECT u.user_id, dd.day, n_events, total, CASE WHEN n_events IS NULL THEN 'snapshot_missing' END AS error FROM u CROSS JOIN dd LEFT JOIN s ON s.user_id = u.user_id AND s.day = dd.day")
def deployment_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """What each user's deployment was on each day of the calendar; a day without a snapshot is an error row."""
    events = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    days = events.agg(F.array_sort(F.collect_set("day")).alias("days"))  # one row, of the calendar's days
    taken = events.groupBy("user_id", "day").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
    users = events.select("user_id").distinct()
    asked = users.join(F.broadcast(days)).select("user_id", F.explode("days").alias("day"))
    return looked_up(asked, taken, ["user_id", "day"], "snapshot_missing")


@query("SELECT user_id, a AS start_minute, b AS end_minute, CASE WHEN a < b THEN n END AS event_count, CASE WHEN a < b THEN c END AS critical_count, CASE WHEN a >= b THEN 'invalid_window' END AS error FROM (SELECT user_id, (user_id * 7) % 1440 AS a, (user_id * 7) % 1440 + (user_id % 5 - 1) * 120 AS b FROM (SELECT DISTINCT user_id FROM events)) w LEFT JOIN LATERAL (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS c FROM events e WHERE e.user_id = w.user_id AND hour(ts) * 60 + minute(ts) >= a AND hour(ts) * 60 + minute(ts) < b) ON true")
def incident_window(spark: SparkSession, d: str) -> DataFrame:
    """Events, and errors among them, in a half-open range of minutes of the day; an empty or reversed range is an error."""
    stamp = F.col("ts").cast("timestamp")
    events = table(spark, d, "events").select("user_id", (F.hour(stamp) * 60 + F.minute(stamp)).cast("bigint").alias("minute"), "event_type")
    first = (F.col("user_id") * 7) % 1440
    rows = events.withColumns({"start_minute": first, "end_minute": first + (F.col("user_id") % 5 - 1) * 120})
    inside = (F.col("minute") >= F.col("start_minute")) & (F.col("minute") < F.col("end_minute"))
    counted = rows.groupBy("user_id", "start_minute", "end_minute").agg(F.count_if(inside).alias("n"), F.count_if(inside & (F.col("event_type") == "error")).alias("c"))
    valid = F.col("start_minute") < F.col("end_minute")
    return counted.select("user_id", "start_minute", "end_minute", F.when(valid, F.col("n")).alias("event_count"), F.when(valid, F.col("c")).alias("critical_count"), F.when(~valid, "invalid_window").alias("error"))


def incident_policy(events: Column, critical: Column, event_threshold: Column, critical_threshold: Column) -> tuple[Column, Column]:
    """(recommendation, error): either threshold reached pages; more critical events than events is an error."""
    wrong = critical > events
    page = (events >= event_threshold) | (critical >= critical_threshold)
    return F.when(~wrong, F.when(page, "page").otherwise("observe")), F.when(wrong, "inconsistent_counts")


@query("SELECT user_id, CASE WHEN c <= n THEN CASE WHEN n >= 60 OR c >= 5 THEN 'page' ELSE 'observe' END END AS recommendation, CASE WHEN c > n THEN 'inconsistent_counts' END AS error FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS n, count(*) FILTER (event_type = 'error') AS c FROM events GROUP BY 1)")
def incident_recommendation(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's clicks, and the errors among what they did; more errors than clicks don't go together."""
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n"), F.count_if(F.col("event_type") == "error").alias("c"))
    advice, error = incident_policy(F.col("n"), F.col("c"), F.lit(60), F.lit(5))
    return counts.select("user_id", advice.alias("recommendation"), error.alias("error"))


@query("SELECT a.p_brand, a.p_type, a.p_size, n_builds, CASE WHEN n_builds IS NULL THEN 'build_missing' END AS error FROM (SELECT DISTINCT p_brand, p_type, p_size + 1 AS p_size FROM part) a LEFT JOIN (SELECT p_brand, p_type, p_size, count(*) AS n_builds FROM part GROUP BY ALL) b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size")
def package_build(spark: SparkSession, d: str) -> DataFrame:
    """Lookup by a key of three parts."""
    part = table(spark, d, "part").select("p_brand", "p_type", "p_size")
    builds = part.groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n_builds"))
    asked = part.withColumn("p_size", F.col("p_size") + 1).distinct()
    return looked_up(asked, builds, ["p_brand", "p_type", "p_size"], "build_missing")


@query("WITH c AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL), r AS (SELECT user_id, o, t FROM (SELECT DISTINCT user_id FROM events), (VALUES (0, 'click'), (1, 'purchase'), (2, 'view')) x(o, t)) SELECT r.user_id, string_agg(t || '=' || CASE WHEN v IS NULL THEN 'missing' WHEN v > 5 THEN 'pass' ELSE 'fail' END, ',' ORDER BY o) AS outcomes, bool_and(coalesce(v > 5, false)) AS all_passed FROM r LEFT JOIN c ON c.user_id = r.user_id AND event_type = t GROUP BY 1")
def suite_assessment(spark: SparkSession, d: str) -> DataFrame:
    """Required cases in their stated order; a case without a record is missing, which is no pass."""
    cases = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("case")).agg(F.max("value").alias("v"))
    required = cases.select("user_id").distinct().select("user_id", F.posexplode(F.array(*map(F.lit, ("click", "purchase", "view")))).alias("place", "case"))
    rows = required.join(cases, ["user_id", "case"], "left")
    outcome = F.when(F.col("v").isNull(), "missing").when(F.col("v") > 5, "pass").otherwise("fail")
    listed = F.array_sort(F.collect_list(F.struct("place", F.concat("case", F.lit("="), outcome).alias("o"))))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(listed, lambda x: x["o"]), ",").alias("outcomes"), F.bool_and(F.coalesce(F.col("v") > 5, F.lit(False))).alias("all_passed"))


@query("SELECT c_custkey, n_name AS pool, round(cap, 2) AS capacity, round(c_acctbal, 2) AS quota FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT s_nationkey, sum(s_acctbal) AS cap FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def storage_pool(spark: SparkSession, d: str) -> DataFrame:
    """Tenants with their pool and its capacity, by a join of pools and quotas."""
    pools = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("cap"))
    named = table(spark, d, "nation").join(pools, "n_nationkey")
    tenants = table(spark, d, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    return tenants.select("c_custkey", F.col("n_name").alias("pool"), F.round("cap", 2).alias("capacity"), F.round("c_acctbal", 2).alias("quota"))


@query("SELECT n_regionkey, count(*) AS n_members, count(*) // 2 + 1 AS quorum, string_agg(n_name, ',' ORDER BY n_nationkey) AS members FROM nation GROUP BY 1")
def quorum_layout(spark: SparkSession, d: str) -> DataFrame:
    """Each partition's members, and how many of them are its quorum."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n_members"), F.floor(F.count("*") / 2 + 1).alias("quorum"), F.array_join(listed, ",").alias("members"))


@query("WITH n AS (SELECT n_regionkey, n_nationkey, n_nationkey % 4 AS stage FROM nation), t AS (SELECT n_regionkey, count(*) AS total FROM n GROUP BY 1), c AS (SELECT t.n_regionkey, g.stage, total, (SELECT count(*) FROM n WHERE n.n_regionkey = t.n_regionkey AND n.stage <= g.stage) AS gone FROM t, (SELECT unnest(range(0, 4)) AS stage) g) SELECT stage, bool_and(total - gone >= total // 2 + 1) AS safe, CAST(sum(gone) AS BIGINT) AS n_removed, stage = (SELECT min(stage) FROM c WHERE total - gone < total // 2 + 1) AS first_unsafe FROM c GROUP BY stage")
def quorum_removals(spark: SparkSession, d: str) -> DataFrame:
    """Members removed stage by stage: which stages leave every partition its quorum, and the first that doesn't."""
    nation = table(spark, d, "nation").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") % 4).alias("stage"))
    total = nation.groupBy("n_regionkey").agg(F.count("*").alias("total"))
    first_gone = nation.groupBy("n_regionkey", "n_nationkey").agg(F.min("stage").alias("stage"))  # a member asked for twice goes once
    per_stage = total.withColumn("stage", F.explode(F.sequence(F.lit(0), F.lit(3)))).join(first_gone.groupBy("n_regionkey", "stage").agg(F.count("*").alias("n")), ["n_regionkey", "stage"], "left").na.fill(0, ["n"])
    gone = F.sum("n").over(Window.partitionBy("n_regionkey").orderBy("stage"))
    stages = per_stage.withColumn("gone", gone).groupBy("stage").agg(F.bool_and(F.col("total") - F.col("gone") >= F.floor(F.col("total") / 2) + 1).alias("safe"), F.sum("gone").alias("n_removed"))
    first = stages.agg(F.min(F.when(~F.col("safe"), F.col("stage"))).alias("u"))
    return stages.join(F.broadcast(first)).select("stage", "safe", "n_removed", (F.col("stage") == F.col("u")).alias("first_unsafe"))


@query("SELECT user_id, count(*) AS n_events, min(m) AS first_start, max(m) + 30 AS last_end FROM (SELECT user_id, epoch(date_trunc('minute', ts))::BIGINT // 60 AS m FROM events) GROUP BY 1")
def event_intervals(spark: SparkSession, d: str) -> DataFrame:
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), F.min(minute).alias("first_start"), (F.max(minute) + 30).alias("last_end"))


def coverage_in_window(spans: DataFrame, key: str) -> DataFrame:
    """(key, kind, start, end) of spans (key, start, end, from, to): covered and uncovered stretches of the window [from, to).

    Spans are clipped to the window, which must not be empty, then merged with those that they overlap or adjoin; what they
    leave of the window is uncovered, the whole of it where none reaches in.
    """
    windows = spans.select(key, "from", "to").distinct()
    clipped = spans.filter("start < to AND end > from").select(key, F.greatest("start", "from").alias("start"), F.least("end", "to").alias("end"))
    covered = merged_intervals(clipped, key)
    w = Window.partitionBy(key).orderBy("start")
    ends = windows.join(covered, key, "left").withColumn("before", F.coalesce(F.lag("end").over(w), F.col("from"))).withColumn("last", F.lead("start").over(w).isNull())
    gap = lambda a, b: F.struct(F.lit("uncovered").alias("kind"), a.alias("start"), b.alias("end"))
    before = gap(F.col("before"), F.coalesce("start", "to"))
    after = F.when(F.col("last") & F.col("end").isNotNull(), gap(F.col("end"), F.col("to")))
    gaps = ends.select(key, F.explode(F.array(before, after)).alias("g")).filter("g.start < g.end").select(key, "g.*")
    return covered.select(key, F.lit("covered").alias("kind"), "start", "end").unionByName(gaps)


@query("""WITH s AS (SELECT user_id, epoch(date_trunc('minute', ts))::BIGINT // 60 AS a FROM events), w AS (SELECT user_id, min(a) + 100 AS f, min(a) + 1540 AS t FROM s GROUP BY 1),
m AS (SELECT DISTINCT user_id, unnest(range(greatest(a, f), least(a + 30, t))) AS x FROM s JOIN w USING (user_id) WHERE a < t AND a + 30 > f), i AS (SELECT user_id, x, x - row_number() OVER (PARTITION BY user_id ORDER BY x) AS g FROM m),
n AS (SELECT user_id, unnest(range(f, t)) AS x FROM w EXCEPT SELECT user_id, x FROM m), j AS (SELECT user_id, x, x - row_number() OVER (PARTITION BY user_id ORDER BY x) AS g FROM n)
SELECT user_id, 'covered' AS kind, min(x) AS first_minute, max(x) + 1 AS past_minute FROM i GROUP BY user_id, g UNION ALL SELECT user_id, 'uncovered', min(x), max(x) + 1 FROM j GROUP BY user_id, g""")
def interval_window_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Covered and uncovered stretches of each user's first day but 100 minutes, as rows."""
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    spans = table(spark, d, "events").select("user_id", minute.alias("start")).withColumn("end", F.col("start") + 30)
    first = F.min("start").over(Window.partitionBy("user_id"))
    return coverage_in_window(spans.withColumns({"from": first + 100, "to": first + 1540}), "user_id").withColumnsRenamed({"start": "first_minute", "end": "past_minute"})


@query("SELECT a, count(*) AS n_prerequisites, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS dependents FROM (SELECT n_nationkey AS a, n_nationkey + 5 AS b FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_nationkey + 7 FROM nation WHERE n_nationkey < 18) GROUP BY 1")
def dependency_graph(spark: SparkSession, d: str) -> DataFrame:
    edges = _nation_edges(spark, d)
    return edges.groupBy("a").agg(F.count("*").alias("n_prerequisites"), F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b.cast("string")), ",").alias("dependents"))


def _nation_edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"))
    return n.withColumn("b", F.explode(F.array(F.col("a") + 5, F.col("a") + 7))).filter("b < 25")


def order_report(edges: DataFrame, targets: DataFrame, order: DataFrame) -> DataFrame:
    """(plan, problem, node, other) of installation orders (plan, place, node) for targets (plan, node).

    Edges (a, b): a is needed before b. Required are the targets and all that they need, however far. Problems: missing
    (required, not in the order), extra (not required), duplicate, and violation: `other` is needed by `node`, but its first
    place isn't earlier.
    """
    needs = targets.join(closure(edges).select("a", F.col("b").alias("node")), "node").select("plan", F.col("a").alias("node"))
    required = targets.select("plan", "node").union(needs).distinct()
    placed = order.groupBy("plan", "node").agg(F.min("place").alias("place"), F.count("*").alias("times"))
    row = lambda df, name, other=None: df.select("plan", F.lit(name).alias("problem"), "node", (F.col(other) if other else F.lit(None)).cast("bigint").alias("other"))
    missing = row(required.join(placed, ["plan", "node"], "left_anti"), "missing")
    extra = row(placed.join(required, ["plan", "node"], "left_anti"), "extra")
    pairs = required.join(edges.select(F.col("a").alias("other"), F.col("b").alias("node")), "node").join(placed, ["plan", "node"])
    late = pairs.join(placed.select("plan", F.col("node").alias("other"), F.col("place").alias("first")), ["plan", "other"]).filter("first >= place")
    return missing.union(extra).union(row(placed.filter("times > 1"), "duplicate")).union(row(late, "violation", "other"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey + 5 AS b FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_nationkey + 7 FROM nation WHERE n_nationkey < 18), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
t AS (SELECT n_nationkey AS plan, n_nationkey AS node FROM nation), r AS (SELECT plan, node FROM t UNION SELECT plan, a FROM t JOIN c ON c.b = t.node),
o AS (SELECT t.plan, (n.n_nationkey * 7) % 25 AS place, n.n_nationkey AS node FROM t, nation n WHERE n.n_nationkey <= t.plan AND n.n_nationkey % 6 <> 1 UNION ALL SELECT plan, 25, plan FROM t WHERE plan % 4 = 0), p AS (SELECT plan, node, min(place) AS place, count(*) AS times FROM o GROUP BY ALL)
SELECT plan, 'missing' AS problem, node, CAST(NULL AS BIGINT) AS other FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.plan = r.plan AND p.node = r.node)
UNION ALL SELECT plan, 'extra', node, NULL FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE p.plan = r.plan AND p.node = r.node) UNION ALL SELECT plan, 'duplicate', node, NULL FROM p WHERE times > 1
UNION ALL SELECT p.plan, 'violation', p.node, q.node FROM r JOIN p ON p.plan = r.plan AND p.node = r.node JOIN e ON e.b = p.node JOIN p q ON q.plan = p.plan AND q.node = e.a WHERE q.place >= p.place""")
def installation_order(spark: SparkSession, d: str) -> DataFrame:
    """For each nation as the target, an order that leaves some out, shuffles them and repeats some."""
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    plans = nodes.select(F.col("node").alias("plan"))
    order = plans.join(nodes, (F.col("node") <= F.col("plan")) & (F.col("node") % 6 != 1)).select("plan", ((F.col("node") * 7) % 25).alias("place"), "node")
    again = plans.filter("plan % 4 = 0").select("plan", F.lit(25).alias("place"), F.col("plan").alias("node"))
    return order_report(_nation_edges(spark, d), plans.withColumn("node", F.col("plan")), order.union(again))


@query("SELECT s_nationkey, string_agg(x, ',' ORDER BY x) AS placement FROM (SELECT DISTINCT s_nationkey, CAST(s_suppkey % 10 AS VARCHAR) || '@' || CAST(s_suppkey % 3 AS VARCHAR) AS x FROM supplier) GROUP BY 1")
def shard_placement(spark: SparkSession, d: str) -> DataFrame:
    place = F.concat((F.col("s_suppkey") % 10).cast("string"), F.lit("@"), (F.col("s_suppkey") % 3).cast("string"))
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_set(place)), ",").alias("placement"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, count(*) OVER () AS n FROM (SELECT event_id, ts FROM events WHERE event_type = 'error' AND strftime(ts, '%Y-%m-%d') = '2024-01-02')")
def filtered_log(spark: SparkSession, d: str) -> DataFrame:
    """The rows of one level on one day, and their number beside each."""
    rows = table(spark, d, "events").filter("event_type = 'error' AND to_date(ts) = date'2024-01-02'").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("n"))))


@query("WITH a AS (SELECT user_id, k, (SELECT count(*) FROM events e WHERE e.user_id = u.user_id AND e.event_type = k) AS n, (SELECT round(sum(value), 4) FROM events e WHERE e.user_id = u.user_id AND e.event_type = k) AS total FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('click'), ('refund')) t(k)) SELECT user_id, k AS kind, n, total, CASE WHEN n = 0 THEN 'no_records' END AS error FROM a")
def run_records(spark: SparkSession, d: str) -> DataFrame:
    """Sums for two kinds of record, of which some users, or all, have none: those are error rows."""
    events = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), "value")
    asked = events.select("user_id").distinct().withColumn("kind", F.explode(F.array(F.lit("click"), F.lit("refund"))))
    rows = asked.join(events, ["user_id", "kind"], "left").groupBy("user_id", "kind").agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.withColumn("error", F.when(F.col("n") == 0, "no_records"))


def unit_table(spark: SparkSession) -> DataFrame:
    """(unit, dimension, factor to the dimension's base). Fixed values."""
    rows = [("ms", "time", "0.001"), ("s", "time", "1"), ("min", "time", "60"), ("B", "bytes", "1"), ("KiB", "bytes", "1024"), ("MiB", "bytes", "1048576")]
    return spark.createDataFrame(rows, "unit string, dimension string, factor string").withColumn("factor", F.col("factor").cast("decimal(20,6)"))


@query("WITH u AS (SELECT * FROM (VALUES ('ms', 'time', 0.001), ('s', 'time', 1), ('min', 'time', 60), ('B', 'bytes', 1), ('KiB', 'bytes', 1024), ('MiB', 'bytes', 1048576)) t(unit, dim, f)) SELECT p_partkey, a.unit AS source_unit, b.unit AS target_unit, CASE WHEN a.dim = b.dim THEN round(CAST(p_size AS DOUBLE) * a.f / b.f, 6) END AS converted, CASE WHEN a.dim IS NULL OR b.dim IS NULL THEN 'unknown_unit' WHEN a.dim <> b.dim THEN 'incompatible_units' END AS error FROM (SELECT p_partkey, p_size, ['ms', 's', 'min', 'B', 'KiB', 'MiB', 'foot'][p_partkey % 7 + 1] AS x, ['s', 'KiB', 'ms', 'MiB'][p_partkey % 4 + 1] AS y FROM part) LEFT JOIN u a ON a.unit = x LEFT JOIN u b ON b.unit = y")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Sizes between units of a table, in decimals; units of two dimensions and unknown ones are errors."""
    units = F.broadcast(unit_table(spark))  # six rows
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % n + 1).cast("int"))
    asked = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("decimal(12,0)").alias("size"), pick(("ms", "s", "min", "B", "KiB", "MiB", "foot"), 7).alias("x"), pick(("s", "KiB", "ms", "MiB"), 4).alias("y"))
    both = asked.join(units.select(F.col("unit").alias("x"), F.col("unit").alias("source_unit"), F.col("dimension").alias("dx"), F.col("factor").alias("fx")), "x", "left").join(units.select(F.col("unit").alias("y"), F.col("unit").alias("target_unit"), F.col("dimension").alias("dy"), F.col("factor").alias("fy")), "y", "left")
    error = F.when(F.col("dx").isNull() | F.col("dy").isNull(), "unknown_unit").when(F.col("dx") != F.col("dy"), "incompatible_units")
    value = F.round((F.col("size") * F.col("fx")).cast("double") / F.col("fy").cast("double"), 6)
    return both.select("p_partkey", "source_unit", "target_unit", F.when(error.isNull(), value).alias("converted"), error.alias("error"))
