"""Planned against recorded units, pairs of successes and failures with all dispositions, reviews that are inherited or applied, costs by condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import REGISTRY, query
from ..sources.tables import table
from .selection import quota_sample


def plan_states(plan: DataFrame, records: DataFrame, key: str, part: str) -> DataFrame:
    """(key, state, n_records, n_repeated) of every planned and every recorded key: planned, missing or unplanned; none is dropped.

    n_repeated: records beyond the first of each (key, part). A null key is a key.
    """
    parts = records.groupBy(key, part).agg(F.count("*").alias("n"))
    have = parts.groupBy(F.col(key).alias("_k")).agg(F.sum("n").alias("n_records"), F.sum(F.col("n") - 1).alias("n_repeated"))
    wanted = plan.select(key).distinct().withColumn("_planned", F.lit(True))
    both = wanted.join(have, F.col(key).eqNullSafe(F.col("_k")), "full")
    state = F.when(F.col("n_records").isNull(), "missing").when(F.col("_planned").isNull(), "unplanned").otherwise("planned")
    return both.select(F.when(F.col("_planned").isNull(), F.col("_k")).otherwise(F.col(key)).alias(key), state.alias("state"), F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"))


@query("""WITH p AS (SELECT DISTINCT sale_id FROM sales), r AS (SELECT sale_id, CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(n - 1) AS BIGINT) AS n_repeated FROM (SELECT sale_id, line_no, count(*) AS n FROM sale_lines GROUP BY ALL) GROUP BY 1)
SELECT coalesce(p.sale_id, r.sale_id) AS sale_id, CASE WHEN r.n_records IS NULL THEN 'missing' WHEN p.sale_id IS NULL THEN 'unplanned' ELSE 'planned' END AS state, coalesce(n_records, 0) AS n_records, coalesce(n_repeated, 0) AS n_repeated FROM p FULL JOIN r ON p.sale_id IS NOT DISTINCT FROM r.sale_id""")
def recorded_lines(spark: SparkSession, d: str) -> DataFrame:
    """Sales against the lines recorded for them: missing, unplanned and repeated ones flagged."""
    return plan_states(table(spark, d, "sales"), table(spark, d, "sale_lines"), "sale_id", "line_no")


def pair_dispositions(candidates: DataFrame) -> DataFrame:
    """(task, chosen, rejected, and counts) of candidates (task, id, outcome, valid), ids being their frozen order.

    The pair is the first one, in the order of combinations of ids, of a valid success and a valid failure: the first of each
    kind, so no pairs are formed. Every candidate and pair has a disposition, as counts: candidates repeated (all rows of
    such an id are out), invalid, unknown and eligible; pairs of the same outcome, valid ones, and those after the first.
    """
    ids = candidates.groupBy("task", "id").agg(F.count("*").alias("n"), F.max("outcome").alias("outcome"), F.bool_and(F.coalesce("valid", F.lit(False))).alias("valid"))
    once, known = F.col("n") == 1, F.col("outcome").isin("success", "failure")
    state = F.when(~once, "repeated").when(~F.col("valid"), "invalid").when(~F.coalesce(known, F.lit(False)), "unknown").otherwise(F.col("outcome"))
    rows = ids.withColumn("state", state)
    of = lambda s: F.count_if(F.col("state") == s)
    sums = rows.groupBy("task").agg(
        F.min(F.when(F.col("state") == "success", F.col("id"))).alias("chosen"), F.min(F.when(F.col("state") == "failure", F.col("id"))).alias("rejected"),
        of("repeated").alias("n_repeated"), of("invalid").alias("n_invalid"), of("unknown").alias("n_unknown"), of("success").alias("s"), of("failure").alias("f"),
    )
    s, f = F.col("s"), F.col("f")
    two = lambda n: F.floor(n * (n - 1) / 2)
    paired = (s > 0) & (f > 0)
    return sums.select("task", F.when(paired, F.col("chosen")).alias("chosen"), F.when(paired, F.col("rejected")).alias("rejected"), "n_repeated", "n_invalid", "n_unknown", (s + f).alias("n_eligible"), (two(s) + two(f)).alias("n_same_outcome"), (s * f).alias("n_valid"), F.greatest(s * f - 1, F.lit(0)).alias("n_after_first"))


@query("""WITH c AS (SELECT client_id, sale_id, count(*) AS n, max(status) AS status, bool_and(coalesce(total > 0 AND sold_at IS NOT NULL, false)) AS valid FROM sales WHERE client_id IS NOT NULL AND sale_id IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CASE WHEN n > 1 THEN 'repeated' WHEN NOT valid THEN 'invalid' WHEN status = 'done' THEN 'success' WHEN status = 'held' THEN 'failure' ELSE 'unknown' END AS k FROM c),
g AS (SELECT client_id, min(sale_id) FILTER (k = 'success') AS ch, min(sale_id) FILTER (k = 'failure') AS re, count(*) FILTER (k = 'repeated') AS n_repeated, count(*) FILTER (k = 'invalid') AS n_invalid, count(*) FILTER (k = 'unknown') AS n_unknown, count(*) FILTER (k = 'success') AS s, count(*) FILTER (k = 'failure') AS f FROM s GROUP BY 1)
SELECT client_id, CASE WHEN s * f > 0 THEN ch END AS chosen, CASE WHEN s * f > 0 THEN re END AS rejected, n_repeated, n_invalid, n_unknown, s + f AS n_eligible, s * (s - 1) // 2 + f * (f - 1) // 2 AS n_same_outcome, s * f AS n_valid, greatest(s * f - 1, 0) AS n_after_first FROM g""")
def sale_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of each client's sales the first pair of a done and a held one, both with a total and a time, and what became of all others."""
    sales = table(spark, d, "sales").filter("client_id is not null and sale_id is not null")
    outcome = F.when(F.col("status") == "done", "success").when(F.col("status") == "held", "failure").otherwise("unknown")
    valid = (F.col("total") > 0) & F.col("sold_at").isNotNull()
    return pair_dispositions(sales.select(F.col("client_id").alias("task"), F.col("sale_id").alias("id"), outcome.alias("outcome"), valid.alias("valid"))).withColumnRenamed("task", "client_id")


def applied_review(sample: DataFrame, pool: DataFrame, reviews: DataFrame, most: float = 0.05) -> DataFrame:
    """One row: what reviews (id, verdict) of a pool (id) decide, given the frozen sample (id) that had to be reviewed.

    Judged fail or unknown, a row is excluded, and in the sample an error. The pool is blocked if a sampled row has no
    verdict, the sample is empty, or more than `most` of it are errors; nothing is drawn again in place of excluded rows.
    """
    judged = reviews.withColumn("bad", F.col("verdict").isin("fail", "unknown"))
    own = sample.select("id").withColumn("sampled", F.lit(True))
    rows = pool.select("id").join(own, "id", "left").join(judged, "id", "left")
    sampled = F.coalesce("sampled", F.lit(False))
    sums = rows.agg(F.count_if(sampled).alias("denominator"), F.count_if(sampled & F.col("verdict").isNull()).alias("n_missing"), F.count_if(sampled & F.coalesce("bad", F.lit(False))).alias("n_errors"), F.count_if(F.coalesce("bad", F.lit(False))).alias("n_excluded"), F.count("*").alias("n"))
    blocked = (F.col("n_missing") > 0) | (F.col("denominator") == 0) | (F.col("n_errors") > most * F.col("denominator"))
    return sums.select("denominator", "n_missing", "n_errors", "n_excluded", (F.col("n") - F.col("n_excluded")).alias("n_remaining"), blocked.alias("blocked"))


@query(f"""WITH smp AS (SELECT doc_id FROM ({REGISTRY["quota_sample"][1]})), r AS (SELECT l.doc_id, s.doc_id IS NOT NULL AS sampled, CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 0 THEN 'unknown' WHEN toxic = 0 THEN 'pass' END AS v FROM labels l LEFT JOIN smp s ON s.doc_id = l.doc_id),
g AS (SELECT count(*) FILTER (sampled) AS denominator, count(*) FILTER (sampled AND v IS NULL) AS n_missing, count(*) FILTER (sampled AND v IN ('fail', 'unknown')) AS n_errors, count(*) FILTER (v IN ('fail', 'unknown')) AS n_excluded, count(*) AS n FROM r)
SELECT denominator, n_missing, n_errors, n_excluded, n - n_excluded AS n_remaining, n_missing > 0 OR denominator = 0 OR n_errors > 0.05 * denominator AS blocked FROM g""")
def review_applied(spark: SparkSession, d: str) -> DataFrame:
    """Labels as a review of the frozen quota sample: what is excluded, and whether what remains may be used."""
    labels = table(spark, d, "labels")
    verdict = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "unknown").when(F.col("toxic") == 0, "pass")
    pool = labels.select(F.col("doc_id").alias("id"))
    return applied_review(quota_sample(spark, d).select(F.col("doc_id").alias("id")), pool, labels.select(F.col("doc_id").alias("id"), verdict.alias("verdict")))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), l AS (SELECT h, arg_min(quality, doc_id) AS q, arg_min(toxic, doc_id) AS t FROM h JOIN (SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) USING (doc_id) GROUP BY 1), o AS (SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
x AS (SELECT h.doc_id, CASE WHEN o.doc_id IS NOT NULL THEN 'own' WHEN l.h IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, coalesce(o.quality, l.q) AS q, coalesce(o.toxic, l.t) AS t, l.t AS first_t, l.q AS first_q FROM h LEFT JOIN o ON o.doc_id = h.doc_id LEFT JOIN l ON l.h = h.h)
SELECT doc_id, origin, CASE WHEN t = 1 AND first_t = 0 AND first_q = 1 THEN 'restore' WHEN t = 1 THEN 'exclude' WHEN q = 0 THEN 'unknown' ELSE 'retain' END AS disposition FROM x""")
def inherited_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their own review, else that of the first reviewed document with the same text; one excluded against that first review is restored."""
    docs = table(spark, d, "documents").select("doc_id", T.text_hash(F.col("text")).alias("h"))
    own = table(spark, d, "labels").filter("quality is not null and toxic is not null").select("doc_id", "quality", "toxic")
    first = docs.join(own, "doc_id").groupBy("h").agg(F.min_by("quality", "doc_id").alias("first_q"), F.min_by("toxic", "doc_id").alias("first_t"))
    rows = docs.join(own.withColumn("own", F.lit(True)), "doc_id", "left").join(first.withColumn("copy", F.lit(True)), "h", "left")
    q, t = F.coalesce("quality", "first_q"), F.coalesce("toxic", "first_t")
    origin = F.when(F.col("own"), "own").when(F.col("copy"), "inherited").otherwise("none")
    state = F.when((t == 1) & (F.col("first_t") == 0) & (F.col("first_q") == 1), "restore").when(t == 1, "exclude").when(q == 0, "unknown").otherwise("retain")
    return rows.select("doc_id", origin.alias("origin"), state.alias("disposition"))


@query("""WITH u AS (SELECT DISTINCT client_id, source FROM clients), s AS (SELECT DISTINCT * FROM sales),
g AS (SELECT u.source, u.client_id, count(s.sale_id) AS n, count(s.total) AS known, sum(s.total) AS cost FROM u LEFT JOIN s ON s.client_id = u.client_id GROUP BY ALL)
SELECT source, count(*) AS n_units, count(*) FILTER (n = 0) AS n_without_evidence, CAST(sum(n) AS BIGINT) AS n_requests, CAST(sum(n - known) AS BIGINT) AS n_unknown_cost, round(sum(cost), 2) AS cost, round(sum(cost) / nullif(sum(known), 0), 4) AS mean_cost FROM g GROUP BY 1""")
def condition_costs(spark: SparkSession, d: str) -> DataFrame:
    """Costs by condition: clients of each source as units, their sales as requests; units without any, and unknown costs, are counted, not dropped."""
    units = table(spark, d, "clients").select("client_id", "source").distinct()
    sums = table(spark, d, "sales").distinct().filter("client_id is not null").groupBy("client_id").agg(F.count("sale_id").alias("n"), F.count("total").alias("known"), F.sum("total").alias("cost"))
    rows = units.join(sums, "client_id", "left").fillna(0, ["n", "known"])
    whole = rows.groupBy("source").agg(F.count("*").alias("n_units"), F.count_if(F.col("n") == 0).alias("n_without_evidence"), F.sum("n").alias("n_requests"), F.sum(F.col("n") - F.col("known")).alias("n_unknown_cost"), F.sum("cost").alias("c"), F.sum("known").alias("k"))
    return whole.select("source", "n_units", "n_without_evidence", "n_requests", "n_unknown_cost", F.round("c", 2).alias("cost"), F.round(F.col("c") / F.when(F.col("k") > 0, F.col("k")), 4).alias("mean_cost"))


@query("""SELECT source, coalesce(status, 'none') AS status, count(*) AS n, count(DISTINCT c.client_id) AS n_units FROM (SELECT DISTINCT client_id, source FROM clients) c LEFT JOIN (SELECT DISTINCT * FROM sales) s ON s.client_id = c.client_id GROUP BY ALL""")
def condition_statuses(spark: SparkSession, d: str) -> DataFrame:
    """The histogram of statuses by condition; units without requests have status `none`."""
    units = table(spark, d, "clients").select("client_id", "source").distinct()
    rows = units.join(table(spark, d, "sales").distinct().select("client_id", "status"), "client_id", "left")
    return rows.groupBy("source", F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"), F.count_distinct("client_id").alias("n_units"))
