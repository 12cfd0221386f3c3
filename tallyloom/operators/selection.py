"""Selection without refilling: hash ranks, buckets, samplers, quotas, quarantine views, deltas and review gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.tables import table
from .digests import prints


def _rank(col: str, domain: str = "select") -> str:
    return f"sha256('[\"{domain}\",42,\"' || CAST({col} AS VARCHAR) || '\"]')"


def ranked(docs: DataFrame, domain: str = "select") -> DataFrame:
    return docs.withColumn("rank_key", T.rank_key(domain, 42, F.col("doc_id")))


def first_of_strata(docs: DataFrame, strata: list[str], fill: int) -> DataFrame:
    """The first of each stratum by rank key, and then the next rows over all until `fill` are chosen."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("rank_key", "doc_id"))
    cover = docs.withColumn("p", place).filter("p = 1").drop("p").withColumn("phase", F.lit("cover"))
    rest = docs.join(cover.select("doc_id"), "doc_id", "left_anti")
    more = max(0, fill - cover.count())
    return cover.unionByName(rest.orderBy("rank_key", "doc_id").limit(more).withColumn("phase", F.lit("fill")))


@query(f"SELECT doc_id, {_rank('doc_id')} AS rank_key FROM documents ORDER BY 2, 1 LIMIT 50")
def hash_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranked(table(spark, d, "documents").select("doc_id")).orderBy("rank_key", "doc_id").limit(50)


@query("SELECT doc_id, CASE WHEN n_chars <= 1536 THEN 1536 WHEN n_chars <= 2048 THEN 2048 WHEN n_chars <= 4096 THEN 4096 END::BIGINT AS bucket FROM documents")
def padding_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.smallest_bucket(F.col("n_chars"), [1536, 2048, 4096]).alias("bucket"))


@query("SELECT doc_id, CASE WHEN lang IS NULL THEN 'unmeasured' WHEN n_chars > 8192 THEN 'over_limit' WHEN row_number() OVER (PARTITION BY text, (lang IS NOT NULL AND n_chars <= 8192) ORDER BY doc_id) > 1 THEN 'duplicate' END AS reason FROM documents")
def exclusion_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first reason that applies; copies count only among rows that no earlier reason excludes."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", T.text_hash(F.col("text")).alias("h"))
    docs = docs.withColumn("early", F.when(F.col("lang").isNull(), "unmeasured").when(F.col("n_chars") > 8192, "over_limit"))
    place = F.row_number().over(Window.partitionBy("h", F.col("early").isNull()).orderBy("doc_id"))
    return docs.select("doc_id", F.coalesce("early", F.when(place > 1, "duplicate")).alias("reason"))


_REASONS = "SELECT doc_id, list_sort(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 4096 THEN 'long' END, CASE WHEN contains(text, '%%%') THEN 'symbols' END, CASE WHEN contains(text, '@') THEN 'contact' END], lambda x: x IS NOT NULL)) AS reasons FROM documents"


@query(f"WITH r AS ({_REASONS}) SELECT 'primary' AS kind, reasons[1] AS reason, count(*) AS n FROM r WHERE len(reasons) > 0 GROUP BY ALL UNION ALL SELECT 'overlapping', reason, count(*) FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY ALL")
def primary_vs_overlapping(spark: SparkSession, d: str) -> DataFrame:
    flags = {"short": F.col("n_chars") < 200, "long": F.col("n_chars") > 4096, "symbols": F.col("text").contains("%%%"), "contact": F.col("text").contains("@")}
    rows = table(spark, d, "documents").select(F.array_sort(F.array_compact(F.array(*(F.when(c, n) for n, c in flags.items())))).alias("r")).filter("size(r) > 0")
    first = rows.groupBy(F.col("r")[0].alias("reason")).agg(F.count("*").alias("n")).select(F.lit("primary").alias("kind"), "reason", "n")
    return first.union(rows.select(F.explode("r").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("overlapping"), "reason", "n"))


_SELECT = f"SELECT doc_id, source, {_rank('doc_id')} AS k FROM documents WHERE n_chars <= 2048"


def selection(docs: DataFrame) -> DataFrame:
    chosen = ranked(docs.filter("n_chars <= 2048").select("doc_id", "source"))
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("rank_key", "doc_id")).cast("bigint"))


@query(f"WITH s AS ({_SELECT}), p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS parent_rank FROM s) SELECT doc_id, source, parent_rank, row_number() OVER (PARTITION BY source ORDER BY parent_rank) AS new_rank FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def rerank_no_refill(spark: SparkSession, d: str) -> DataFrame:
    """Survivors are ranked anew beside their parent rank; nothing is promoted from outside the selection. Ranks are per source."""
    bad = table(spark, d, "labels").filter("quality = 0").select("doc_id")
    left = selection(table(spark, d, "documents")).join(bad, "doc_id", "left_anti").withColumnRenamed("place", "parent_rank")
    new = F.row_number().over(Window.partitionBy("source").orderBy("parent_rank")).cast("bigint")
    return left.select("doc_id", "source", "parent_rank", new.alias("new_rank"))


@query(f"WITH c AS (SELECT doc_id, lang, source, {_rank('doc_id')} AS k FROM documents), f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY lang, source ORDER BY k, doc_id) AS p FROM c), cov AS (SELECT doc_id FROM f WHERE p = 1) SELECT doc_id, 'cover' AS phase FROM cov UNION ALL SELECT doc_id, 'fill' FROM (SELECT doc_id FROM c WHERE doc_id NOT IN (SELECT doc_id FROM cov) ORDER BY k, doc_id LIMIT (SELECT greatest(0, 150 - count(*)) FROM cov))")
def strata_cover_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = ranked(table(spark, d, "documents").select("doc_id", "lang", "source"))
    return first_of_strata(docs, ["lang", "source"], 150).select("doc_id", "phase")


def phased(docs: DataFrame, phases: list[tuple[str, Column, int]]) -> DataFrame:
    """Phase by phase, the first rows by rank that satisfy its condition and weren't chosen before. One small step each."""
    chosen = None
    for name, condition, size in phases:
        pool = docs.filter(condition)
        pool = pool if chosen is None else pool.join(chosen.select("doc_id"), "doc_id", "left_anti")
        part = pool.orderBy("rank_key", "doc_id").limit(size).select("doc_id", F.lit(name).alias("phase"))
        chosen = part if chosen is None else chosen.union(part)
    return chosen


@query(f"WITH c AS (SELECT doc_id, n_chars, lang, {_rank('doc_id')} AS k FROM documents), a AS (SELECT doc_id FROM c WHERE n_chars <= 1024 ORDER BY k, doc_id LIMIT 96), b AS (SELECT doc_id FROM c WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY k, doc_id LIMIT 24), e AS (SELECT doc_id FROM c WHERE n_chars > 4096 AND doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b) ORDER BY k, doc_id LIMIT 10) SELECT doc_id, 'train' AS phase FROM a UNION ALL SELECT doc_id, 'validation' FROM b UNION ALL SELECT doc_id, 'long' FROM e")
def phased_sampler(spark: SparkSession, d: str) -> DataFrame:
    docs = ranked(table(spark, d, "documents").select("doc_id", "n_chars", "lang"))
    return phased(docs, [("train", F.col("n_chars") <= 1024, 96), ("validation", F.col("lang") == "en", 24), ("long", F.col("n_chars") > 4096, 10)])


def quotas(counts: dict, total: int) -> dict:
    """Places per class: one each, then floors of the proportional share, then what is left in class order."""
    everything = sum(counts.values())
    out = {c: min(n, max(1, total * n // everything)) for c, n in counts.items()}
    for c in sorted(counts):
        out[c] += max(0, min(total - sum(out.values()), counts[c] - out[c]))
    return out


@query(f"WITH l AS (SELECT doc_id, quality, {_rank('doc_id')} AS k FROM labels), c AS (SELECT quality, count(*) AS n, (SELECT count(*) FROM l) AS al FROM l GROUP BY 1), s AS (SELECT *, least(al, greatest(100, CAST(ceil(al / 10.0) AS BIGINT))) AS want FROM c), q AS (SELECT quality, n, want, least(n, greatest(1, want * n // al)) AS base FROM s), r AS (SELECT quality, base + greatest(0, least(n - base, want - (SELECT sum(base) FROM q) - coalesce(sum(n - base) OVER (ORDER BY quality ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM q), o AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY k, doc_id) AS p FROM l) SELECT doc_id, quality FROM o JOIN r USING (quality) WHERE p <= quota")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality")
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}  # a row for each class
    n = sum(counts.values())
    want = quotas(counts, min(n, max(100, -(-n // 10))))
    place = F.row_number().over(Window.partitionBy("quality").orderBy("rank_key", "doc_id"))
    limit = F.create_map(*(F.lit(x) for kv in want.items() for x in kv))
    return ranked(labels).withColumn("p", place).filter(F.col("p") <= limit[F.col("quality")]).select("doc_id", "quality")


@query(f"SELECT doc_id, n_chars, row_number() OVER (ORDER BY {_rank('doc_id')}, doc_id) AS place FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20)")
def capacity_topk(spark: SparkSession, d: str) -> DataFrame:
    top = ranked(table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20))
    return top.select("doc_id", "n_chars", F.row_number().over(Window.orderBy("rank_key", "doc_id")).cast("bigint").alias("place"))


@query("WITH f AS (SELECT source, min(d.doc_id) AS first_bad FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1 GROUP BY 1) SELECT d.doc_id, CASE WHEN f.first_bad IS NULL THEN NULL WHEN d.doc_id = f.first_bad THEN 'flagged_target' WHEN d.doc_id < f.first_bad THEN 'preceding' ELSE 'other' END AS reason FROM documents d LEFT JOIN f ON d.source = f.source")
def revise_view(spark: SparkSession, d: str) -> DataFrame:
    """A source with a flagged row goes whole; the reason says how each row stands to the first flagged one."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    bad = docs.join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.min("doc_id").alias("first_bad"))
    reason = F.when(F.col("doc_id") == F.col("first_bad"), "flagged_target").when(F.col("doc_id") < F.col("first_bad"), "preceding").when(F.col("first_bad").isNotNull(), "other")
    return docs.join(bad, "source", "left").select("doc_id", reason.alias("reason"))


@query("SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'exclude' WHEN quality = 0 THEN 'unknown' ELSE 'retain' END AS disposition, l.doc_id IS NOT NULL AS reviewed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def adjudicated_view(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").withColumn("reviewed", F.lit(True))
    disposition = F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 0, "unknown").otherwise("retain")
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", disposition.alias("disposition"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"))


@query("WITH a AS (SELECT doc_id FROM documents WHERE n_chars <= 1024), b AS (SELECT doc_id FROM documents WHERE n_chars BETWEEN 512 AND 2048) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'restored' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'retained' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def revision_delta(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a = docs.filter("n_chars <= 1024").select("doc_id", F.lit(1).alias("a"))
    b = docs.filter("n_chars between 512 and 2048").select("doc_id", F.lit(1).alias("b"))
    change = F.when(F.col("a").isNull(), "restored").when(F.col("b").isNull(), "removed").otherwise("retained")
    return a.join(b, "doc_id", "full").select("doc_id", change.alias("change"))


@query("WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id, CASE WHEN lang = 'es' THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE n_chars <= 4096), c AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE n_chars <= 2048 OR lang = 'fr') SELECT c.doc_id, CASE WHEN b.doc_id IS NULL THEN 'no_parent' WHEN b.h <> c.h THEN 'changed' WHEN a.h <> b.h THEN 'parent_changed' ELSE 'same' END AS link FROM c LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)")
def three_generation_link(spark: SparkSession, d: str) -> DataFrame:
    """The current rows against the previous and the original generation, by the digest of their text; the previous one has some changed."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "text")
    first = docs.select("doc_id", T.text_hash(F.col("text")).alias("a"))
    second = docs.filter("n_chars <= 4096").select("doc_id", T.text_hash(F.when(F.col("lang") == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("b"))
    third = docs.filter("n_chars <= 2048 or lang = 'fr'").select("doc_id", T.text_hash(F.col("text")).alias("c"))
    link = F.when(F.col("b").isNull(), "no_parent").when(F.col("b") != F.col("c"), "changed").when(F.col("a") != F.col("b"), "parent_changed").otherwise("same")
    return third.join(second, "doc_id", "left").join(first, "doc_id", "left").select("doc_id", link.alias("link"))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 0) AS n_errors, 20 * count(*) FILTER (quality = 0) > count(*) AS blocked FROM labels")
def review_gate(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("n_errors"))
    return counted.withColumn("blocked", F.col("n_errors") * 20 > F.col("n"))


@query("SELECT source, ['pass', 'unknown', 'fail'][max(CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 ELSE 1 END)] AS verdict FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def worst_verdict(spark: SparkSession, d: str) -> DataFrame:
    order = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).otherwise(1)
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.element_at(F.array(*map(F.lit, ("pass", "unknown", "fail"))), F.max(order)).alias("verdict"))


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents")
def microbatches(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", "source", F.floor((place - 1) / 8).alias("batch"))


@query("""WITH r AS (SELECT sha256(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(CAST(quality AS VARCHAR), '-') || '|' || coalesce(CAST(toxic AS VARCHAR), '-')) AS h FROM labels)
SELECT sha256(count(*) || ':' || sum(CAST(CAST('0x' || substr(h, 1, 15) AS UBIGINT) AS HUGEINT)) || ':' || sum(CAST(CAST('0x' || substr(h, 16, 15) AS UBIGINT) AS HUGEINT))) AS fingerprint, count(*) AS n FROM r""")
def selection_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One digest of a selection's rows, whatever their order and however many: of their number and of the sums of their prints."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    a, b = prints(F.concat_ws("|", text("doc_id"), text("quality"), text("toxic")))
    sums = table(spark, d, "labels").agg(F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"))
    return sums.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("fingerprint"), "n")
