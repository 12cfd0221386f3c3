"""Connected groups, hash splits, isolation checks and quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..session import checkpoint_folder, ship_package
from ..sources.tables import table
from .corpus import _PAIRS, _TEMPLATE, SimilarSets, met_by


def first_owner_edges(keys: DataFrame) -> DataFrame:
    """(x, y) for each member of a key but its first: as many edges as rows, however large a key's group."""
    owner = keys.groupBy("key").agg(F.min("doc_id").alias("x"))
    return keys.join(owner, "key").filter("doc_id > x").select("x", F.col("doc_id").alias("y")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest id reachable. Star contraction with a checkpoint each round, until no root has an edge
    of its own and no node two; not one row collected."""
    checkpoint_folder(nodes.sparkSession)
    now = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u > v").distinct().checkpoint()
    while True:
        ways = now.union(now.select("v", "u"))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        now = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", "m")).filter("u > v").distinct().checkpoint()
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty():
            break
    return nodes.join(now.select(F.col("u").alias("doc_id"), "v"), "doc_id", "left").select("doc_id", F.coalesce("v", "doc_id").alias("component"))


def near_groups(docs: DataFrame, sets: SimilarSets | None = None) -> DataFrame:
    """(doc_id, component) over near-duplicate links, copies included by their class.

    First each set is held against the first set of each of its rare shingles, which merges a large group of variants by as
    many links as it has members; then only pairs of different components are left to form.
    """
    sets = sets or SimilarSets(docs)
    owner = sets.rare.groupBy("s").agg(F.min(F.struct("doc_id", "n", "left")).alias("o"))
    firsts = sets.rare.join(owner, "s").filter("doc_id > o.doc_id").select(F.col("o.doc_id").alias("x"), F.col("doc_id").alias("y")).distinct()
    links = sets.confirmed(firsts).select("x", "y").checkpoint()
    merged = components(sets.sets.select("doc_id"), links)
    rows = sets.rare.join(merged, "doc_id")
    mixed = rows.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("s")
    more = sets.confirmed(sets.candidates(rows.join(mixed, "s"), "component <> small_component")).select("x", "y")
    copies = sets.classes.filter("doc_id <> rep").select(F.col("rep").alias("x"), F.col("doc_id").alias("y"))
    return components(docs.select("doc_id"), links.union(more).union(copies))


_GROUPS = _PAIRS + """, way AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near), reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT way.y, reach.root FROM reach JOIN way ON way.x = reach.doc_id WHERE reach.root < way.y), grp AS (SELECT doc_id, min(root) AS component FROM reach GROUP BY 1)"""


def _u(domain: str, col: str) -> str:
    return f"CAST(CAST('0x' || substr(sha256('[\"{domain}\",17,\"' || CAST({col} AS VARCHAR) || '\"]'), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"


def _split_sql(col: str) -> str:
    return f"CASE WHEN {_u('ood', col)} < 0.1 THEN 'ood_test' WHEN {_u('split', col)} < 0.8 THEN 'train' WHEN {_u('split', col)} < 0.9 THEN 'validation' ELSE 'test' END"


@query("SELECT source AS key, min(doc_id) AS first_doc, count(*) - 1 AS n_edges FROM documents GROUP BY 1")
def shared_key_edges(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "documents").select("doc_id", F.col("source").alias("key"))
    edges = first_owner_edges(keys).groupBy("x").agg(F.count("*").alias("n_edges"))
    return keys.groupBy("key").agg(F.min("doc_id").alias("first_doc")).join(edges, F.col("first_doc") == F.col("x"), "left").select("key", "first_doc", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query(f"WITH RECURSIVE {_GROUPS} SELECT doc_id, component FROM grp")
def connected_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_groups(table(spark, d, "documents"))


@query(f"SELECT doc_id, {_split_sql('doc_id')} AS split FROM documents")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.hash_split(F.col("doc_id"), 17, 0.1).alias("split"))


@query(f"WITH RECURSIVE {_GROUPS} SELECT {_split_sql('component')} AS split, count(*) AS n_documents, count(DISTINCT component) AS n_groups, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM grp JOIN documents USING (doc_id) GROUP BY 1")
def leakage_free_split_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents in connected groups, whole groups dealt to splits by hash, and what each split holds."""
    docs = table(spark, d, "documents")
    dealt = near_groups(docs).join(docs.select("doc_id", "n_chars"), "doc_id").withColumn("split", T.hash_split(F.col("component"), 17, 0.1))
    return dealt.groupBy("split").agg(F.count("*").alias("n_documents"), F.count_distinct("component").alias("n_groups"), F.sum("n_chars").alias("n_chars"))


@query(f"WITH RECURSIVE {_GROUPS}, s AS (SELECT doc_id, component, CASE WHEN lang = 'es' THEN {_split_sql('doc_id')} ELSE {_split_sql('component')} END AS split FROM grp JOIN documents USING (doc_id)) SELECT component, count(DISTINCT split) AS n_splits, count(*) AS n_documents FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def isolation_violations(spark: SparkSession, d: str) -> DataFrame:
    """Components whose documents are in more than one split, of an assignment that deals Spanish documents one by one."""
    docs = table(spark, d, "documents")
    split = T.hash_split(F.when(F.col("lang") == "es", F.col("doc_id")).otherwise(F.col("component")), 17, 0.1)
    dealt = near_groups(docs).join(docs.select("doc_id", "lang"), "doc_id").withColumn("split", split)
    return dealt.groupBy("component").agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n_documents")).filter("n_splits > 1")


@query(rf"WITH t AS (SELECT doc_id, source, sha256({_TEMPLATE}) AS k FROM documents), b AS (SELECT k FROM t GROUP BY 1 HAVING count(DISTINCT source) > 1) SELECT doc_id, k AS template_sha256 FROM t WHERE k IN (SELECT k FROM b)")
def bridge_guard(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(T.template(F.col("text")), 256).alias("template_sha256"))
    bad = docs.groupBy("template_sha256").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).filter("lo < hi").select("template_sha256")
    return docs.join(bad, "template_sha256", "left_semi").select("doc_id", "template_sha256")


_ITEMS = r"""bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z_]+|[㐀-鿿]|\p{L}+') AS w FROM benchmark), bs AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM bw WHERE len(w) >= 8)), bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1), met AS (SELECT doc_id, item_id, count(*) AS m FROM sh JOIN bs USING (s) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_GROUPS}, {_ITEMS}, q AS (SELECT DISTINCT component FROM grp JOIN met USING (doc_id) JOIN bn USING (item_id) WHERE 2 * m >= n) SELECT doc_id, component FROM grp WHERE component IN (SELECT component FROM q)")
def component_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Documents linked, however far, with a benchmark item: the whole component of each document that holds half of an item's shingles."""
    docs = table(spark, d, "documents")
    groups = near_groups(docs)
    held = met_by(docs, table(spark, d, "benchmark")).filter("2 * m >= n").select("doc_id").distinct()
    touched = groups.join(held, "doc_id", "left_semi").select("component").distinct()
    return groups.join(touched, "component", "left_semi").select("doc_id", "component")


@query()
def template_bridges(spark: SparkSession, d: str) -> DataFrame:
    """All documents, of any script, whose task template is in more than one source: (doc_id, template_sha256)."""
    ship_package(spark)
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(T.task_template(F.col("text")), 256).alias("template_sha256"))
    bad = docs.groupBy("template_sha256").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).filter("lo < hi").select("template_sha256")
    return docs.join(bad, "template_sha256", "left_semi").select("doc_id", "template_sha256")
