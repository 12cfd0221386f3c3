"""Isolation of documents from a benchmark: components that grow by new links, audits with a witness path, whole-group selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..session import checkpoint_folder
from ..sources.tables import table
from .corpus import _TEMPLATE, SimilarSets, met_by
from .groups import _GROUPS, _ITEMS, components, first_owner_edges, near_groups
from .order import running_sums

#: Most rows of changed labels that are broadcast.
BROADCAST_CHANGES = 1_000_000


def merged_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, component) after links (x, y) have come to stored labels (doc_id, component), components being their smallest ids.

    The links are lifted to the components they touch; only those are contracted, and only rows of components that change get
    another label. Nodes that have no label yet are their own. Links whose ends are one component already change nothing.
    """
    checkpoint_folder(labels.sparkSession)
    ends = links.select("x").union(links.select("y")).distinct().withColumnRenamed("x", "doc_id")
    new = ends.join(labels, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("component"))
    known = labels.unionByName(new)
    touched = ends.join(known, "doc_id").checkpoint()
    lift = lambda c: touched.select(F.col("doc_id").alias(c), F.col("component").alias(f"c{c}"))
    lifted = links.join(lift("x"), "x").join(lift("y"), "y").filter("cx <> cy").select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct()
    whole = touched.select(F.col("component").alias("doc_id")).distinct()
    changed = components(whole, lifted).filter("doc_id <> component").select(F.col("doc_id").alias("component"), F.col("component").alias("now")).checkpoint()
    few = changed.count() <= BROADCAST_CHANGES
    return known.join(F.broadcast(changed) if few else changed, "component", "left").select("doc_id", F.coalesce("now", "component").alias("component"))


def held_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id): the documents that hold half of an item's shingles or more."""
    return met_by(docs, benchmark).filter("2 * m >= n").select("doc_id", "item_id")


def benchmark_groups(labels: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, component, n_items): stored components of documents, joined by the items their members hold. An item's documents are one component."""
    checkpoint_folder(labels.sparkSession)
    held = held.checkpoint()
    first = held.groupBy("item_id").agg(F.min("doc_id").alias("x"))
    links = held.join(first, "item_id").filter("doc_id <> x").select("x", F.col("doc_id").alias("y")).distinct()
    grown = merged_components(labels, links).checkpoint()
    items = held.join(grown, "doc_id").groupBy("component").agg(F.count_distinct("item_id").alias("n_items"))
    return grown.join(items, "component", "left").select("doc_id", "component", F.coalesce("n_items", F.lit(0)).alias("n_items"))


_HELD = f"{_ITEMS}, held AS (SELECT doc_id, item_id FROM met JOIN bn USING (item_id) WHERE 2 * m >= n)"
_BRIDGED = _GROUPS.replace(", grp AS", f""", {_HELD}, hub AS (SELECT a.doc_id AS x, b.doc_id AS y FROM held a JOIN (SELECT item_id, min(doc_id) AS doc_id FROM held GROUP BY 1) b USING (item_id)), all_ways AS (SELECT x, y FROM way UNION ALL SELECT x, y FROM hub UNION ALL SELECT y, x FROM hub), far AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT all_ways.y, far.root FROM far JOIN all_ways ON all_ways.x = far.doc_id WHERE far.root < all_ways.y), grown AS (SELECT doc_id, min(root) AS component FROM far GROUP BY 1), grp AS""") + ", items AS (SELECT component, count(DISTINCT item_id) AS n_items FROM held JOIN grown USING (doc_id) GROUP BY 1)"


@query(f"WITH RECURSIVE {_BRIDGED} SELECT doc_id, component, coalesce(n_items, 0) AS n_items, coalesce(n_items, 0) > 0 AS overlap FROM grown LEFT JOIN items USING (component)")
def benchmark_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of all documents, excluded ones among them as bridges, and of benchmark items, which come later: only what they touch is joined anew."""
    docs = table(spark, d, "documents")
    grown = benchmark_groups(near_groups(docs), held_items(docs, table(spark, d, "benchmark")))
    return grown.withColumn("overlap", F.col("n_items") > 0)


def isolation_paths(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, distance, kind, parent, item_id, path) of every document that is linked, however far, with a benchmark item.

    A search in breadth from all items at once: at distance 1 the documents that hold half of an item (kind `held`, parent the
    smallest such item), then those similar to one reached before (kind `near`, parent the smallest). Only sets of components
    that are touched take part; a level pairs the sets reached last with those not reached yet by their rare shingles, and
    confirms the pairs. Equal sets go as one. path: the item, then documents' ids down to the row's own.
    """
    checkpoint_folder(docs.sparkSession)
    held = held_items(docs, benchmark).groupBy("doc_id").agg(F.min("item_id").alias("item_id")).checkpoint()
    sets = SimilarSets(docs)
    groups = near_groups(docs, sets)
    touched = groups.join(held.join(groups, "doc_id").select("component").distinct(), "component", "left_semi").select("doc_id")
    own = sets.sets.select("doc_id").join(touched, "doc_id").checkpoint()
    reached = own.join(held, "doc_id").select("doc_id", F.lit(1).alias("distance"), F.lit("held").alias("kind"), F.col("item_id").alias("parent"), "item_id", F.array(F.col("item_id"), F.col("doc_id")).alias("path")).checkpoint()
    rows = sets.rare.join(own, "doc_id").checkpoint()
    edge, left = reached, own.join(reached, "doc_id", "left_anti").checkpoint()
    while not edge.isEmpty() and not left.isEmpty():
        both = rows.join(edge.select("doc_id", F.lit(1).alias("side")).union(left.select("doc_id", F.lit(2))), "doc_id").checkpoint()
        # Shingles of one side only pair nothing.
        mixed = both.groupBy("s").agg(F.min("side").alias("a"), F.max("side").alias("b")).filter("a < b").select("s")
        links = sets.confirmed(sets.candidates(both.join(mixed, "s"), "side <> small_side")).select("x", "y")
        ways = links.union(links.select("y", "x"))
        parents = ways.join(edge.select(F.col("doc_id").alias("x")), "x").join(left.select(F.col("doc_id").alias("y")), "y").groupBy("y").agg(F.min("x").alias("x"))
        before = edge.select(F.col("doc_id").alias("x"), "distance", "item_id", "path")
        found = parents.join(before, "x").select(F.col("y").alias("doc_id"), (F.col("distance") + 1).alias("distance"), F.lit("near").alias("kind"), F.col("x").alias("parent"), "item_id", F.concat("path", F.array("y")).alias("path"))
        edge = found.checkpoint()
        reached = reached.unionByName(edge)
        left = left.join(edge, "doc_id", "left_anti").checkpoint()
    every = sets.classes.join(reached.withColumnRenamed("doc_id", "rep"), "rep")
    path = F.concat(F.slice("path", F.lit(1), F.size("path") - 1), F.array("doc_id"))
    return every.select("doc_id", "distance", "kind", "parent", "item_id", F.array_join(F.transform(path, lambda i: i.cast("string")), ">").alias("path"))


_KEYED = _GROUPS.replace(", grp AS", f""", tk AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({_TEMPLATE})) AS x FROM documents), kw AS (SELECT x, y FROM way UNION ALL SELECT x, doc_id FROM tk UNION ALL SELECT doc_id, x FROM tk), kr AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT kw.y, kr.root FROM kr JOIN kw ON kw.x = kr.doc_id WHERE kr.root < kw.y), keyed AS (SELECT doc_id, min(root) AS component FROM kr GROUP BY 1), grp AS""")


@query(f"WITH RECURSIVE {_KEYED} SELECT doc_id, component FROM keyed")
def keyed_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents connected by near-duplicate links and by their templates: a star from a template's first document joins the components it touches."""
    docs = table(spark, d, "documents")
    keys = docs.select("doc_id", F.sha2(T.template(F.col("text")), 256).alias("key")).filter("key is not null")
    return merged_components(near_groups(docs), first_owner_edges(keys))


@query(f"""WITH RECURSIVE {_GROUPS}, {_HELD}, start AS (SELECT doc_id, min(item_id) AS item_id FROM held GROUP BY 1),
step AS (SELECT doc_id, 1 AS distance FROM start UNION SELECT way.y, step.distance + 1 FROM step JOIN way ON way.x = step.doc_id WHERE step.distance < 25),
dist AS (SELECT doc_id, min(distance) AS distance FROM step GROUP BY 1),
up AS (SELECT c.doc_id, c.distance, min(p.doc_id) AS parent FROM dist c JOIN way ON way.y = c.doc_id JOIN dist p ON p.doc_id = way.x AND p.distance = c.distance - 1 WHERE c.distance > 1 GROUP BY ALL),
trail AS (SELECT doc_id, 1 AS distance, 'held' AS kind, item_id AS parent, item_id, item_id || '>' || doc_id AS path FROM start
  UNION ALL SELECT up.doc_id, up.distance, 'near', up.parent, trail.item_id, trail.path || '>' || up.doc_id FROM trail JOIN up ON up.parent = trail.doc_id AND up.distance = trail.distance + 1)
SELECT doc_id, distance, kind, parent, item_id, path FROM trail""")
def isolation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Why each quarantined document is quarantined: the kind of its link, how far it is from a benchmark item, and a path there."""
    return isolation_paths(table(spark, d, "documents"), table(spark, d, "benchmark"))


def group_selection(candidates: DataFrame, cap: int) -> DataFrame:
    """A ledger row for each candidate (id, category, component, place, eligible): its disposition, and the sum that decided.

    Components are taken whole, in order of the first eligible candidate's (place, id), as long as all eligible
    candidates of the category's components so far are at most `cap`. A component belongs to the category of its first eligible
    candidate. `excluded`: the candidate isn't eligible; `category_cap`: its component came too late; else `selected`.
    """
    first = candidates.filter("eligible").groupBy("component").agg(F.min(F.struct("place", "id", "category")).alias("first"), F.count("*").alias("n"))
    ordered = first.select("component", F.col("first.category").alias("of"), F.col("first.place").alias("at"), F.col("first.id").alias("by"), "n")
    sums = running_sums(ordered, "of", ["at", "by"], "n", "sum").select("component", "of", "sum")
    state = F.when(~F.col("eligible"), "excluded").when(F.col("sum") > cap, "category_cap").otherwise("selected")
    return candidates.join(sums, "component", "left").select("id", "category", "component", F.col("of").alias("group_category"), F.col("sum").alias("so_far"), state.alias("disposition"))


#: Candidates of a category; characters beyond which a candidate is no input.
CATEGORY_CAP, LONGEST = 100, 8_192

_LEDGER = f"""WITH RECURSIVE {_BRIDGED}, cand AS (SELECT doc_id AS id, lang AS category, component, sha256('["subset",17,"' || doc_id || '"]') AS place, n_chars <= {LONGEST} AND n_items IS NULL AS eligible FROM documents JOIN grown USING (doc_id) LEFT JOIN items USING (component)),
firsts AS (SELECT component, count(*) AS n, min(struct_pack(place, id, category)) AS f FROM cand WHERE eligible GROUP BY 1),
placed AS (SELECT component, f.category AS of_, n, row_number() OVER (PARTITION BY f.category ORDER BY f.place, f.id) AS i FROM firsts),
tally AS (SELECT component, of_, i, n AS total FROM placed WHERE i = 1 UNION ALL SELECT p.component, p.of_, p.i, t.total + p.n FROM tally t JOIN placed p ON p.of_ IS NOT DISTINCT FROM t.of_ AND p.i = t.i + 1)
SELECT id, category, cand.component, of_ AS group_category, CAST(total AS BIGINT) AS so_far, CASE WHEN NOT eligible THEN 'excluded' WHEN total > {CATEGORY_CAP} THEN 'category_cap' ELSE 'selected' END AS disposition FROM cand LEFT JOIN tally ON tally.component = cand.component"""


@query(_LEDGER)
def subset_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark's subset chosen without its answers: documents isolated from known items, in hash order, whole components, a cap for each language; a row for every candidate."""
    docs = table(spark, d, "documents")
    grown = benchmark_groups(near_groups(docs), held_items(docs, table(spark, d, "benchmark")))
    eligible = F.coalesce((F.col("n_chars") <= LONGEST) & (F.col("n_items") == 0), F.lit(False))
    candidates = docs.join(grown, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), "component", T.rank_key("subset", 17, F.col("doc_id")).alias("place"), eligible.alias("eligible"))
    return group_selection(candidates, CATEGORY_CAP)
