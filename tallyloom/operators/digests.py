"""Fingerprints that add up: of every prefix of a history, and of ranges of a stored selection's keys.

A row's print is two 60-bit parts of the SHA-256 of its place and content. Sums of prints tell sets of rows apart, need no
order, and add up over parts: a prefix's print is a running sum, a range's is the sum of its parts, and a key that holds a
large part of all rows is summed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import checkpoint_folder
from ..sources.tables import table
from .order import running_sums

#: Bits of keys of a leaf's range, and of each level above; differing leaves whose bounds are sent to the scan at most.
LEAF_BITS, LEVEL_BITS, MOST_RANGES = 8, 6, 256
#: Most differing nodes that are broadcast; nodes of two trees that are compared without looking at those above them.
BROADCAST_NODES, FEW_NODES = 500_000, 10_000


def content_text(*columns: Column) -> Column:
    """One text for a row's values, in which null differs from every text."""
    text = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.concat(*map(text, columns))


def prints(text: Column) -> tuple[Column, Column]:
    digest = F.sha2(text, 256)
    part = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("decimal(20,0)")
    return part(1), part(16)


def prefix_prints(events: DataFrame, key: str, place: str, content: Column) -> DataFrame:
    """(key, place, print): of each event the print of its history up to and with it. Places are unique within a key."""
    a, b = prints(F.concat_ws("|", F.col(place).cast("string"), content))
    rows = events.select(key, place, a.alias("_a"), b.alias("_b"))
    sums = running_sums(running_sums(rows, key, [place], "_a", "_sa"), key, [place], "_b", "_sb")
    return sums.select(key, place, F.concat_ws(":", F.col("_sa").cast("string"), F.col("_sb").cast("string")).alias("print"))


def first_mismatches(events: DataFrame, recorded: DataFrame, key: str, place: str, content: Column) -> DataFrame:
    """(key, place, reason) of every key whose recorded prints (key, place, print) aren't those of its events: the first place that differs.

    `missing_event`: recorded, but no such event; `extra_event`: never recorded; `changed`: another content. A key that is only
    on one side differs at its first place.
    """
    now = prefix_prints(events, key, place, content).withColumnRenamed("print", "now")
    both = now.join(recorded.select(key, place, F.col("print").alias("then")), [key, place], "full")
    reason = F.when(F.col("now").isNull(), "missing_event").when(F.col("then").isNull(), "extra_event").when(F.col("now") != F.col("then"), "changed")
    found = both.withColumn("reason", reason).filter("reason is not null").groupBy(key).agg(F.min(F.struct(place, "reason")).alias("f"))
    return found.select(key, F.col(f"f.{place}").alias(place), "f.reason")


_TURN = "sha256(coalesce('+' || role, '-') || chr(31) || coalesce('+' || text, '-'))"


@query(f"""WITH p AS (SELECT conv_id, turn, string_agg(turn || {_TURN}, ',') OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
g AS (SELECT p, turn, count(*) AS n, min(conv_id) AS first_conv FROM p GROUP BY ALL), x AS (SELECT conv_id, turn, n > 1 AS shared, first_conv FROM p JOIN g USING (p, turn))
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (shared) AS n_shared, arg_max(first_conv, turn) FILTER (shared) AS first_conv FROM x GROUP BY 1""")
def shared_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """How many leading turns each conversation shares with another one, word by word, and the first conversation that begins so."""
    turns = table(spark, d, "conversations")
    found = prefix_prints(turns, "conv_id", "turn", content_text(F.col("role"), F.col("text"))).checkpoint()
    groups = found.groupBy("print", "turn").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))
    rows = found.join(groups, ["print", "turn"])
    shared = F.col("n") > 1
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(shared).alias("n_shared"), F.max_by("first_conv", F.when(shared, F.col("turn"))).alias("first_conv"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS later, count(*) OVER (PARTITION BY conv_id) AS n, min(turn) OVER (PARTITION BY conv_id) AS t0, max(turn) OVER (PARTITION BY conv_id) AS t1 FROM conversations),
bad AS (SELECT conv_id, turn, 'changed' AS reason FROM t WHERE text <> trim(text, ' ') UNION ALL SELECT conv_id, turn, 'missing_event' FROM t WHERE role = 'assistant' AND turn = t1)
SELECT conv_id, min(turn) AS turn, arg_min(reason, turn) AS reason FROM bad GROUP BY 1""")
def transcript_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts as recorded against a cleaned copy, whose texts are trimmed and which lacks a last answer: the first turn that differs."""
    turns = table(spark, d, "conversations")
    content = content_text(F.col("role"), F.col("text"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("end"))
    clean = turns.join(last, "conv_id").filter("NOT (role = 'assistant' AND turn = end)").select("conv_id", "turn", "role", F.trim("text").alias("text"))
    return first_mismatches(clean, prefix_prints(turns, "conv_id", "turn", content), "conv_id", "turn", content)


def range_tree(rows: DataFrame, key: str, content: Column, levels: int = 10) -> DataFrame:
    """(level, node, n, a, b): the prints of ranges of a whole-number key: 2**8 keys a leaf, 64 nodes a node of the next level.

    A small table to be stored beside the rows, one node for each leaf range that has rows and those above it. Null keys are
    a range of their own.
    """
    a, b = prints(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("-")), content))
    node = F.shiftright(F.col(key).cast("bigint"), LEAF_BITS)
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("a", "b")]
    level = rows.select(F.lit(0).alias("level"), node.alias("node"), a.alias("a"), b.alias("b")).groupBy("level", "node").agg(F.count("*").alias("n"), *sums)
    level = level.checkpoint()
    tree = level
    for k in range(1, levels):
        level = level.select(F.lit(k).alias("level"), F.shiftright("node", LEVEL_BITS).alias("node"), "n", "a", "b").groupBy("level", "node").agg(F.sum("n").alias("n"), *sums)
        tree = tree.unionByName(level)
    return tree


def differing_ranges(left: DataFrame, right: DataFrame, levels: int = 10) -> DataFrame:
    """(node): the leaf ranges in which two stored trees differ, found from the lowest level of few nodes down: below equal nodes nothing is read."""
    above = None
    sizes = {r["level"]: r["count"] for r in left.select("level").union(right.select("level")).groupBy("level").count().collect()}  # a row a level
    top = next((k for k in range(levels) if sizes.get(k, 0) <= FEW_NODES), levels - 1)
    for k in reversed(range(top + 1)):
        x, y = (t.filter(F.col("level") == k).select("node", *(F.col(c).alias(f"{c}_{s}") for c in ("n", "a", "b"))) for t, s in ((left, "x"), (right, "y")))
        if above is not None:
            few = F.broadcast(above) if above.count() <= BROADCAST_NODES else above
            inside = lambda t: t.withColumn("above", F.shiftright("node", LEVEL_BITS)).join(few, F.col("above").eqNullSafe(F.col("parent")), "left_semi").drop("above")
            x, y = inside(x), inside(y)
        both = x.withColumnRenamed("node", "node_x").join(y.withColumnRenamed("node", "node_y"), F.col("node_x").eqNullSafe(F.col("node_y")) & F.col("n_y").isNotNull() & F.col("n_x").isNotNull(), "full")
        same = F.coalesce((F.col("n_x") == F.col("n_y")) & (F.col("a_x") == F.col("a_y")) & (F.col("b_x") == F.col("b_y")), F.lit(False))
        differ = both.filter(~same).select(F.when(F.col("n_x").isNotNull(), F.col("node_x")).otherwise(F.col("node_y")).alias("parent")).distinct()
        above = differ.checkpoint()
        if above.isEmpty():
            break
    return above.withColumnRenamed("parent", "node")


def differing_rows(left: DataFrame, right: DataFrame, key: str, content: Column, left_tree: DataFrame | None = None, right_tree: DataFrame | None = None) -> DataFrame:
    """(key, state) of the keys whose rows differ between two tables: only_left, only_right, or changed; a key's equal rows count.

    The trees are those that were stored with the tables, else made here. Only rows of ranges that differ are compared; the
    ranges' bounds are sent to the scans where there are few.
    """
    checkpoint_folder(left.sparkSession)
    trees = [range_tree(t, key, content) if made is None else made for t, made in ((left, left_tree), (right, right_tree))]
    ranges = differing_ranges(*trees).checkpoint()
    n = ranges.count()
    part = lambda t: F.shiftright(F.col(key).cast("bigint"), LEAF_BITS)

    def near(t: DataFrame) -> DataFrame:
        if n <= MOST_RANGES:  # as many at most are read by the driver
            nodes = [r["node"] for r in ranges.collect()]
            holds = F.lit(False)
            for node in nodes:
                holds = holds | (F.col(key).isNull() if node is None else F.col(key).between(node << LEAF_BITS, ((node + 1) << LEAF_BITS) - 1))
            return t.filter(F.coalesce(holds, F.lit(False)))
        few = F.broadcast(ranges) if n <= BROADCAST_NODES else ranges
        return t.withColumn("_part", part(t)).join(few, F.col("_part").eqNullSafe(F.col("node")), "left_semi").drop("_part")

    def own(t: DataFrame, side: str) -> DataFrame:
        a, b = prints(content)
        return near(t).select(F.col(key).alias(f"k_{side}"), a.alias("a"), b.alias("b")).groupBy(f"k_{side}").agg(F.count("*").alias(f"n_{side}"), F.sum("a").alias(f"a_{side}"), F.sum("b").alias(f"b_{side}"))

    both = own(left, "x").join(own(right, "y"), F.col("k_x").eqNullSafe(F.col("k_y")), "full")
    same = (F.col("n_x") == F.col("n_y")) & (F.col("a_x") == F.col("a_y")) & (F.col("b_x") == F.col("b_y"))
    state = F.when(F.col("n_x").isNull(), "only_right").when(F.col("n_y").isNull(), "only_left").when(~same, "changed")
    return both.select(F.coalesce("k_x", "k_y").alias(key), state.alias("state")).filter("state is not null")


@query("""WITH c AS (SELECT client_id, arg_max(segment, (updated_at, source)) AS segment, arg_max(city, (updated_at, source)) AS city FROM (SELECT client_id, updated_at, source, coalesce('+' || segment, '-') AS segment, coalesce('+' || city, '-') AS city FROM clients WHERE client_id IS NOT NULL AND updated_at IS NOT NULL AND source IS NOT NULL) GROUP BY 1),
h AS (SELECT client_id, arg_max(op, (seq, change_id)) AS op, arg_max(segment, (seq, change_id)) AS segment, arg_max(city, (seq, change_id)) AS city FROM (SELECT client_id, seq, change_id, coalesce(op, '-') AS op, coalesce('+' || segment, '-') AS segment, coalesce('+' || city, '-') AS city FROM client_changes WHERE client_id IS NOT NULL AND seq IS NOT NULL AND change_id IS NOT NULL) GROUP BY 1)
SELECT coalesce(c.client_id, h.client_id) AS client_id, CASE WHEN c.client_id IS NULL THEN 'only_right' WHEN h.client_id IS NULL THEN 'only_left' ELSE 'changed' END AS state FROM c FULL JOIN (SELECT * FROM h WHERE op <> 'D') h ON c.client_id = h.client_id WHERE c.client_id IS NULL OR h.client_id IS NULL OR c.segment <> h.segment OR c.city <> h.city""")
def rebuilt_clients(spark: SparkSession, d: str) -> DataFrame:
    """Clients as stored against clients rebuilt from their changes, by the digest trees of both: the rows that differ."""
    known = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    latest = lambda c, *by: F.max_by(F.col(c), F.struct(*by)).alias(c)
    rows = table(spark, d, "clients").filter("client_id is not null and updated_at is not null and source is not null").withColumns({c: known(F.col(c)) for c in ("segment", "city")})
    stored = rows.groupBy("client_id").agg(latest("segment", "updated_at", "source"), latest("city", "updated_at", "source"))
    changes = table(spark, d, "client_changes").filter("client_id is not null and seq is not null and change_id is not null").withColumns({c: known(F.col(c)) for c in ("segment", "city")})
    made = changes.groupBy("client_id").agg(F.max_by(F.coalesce("op", F.lit("-")), F.struct("seq", "change_id")).alias("op"), latest("segment", "seq", "change_id"), latest("city", "seq", "change_id")).filter("op <> 'D'")
    return differing_rows(stored, made, "client_id", content_text(F.col("segment"), F.col("city")))
