"""Merkle manifest of a dataset: mountain-range stacks over indexed partitions, merged at their edges.

Every row is a leaf, H of its named columns: lowercase hex SHA-256 of the values' encodings joined, `-` for null, else the
number of UTF-8 bytes, a colon and the value. The leaves of one tree, in order of their row id, are joined in runs of `fanout`
consecutive nodes, level by level, until one remains; the last run may be shorter, and nothing is padded. The trees' roots, in
order of their names (null first, bytewise), are the leaves of a tree of trees, whose root is the dataset's.

Rows are dealt by range of (tree, row id) and get their index in the tree: the place in the partition and the rows of the
partitions before it. A task pushes its leaves onto a stack that works like a counter to the base of the fanout: a run that
ends carries its parent to the next level. What lacks neighbours at a partition's edge is left as a peak. Peaks are merged by
(tree, level, index / fanout), level by level, a logarithmic number of small shuffles, of which no group exceeds the fanout.
Proofs go the other way: every node's siblings are passed down level by level to the runs of leaves.

Null values and ids are leaves like others (null ids first); rows that share an id are ordered by their leaf; equal rows are
leaves of their own. Empty tables have no trees and no rows. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BROADCAST_KEYS, Scratch, partitions, ship_package

_SHIFT = 33  # monotonically_increasing_id keeps the partition above this many bits


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def joined_hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Mountains:
    """The stack of one partition: levels of nodes that still wait for their run to end."""

    def __init__(self, fanout: int):
        self.fanout, self.levels = fanout, []  # of each level: its first waiting index, and the nodes from there
        self.tree = self.next = None

    def push(self, tree, index: int, node: tuple) -> Iterator[tuple]:
        """Yields (tree, level, index, digest, nodes of its run or None): a completed parent with its run, or a peak without."""
        if tree != self.tree or index != self.next:
            yield from self.peaks()
        self.tree, self.next = tree, index + 1
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([index, []])
            first, nodes = self.levels[level]
            if not nodes:
                self.levels[level][0] = first = index
            nodes.append(node)
            if (index + 1) % self.fanout:
                return
            self.levels[level] = [index + 1, []]
            if len(nodes) < self.fanout:  # the run began before this partition
                yield from self.waiting(level, first, nodes)
                return
            index, level = index // self.fanout, level + 1
            node = (joined_hash([n[0] for n in nodes]), None, None)
            yield (tree, level, index, node[0], nodes)

    def waiting(self, level: int, first: int, nodes: list) -> Iterator[tuple]:
        for k, (digest, row, altered) in enumerate(nodes):
            yield (self.tree, level, first + k, digest, [(digest, row, altered)] if level == 0 else None)

    def peaks(self) -> Iterator[tuple]:
        """What is left at the partition's end or where its indices jump."""
        for level, (first, nodes) in enumerate(self.levels):
            yield from self.waiting(level, first, nodes)
        self.levels = []


def _stack(fanout: int, schema: pa.Schema, rows: int = 4096):
    def run(batches):
        mountains, out = Mountains(fanout), []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("tree", "index", "digest", "row", "altered"))
            for tree, index, digest, row, altered in zip(*columns, strict=True):
                out += mountains.push(tree, index, (digest, row, altered))
                if len(out) >= rows:
                    yield _nodes(out, schema)
                    out = []
        yield _nodes(out + list(mountains.peaks()), schema)

    return run


def _nodes(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    keys = ("digest", "row", "altered")
    rows = [(tree, level, index, digest, nodes is None or level == 0, [dict(zip(keys, n, strict=True)) for n in nodes or ()]) for tree, level, index, digest, nodes in found]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def indexed(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows (tree, row, digest, altered) with their index in the tree, in order within tasks; and the trees' sizes.

    Only counts of (partition, tree) go by tree: as many rows as there are partitions and trees together.
    """
    order = ("tree", "row", "digest", "altered")
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = scratch.written(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", _SHIFT)), "placed")
    counts = scratch.written(placed.groupBy("part", "tree").agg(F.count("*").alias("n"), F.min("place").alias("first")), "counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", "tree", (before - F.col("first")).alias("shift"))
    if counts.count() <= BROADCAST_KEYS:
        offsets = F.broadcast(offsets)
    own = placed.join(offsets, ["part", "tree"]).select("tree", (F.col("place") + F.col("shift")).alias("index"), "digest", "row", "altered")
    return own.sortWithinPartitions("tree", "index"), counts.groupBy("tree").agg(F.sum("n").alias("n"))


def depth(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def forest(rows: DataFrame, scratch: Scratch, fanout: int = 8) -> tuple[DataFrame, DataFrame, int]:
    """All inner nodes of the trees over rows (tree, row, digest, altered): tree, level (from 1), index, digest, run (its nodes);
    the trees' roots: tree, digest, level, run (of a lone leaf, itself); and the highest level."""
    spark = rows.sparkSession
    leaves, sizes = indexed(rows, scratch)
    sizes = scratch.written(sizes, "sizes")
    kind = rows.schema["row"].dataType
    node = f"struct<digest: string, row: {kind.simpleString()}, altered: string>"
    arrow = pa.struct([("digest", pa.string()), ("row", to_arrow_type(kind)), ("altered", pa.string())])
    schema = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string()), ("peak", pa.bool_()), ("run", pa.list_(arrow))])
    found = scratch.written(leaves.mapInArrow(_stack(fanout, schema), f"tree string, level int, index long, digest string, peak boolean, run array<{node}>"), "stacked")
    # A completed node that no later run of its partition took up is a peak as well: its record comes with its run, then once more without.
    peaks, inner = found.filter("peak"), found.filter("not peak").drop("peak")
    top = depth(sizes.agg(F.max("n")).first()[0] or 0, fanout)
    merged, all_merged = None, []
    for level in range(top):
        waiting = peaks.filter(F.col("level") == level).select("tree", "index", "digest", F.element_at("run", 1).alias("node") if level == 0 else F.struct("digest", F.lit(None).cast(kind).alias("row"), F.lit(None).cast("string").alias("altered")).alias("node"))
        if merged is not None:
            waiting = waiting.unionByName(merged.select("tree", "index", "digest", F.struct("digest", F.lit(None).cast(kind).alias("row"), F.lit(None).cast("string").alias("altered")).alias("node")))
        # The root of a tree that ends here isn't joined with itself.
        waiting = waiting.join(_small(sizes.select("tree", (F.col("n") > fanout**level).alias("more"))), "tree").filter("more")
        run = F.transform(F.array_sort(F.collect_list(F.struct("index", "node"))), lambda x: x["node"])
        groups = waiting.groupBy("tree", F.floor(F.col("index") / fanout).alias("index")).agg(run.alias("run"))
        merged = groups.select("tree", F.lit(level + 1).alias("level"), "index", F.sha2(F.array_join(F.transform("run", lambda n: n["digest"]), ""), 256).alias("digest"), "run")
        all_merged.append(merged)
    for part in all_merged:
        inner = inner.unionByName(part)
    inner = scratch.written(inner, "nodes")
    ends = sizes.select("tree", *[F.lit(0).alias("level") if top == 0 else F.expr("CASE " + " ".join(f"WHEN n <= {fanout**k} THEN {k}" for k in range(top)) + f" ELSE {top} END").alias("level")])
    # An inner root has index 0 at its tree's height; a lone leaf is a peak of level 0.
    lone = peaks.filter("level = 0").join(ends.filter("level = 0"), ["tree", "level"], "left_semi").select("tree", "digest", "level", "run")
    roots = inner.join(ends, ["tree", "level"], "left_semi").select("tree", "digest", "level", "run").unionByName(lone)
    return inner, scratch.written(roots, "roots"), top


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


_PATH = "array<struct<siblings: array<string>, place: int>>"


def _step(run: Column, place: Column) -> Column:
    """A proof's step: the other nodes of a run, and how many of them stand before the node at `place`."""
    digests = F.transform(run, lambda n: n["digest"])
    others = F.concat(F.slice(digests, F.lit(1), place), F.slice(digests, place + 2, F.greatest(F.size(digests) - place - 1, F.lit(0))))
    return F.array(F.struct(others.alias("siblings"), place.alias("place")))


def _runs_with_paths(inner: DataFrame, roots: DataFrame, upper: DataFrame, top: int, fanout: int) -> DataFrame:
    """The runs of leaves, each with the path from it to the root: tree, run, lone, path. upper: each tree's path beyond its own root."""
    above = None
    for level in range(top, 0, -1):
        own = inner.filter(F.col("level") == level).select("tree", "index", "run").join(upper, "tree")
        if above is not None:
            parent = above.select("tree", F.col("index").alias("parent"), F.col("run").alias("around"), F.col("path").alias("beyond"))
            place = F.pmod(F.col("index"), F.lit(fanout)).cast("int")
            own = own.withColumn("parent", F.floor(F.col("index") / fanout)).join(parent, ["tree", "parent"], "left")
            path = F.when(F.col("around").isNull(), F.col("path")).otherwise(F.concat(_step(F.col("around"), place), "beyond"))
            own = own.select("tree", "index", "run", path.alias("path"))
        above = own
    lone = roots.filter("level = 0").select("tree", "run").join(upper, "tree").select("tree", "run", F.lit(True).alias("lone"), "path")
    return lone if above is None else above.select("tree", "run", F.lit(False).alias("lone"), "path").unionByName(lone)


def _proofs(inner: DataFrame, roots: DataFrame, upper: DataFrame, top: int, fanout: int) -> DataFrame:
    """tree, row, digest, altered, path of every leaf."""
    runs = _runs_with_paths(inner, roots, upper, top, fanout)
    each = runs.select("tree", "run", "lone", "path", F.posexplode("run").alias("place", "node"))
    path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(_step(F.col("run"), F.col("place")), "path"))
    return each.select("tree", "node.row", "node.digest", "node.altered", path.alias("path"))


def manifest(df: DataFrame, tree: str, row: str, columns: list[str], *, fanout: int = 8, altered: dict[str, Column] | None = None) -> DataFrame:
    """Every row's leaf and its proof: row, tree, leaf, altered, path, subroot, root.

    tree: the column whose values have a tree each; row: what orders leaves; columns: what a leaf is the hash of, in order.
    path: steps from the leaf's run to the dataset's root, each the siblings (left to right) and the node's place among them.
    altered: columns to put in place of others in an altered leaf; where all of them are null, or without any, it is null.
    """
    spark = df.sparkSession
    ship_package(spark)
    value = lambda c: F.col(f"`{c}`")
    other = F.lit(None).cast("string")
    if altered:
        other = F.when(F.coalesce(*(c.isNotNull() & F.lit(True) for c in altered.values())), leaf_hash(*(F.coalesce(altered[c], value(c)) if c in altered else value(c) for c in columns)))
    name = F.coalesce(F.concat(F.lit("="), value(tree).cast("string")), F.lit(""))  # a null name comes first
    rows = df.select(name.alias("tree"), value(row).alias("row"), leaf_hash(*map(value, columns)).alias("digest"), other.alias("altered"))
    with Scratch(spark) as scratch:
        rows = scratch.written(rows, "leaves")  # the range sort samples its input first: without this, values would be read and hashed twice
        inner, roots, top = forest(rows, scratch, fanout)
        names = roots.select(F.lit("").alias("tree"), F.col("tree").alias("row"), "digest", F.lit(None).cast("string").alias("altered"))
        inner2, root, top2 = forest(names, scratch, fanout)
        beyond = root.select("tree", F.array().cast(_PATH).alias("path"))
        upper = scratch.written(_proofs(inner2, root, beyond, top2, fanout).select(F.col("row").alias("tree"), F.col("digest").alias("subroot"), "path"), "upper")
        whole = root.select(F.col("digest").alias("root"))
        found = _proofs(inner, roots, _small(upper.select("tree", "path")), top, fanout)
        found = found.join(_small(upper.select("tree", "subroot")), "tree").join(F.broadcast(whole))  # one row
        name = F.when(F.col("tree") != "", F.substring(F.col("tree"), F.lit(2), F.length("tree")))
        return scratch.result(found.select("row", name.alias("tree"), F.col("digest").alias("leaf"), "altered", "path", "subroot", "root"), "proofs")


def proof_hash(path: Column) -> Column:
    """H of a path's siblings, level by level."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["siblings"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""

    def step(at: Column, s: Column) -> Column:
        around = lambda first, n: F.array_join(F.slice(s["siblings"], first, n), "")
        return F.sha2(F.concat(around(F.lit(1), s["place"]), at, around(s["place"] + 1, F.size(s["siblings"]) - s["place"])), 256)

    return F.aggregate(path, leaf, step)
