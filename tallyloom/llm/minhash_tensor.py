"""Near-duplicate detection: MinHash with tensored banding, and links confirmed on the full shingle sets.

Two collections of `side` keys, each of `rows` minhashes, are computed for a document; every pair of a key of the first
and a key of the second is the key of one table, so side*side tables of 2*rows minhashes need only 2*side*rows minhash
functions (192 for 576 tables, where plain banding needs 4,608). A pair of similarity s meets in no table with
probability about 2*(1-s**rows)**side: 2.2e-4 at s = 0.75, 2e-6 at 0.8, for the default 24 and 4.

How the work stays linear in a hot group: equal sets are one node from the start; then `rounds` link each document with
the one pivot (the smallest id of a table's bucket, of another component) it meets most often, and merge what that
connects; more such rounds follow while one still joins more than a twentieth of the nodes left to it. What is left:

- Keys of the first collection with at most BLOCK_ROWS rows are resolved inside tasks, where pairs are formed in memory, not
  as rows. A pair of different components is taken up at its first common key alone and must share enough tables, fit in
  size, in a sketch of one bit of every minhash (bits differ in (1-s)/2 of the places, 24 of 192 expected at 0.75; more than
  42 has probability 5e-5) and in the least hashes of its sets, as many as there are minhashes: of sets no larger these
  decide, and of the pairs they decide only a spanning forest leaves the task; of larger sets they estimate the similarity,
  and pairs up to four deviations below the limit leave it.
- Documents of keys with more rows must, beside meeting in the tables, share one of their rarest shingles (`_rare_pairs`, an
  exact filter that loses no link): no copy of a row is made for others of its key, and documents that share a common
  passage, however many, aren't compared for it.

All that is left is confirmed on the whole sets. So neither a large group of near copies, nor a passage in very many
documents that differ otherwise, yields rows by the square of its members. Documents of crowded keys that are put together
from the same few passages, none of them rare, do: the filter by rare shingles keeps their pairs. Links are lost by the tables (2.2e-4 of the pairs at 0.75, less above),
`tables` (2e-5) and the sketch (5e-5), and where 32-bit hashes of a pair's sets collide (below 1e-5).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Memo, Scratch, ascii_lower_words, documents, keyed_join, ship_package, slices, worker_state

#: Most rows of a key that meet in a task.
BLOCK_ROWS = 512

_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of a text of fewer words one hash of them all; none without words."""
    words = ascii_lower_words(text)
    n = len(words)
    if not n:
        return np.empty(0, _U)
    memo = worker_state("shingle words", lambda: Memo(xxhash.xxh3_64_intdigest))
    ids = np.fromiter(map(memo.__getitem__, words), _U, n)
    size = min(n, size)
    out = np.full(n - size + 1, _U(size), _U)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = _mixed(out * _MIX[0] + ids[j : n - size + 1 + j])
    return np.unique(out)


class Signer:
    """The two collections of keys of a set. The minhash functions are permutations of 32-bit numbers, a*x+b with odd a."""

    def __init__(self, rows: int, side: int, seed: int = 20):
        self.rows, self.side, n = rows, side, 2 * rows * side
        rng = np.random.RandomState(seed)
        self.a = (rng.randint(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.randint(0, 2**32, n, dtype=np.uint64).astype(np.uint32)[:, None]

    def keys(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """The keys of both collections; and packed: their low 32 bits, the sketch in numbers of 64 bits, the least hashes."""
        x = (shingles >> _U(32)).astype(np.uint32)[None, :]
        with np.errstate(over="ignore"):
            least = np.min([np.min(self.a * x[:, i : i + 2048] + self.b, axis=1) for i in range(0, x.shape[1], 2048)], axis=0)
            least = least.astype(_U)
            bits = np.packbits((_mixed(least + _MIX[0]) & _U(1)).astype(np.uint8))
            bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view(_U)
            least = least.reshape(2 * self.side, self.rows)
            out = np.arange(1, 2 * self.side + 1, dtype=_U)
            for j in range(self.rows):
                out = _mixed(out * _MIX[0] + least[:, j])
        packed = out.astype(np.uint32).tobytes() + bits.tobytes() + x[0, : 2 * self.side * self.rows].tobytes()
        return out[: self.side].view(np.int64), out[self.side :].view(np.int64), packed


def _signatures(size: int, rows: int, side: int):
    def run(batches):
        signer = Signer(rows, side)
        for batch in slices(batches):
            ids, n, k1, k2, a, b, packed = batch.column("doc_id"), [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, size)
                n.append(len(found))
                key = xxhash.xxh3_128_digest(found.tobytes())
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
                x, y, z = signer.keys(found) if len(found) else (None, None, None)
                a.append(x)
                b.append(y)
                packed.append(z)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(a, kind), pa.array(b, kind), pa.array(packed, pa.binary())], ["doc_id", "n", "k1", "k2", "a", "b", "packed"])

    return run


def _confirm(size: int, num: int, den: int):
    def run(batches):
        for batch in slices(batches):
            keep, seen, last = [], {}, None
            for s, t in zip(batch.column("text_x").to_pylist(), batch.column("text_y").to_pylist(), strict=True):
                if s != last:  # rows of one x often stand together
                    seen, last = {"x": shingle_set(s, size)}, s
                x, y = seen["x"], shingle_set(t, size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shingles(size: int):
    def run(batches):
        for batch in slices(batches, 64):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), batch.column("comp").take(pa.array(at)), pa.array(np.array([len(x) for x in sets], np.int64)[at]), pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], _U).view(np.int64)[at]), pa.array(np.concatenate([*sets, np.empty(0, _U)]).view(np.int64))], ["doc_id", "comp", "n", "k", "h"])

    return run


class _Block:
    """The rows of one key that meet in a task: (doc_id, comp, n, packed)."""

    def __init__(self, rows: pa.RecordBatch, side: int, places: int):
        self.ids, self.comp, self.n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "comp", "n"))
        raw, longs = rows.column("packed").to_pylist(), -(-places // 64)
        head = 8 * side + 8 * longs
        fixed = np.frombuffer(b"".join(r[:head] for r in raw), np.uint8).reshape(len(raw), head)
        keys = np.ascontiguousarray(fixed[:, : 8 * side]).view(np.uint32)
        self.a, self.b, self.bits = keys[:, :side], keys[:, side:], np.ascontiguousarray(fixed[:, 8 * side :]).view(_U)
        self.low = [np.frombuffer(r, np.uint32, offset=head) for r in raw]
        whole = self.n <= places
        self.last = np.array([0xFFFFFFFF if w else int(v[-1]) for w, v in zip(whole, self.low, strict=True)], np.uint32)
        self.whole = whole

    def common(self, x: int, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For x and each of ys: least hashes in both and in either, up to where both sets are known."""
        mine, sizes = self.low[x], np.array([len(self.low[y]) for y in ys])
        theirs, upto = np.concatenate([self.low[y] for y in ys]), np.minimum(self.last[x], self.last[ys])
        known = theirs <= np.repeat(upto, sizes)
        found = known & (mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs)
        starts = np.cumsum(sizes) - sizes
        both = np.add.reduceat(found.astype(np.int64), starts)
        return both, np.add.reduceat(known.astype(np.int64), starts) + np.searchsorted(mine, upto, side="right") - both

    def pairs(self, place: int, num: int, den: int, tables: int, differ: int) -> list[tuple[int, int]]:
        """The pairs that leave the task; those that the least hashes decide join components here."""
        out, comp, share = [], self.comp.copy(), num / den
        for x in range(len(comp)):
            ys = np.arange(x + 1, len(comp))
            n = self.n[ys]
            ys = ys[(comp[ys] != comp[x]) & (np.minimum(n, self.n[x]) * den >= np.maximum(n, self.n[x]) * num)]
            if len(ys):
                ys = ys[np.bitwise_count(self.bits[ys] ^ self.bits[x]).sum(axis=1) <= differ]
            if not len(ys):
                continue
            same = self.a[ys] == self.a[x]
            met = same.sum(axis=1) * (self.b[ys] == self.b[x]).sum(axis=1)
            ys = ys[(same.argmax(axis=1) == place) & (met >= tables)]
            if not len(ys):
                continue
            both, either = self.common(x, ys)
            sure = self.whole[ys] & self.whole[x]
            slack = np.where(sure, 0.0, 4 * np.sqrt(share * (1 - share) * either))
            for y, decided in zip(ys[both >= share * either - slack - 1e-6].tolist(), sure[both >= share * either - slack - 1e-6].tolist(), strict=True):
                if comp[x] != comp[y]:
                    out.append((int(min(self.ids[x], self.ids[y])), int(max(self.ids[x], self.ids[y]))))
                    if decided:
                        comp[comp == comp[y]] = comp[x]
        return out


def _resolved(side: int, places: int, num: int, den: int, tables: int, differ: int):
    """Of rows sorted by key: the pairs of each key."""

    def run(batches):
        rest = None
        for batch in _ended(batches):
            last = batch is None
            rows = rest if last else batch if rest is None else pa.concat_batches([rest, batch])
            if rows is None or not rows.num_rows:
                continue
            k = rows.column("key").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            cuts = np.concatenate(([0], cuts, [len(k)] if last else []))
            rest, out = None if last else rows.slice(int(cuts[-1])), []
            for at, end in zip(cuts[:-1].astype(int).tolist(), cuts[1:].astype(int).tolist(), strict=True):
                if end - at > 1:
                    out += _Block(rows.slice(at, end - at), side, places).pairs(int(rows.column("place")[at].as_py()), num, den, tables, differ)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["x", "y"])

    return run


def _ended(batches):
    yield from batches
    yield None


def _small(rows: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """rows of a few whole numbers, to be broadcast if they are at most `limit` as counted."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (written) with the texts of both sides. Texts are met by their ids, then by the pair, of which no key is hot."""
    own = _small(pairs)
    sides = [own.join(texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")), k) for k in ("x", "y")]
    return sides[0].join(sides[1], ["x", "y"])


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of the edges (x, y): root is the smallest node that it reaches.

    Large-star and small-star rounds over DataFrames until all edges are stars: no root has an edge of its own, no node two.
    Each round is written to the shared folder. The only value that reaches the driver is a count of each round.
    """
    edges = scratch.written(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u > v").distinct(), "edges")
    near = F.broadcast if edges.count() <= BROADCAST_KEYS // 2 else lambda rows: rows  # no round has more nodes than the first
    while True:
        ways = edges.union(edges.select("v", "u"))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.filter("v > u").join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(near(least), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        edges = scratch.written(small.filter("u > v").distinct(), "edges")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


class _Links:
    """Components so far: labels holds (node, comp) of the nodes that are linked."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, texts: DataFrame, size: int, num: int, den: int):
        self.scratch, self.nodes, self.texts, self.size, self.num, self.den = scratch, nodes, texts, size, num, den
        self.labels = self.tested = None

    def labelled(self, df: DataFrame) -> DataFrame:
        if self.labels is None:
            return df.withColumn("comp", F.col("doc_id"))
        return df.join(_small(self.labels), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))

    def meeting(self, side: int) -> DataFrame:
        """(doc_id, comp) of the documents with a key of the first collection that more than one component has.

        A document whose every such key meets its own component only can't meet another in any table.
        """
        flat = self.labelled(self.nodes.select("doc_id", F.explode(F.slice("a", 1, side)).alias("key")))
        shared = flat.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        return self.scratch.written(flat.join(shared, "key").select("doc_id", "comp").distinct(), "meet")

    def buckets(self, meet: DataFrame, side: int) -> DataFrame:
        """(key, doc_id, comp, pivot): the tensored tables' buckets that hold more than one component; pivot is the first member."""
        few = keyed_join(self.nodes, meet, "doc_id", "inner")
        part = few.select("doc_id", "comp", F.explode(F.slice("a", 1, side)).alias("p"), F.slice("b", 1, side).alias("b"))
        rows = part.select("doc_id", "comp", "p", F.explode("b").alias("q")).select(F.xxhash64("p", "q").alias("key"), "doc_id", "comp")
        mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("doc_id", "comp")).alias("pivot")).filter("lo < hi")
        return rows.join(mixed.select("key", "pivot"), "key")

    def untested(self, pairs: DataFrame) -> DataFrame:
        return pairs if self.tested is None else pairs.join(_small(self.tested), ["x", "y"], "left_anti")

    def link(self, pairs: DataFrame) -> int:
        """Confirms the pairs (x, y), x < y, on full sets and merges the components they connect; the number of links."""
        pairs = self.scratch.written(pairs, "pairs")
        self.scratch.settle()
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        links = self.scratch.written(_with_texts(pairs, self.texts).mapInArrow(_confirm(self.size, self.num, self.den), "x long, y long"), "links")
        found = links.count()
        if not found:
            return 0
        ends = self.labelled(links.withColumnRenamed("x", "doc_id")).select(F.col("comp").alias("cx"), F.col("y").alias("doc_id"))
        roots = connected(self.labelled(ends).select(F.col("cx").alias("x"), F.col("comp").alias("y")), self.scratch)
        touched = links.select(F.col("x").alias("doc_id")).union(links.select("y"))
        known = touched if self.labels is None else touched.union(self.labels.select("doc_id"))
        new = self.labelled(known.distinct()).join(_small(roots), F.col("comp") == F.col("node"), "left")
        self.labels = self.scratch.written(new.select("doc_id", F.coalesce("root", "comp").alias("comp")), "labels")
        return found

    def star(self, side: int) -> float:
        """Links each document with the pivot of another component that it meets in the most tables and wasn't held against yet; the links' share of the documents that meet others."""
        meet = self.meeting(side)
        met = self.buckets(meet, side).filter("pivot.comp <> comp").groupBy(F.col("pivot.doc_id").alias("x"), F.col("doc_id").alias("y")).agg(F.count("*").alias("tables"))
        best = self.untested(met).groupBy("y").agg(F.max_by("x", F.struct("tables", -F.col("x"))).alias("x"))
        return self.link(best.select("x", "y")) / max(1, meet.count())

    def keys(self) -> DataFrame:
        """(key, doc_id, place, comp, crowded) of the keys of the first collection that more than one component has."""
        flat = self.labelled(self.nodes.select("doc_id", F.posexplode("a").alias("place", "key")))
        mixed = flat.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), (F.count("*") > BLOCK_ROWS).alias("crowded")).filter("lo < hi")
        return flat.join(mixed.select("key", "crowded"), "key")

    def crowded(self) -> None:
        """Links the documents of crowded keys: of those that share a rare shingle and meet in a table."""
        members = self.keys().filter("crowded").select("doc_id", "comp").distinct()
        members = self.scratch.written(members, "crowded")
        if members.isEmpty():
            return
        pairs = self.untested(_rare_pairs(self.scratch, members.join(self.texts, "doc_id"), self.size, self.num, self.den))
        sides = [self.nodes.select(F.col("doc_id").alias(k), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}")) for k in ("x", "y")]
        same = lambda c: F.exists(F.zip_with(f"{c}x", f"{c}y", lambda p, q: p == q), lambda e: e)
        self.link(pairs.join(sides[0], "x").join(sides[1], "y").filter(same("a") & same("b")).select("x", "y"))

    def resolve(self, side: int, tables: int, places: int) -> None:
        """Links what different components still share in keys that aren't crowded: a key's rows meet in one task."""
        rows = self.keys().filter("not crowded").select("key", "doc_id", "place", "comp").join(self.nodes.select("doc_id", "n", "packed").distinct(), "doc_id")
        dealt = rows.repartition("key").sortWithinPartitions("key", "doc_id")
        found = dealt.mapInArrow(_resolved(side, places, self.num, self.den, tables, -(-places * 7 // 32)), "x long, y long")
        self.link(self.untested(found.distinct()))


def _rare_pairs(scratch: Scratch, members: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs x < y of members (doc_id, comp, text) of different components that can be linked, by a filter that loses none.

    All sets are put in one order, rarest shingle first. With t = num/den, linked sets of sizes m <= n share t/(1+t)*(m+n)
    shingles at least, so that at their first common one both have as many left. Hence the smaller's is among its first
    m - 2t/(1+t)*m + 1, the larger's among its first n - t*n + 1, and both places fit the pair's sizes. A shingle of one
    member alone has no row, but counts for the places.
    """
    rows = scratch.written(members.mapInArrow(_shingles(size), "doc_id long, comp long, n long, k long, h long"), "member-shingles")
    common = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    lists = rows.join(common, "h").groupBy("doc_id", "comp", "n", "k").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    rare = lists.select("doc_id", "comp", "n", (F.col("n") - F.size("s")).alias("alone"), F.expr(f"slice(s, 1, int(greatest(0, n - ceil({num} * n / {den}) + 1 - (n - size(s)))))").alias("s"))
    flat = scratch.written(rare.select("doc_id", "comp", "n", F.posexplode("s").alias("i", "v"), "alone").select("doc_id", "comp", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("left"), F.col("v.h").alias("h")), "rare")
    mixed = flat.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
    flat = flat.join(mixed, "h")
    small = flat.filter(f"{num + den} * left >= {2 * num} * n").select("h", *(F.col(c).alias(f"s_{c}") for c in ("doc_id", "comp", "n", "left")))
    fits = F.expr(f"s_comp <> comp AND (s_n < n OR s_n = n AND s_doc_id < doc_id) AND {den} * s_n >= {num} * n AND {num + den} * least(s_left, left) >= {num} * (s_n + n)")
    return flat.join(small, "h").filter(fits).select(F.least("doc_id", "s_doc_id").alias("x"), F.greatest("doc_id", "s_doc_id").alias("y")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, num: int = 75, den: int = 100, rows: int = 4, side: int = 24, rounds: tuple[int, ...] = (4, 8), tables: int = 3, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is it).

    Documents are linked when den*|A and B| >= num*|A or B| for their sets of distinct shingles. Pairs that meet in at
    least `tables` of side*side tables (of 57 expected at 0.75; fewer with probability 2e-5 there) are confirmed on the
    whole sets. `rounds` are the collection sizes used to link each document with one pivot before pairs are formed.

    A null, empty or all-space text has an empty set and is linked with nothing. A null doc_id stays alone: component_id
    null, kept true. Several rows of one doc_id are one node. ids must be whole numbers.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = documents(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    with Scratch(spark) as scratch:
        sig = scratch.written(docs.mapInArrow(_signatures(shingle, rows, side), "doc_id long, n long, k1 long, k2 long, a array<long>, b array<long>, packed binary"), "signatures")
        real = sig.filter("n > 0 and doc_id is not null")
        first = scratch.written(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
        members = real.select("doc_id", "k1", "k2").join(first, ["k1", "k2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
        members = scratch.written(members.distinct(), "members")
        own = members.filter("doc_id = rep").select("doc_id").distinct()
        # A document that shares no key of the first collection with another is a candidate nowhere: its text isn't needed.
        flat = keyed_join(real, own, "doc_id", "left_semi", broadcast_keys).select("doc_id", F.explode("a").alias("key"))
        shared = flat.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key")
        able = scratch.written(flat.join(shared, "key").select("doc_id").distinct(), "able")
        nodes = scratch.written(keyed_join(real, able, "doc_id", "left_semi", broadcast_keys).select("doc_id", "n", "a", "b", "packed"), "nodes")
        texts = scratch.written(keyed_join(docs, able, "doc_id", "left_semi", broadcast_keys).distinct(), "texts")
        links = _Links(scratch, nodes, texts, shingle, num, den)
        spread = members.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y")
        if not spread.isEmpty():  # several rows of one id, with different sets, join those sets' nodes
            many = members.join(spread.select("doc_id", "x"), "doc_id").filter("rep <> x").select("x", F.col("rep").alias("y"))
            links.labels = scratch.written(connected(many, scratch).select(F.col("node").alias("doc_id"), F.col("root").alias("comp")), "labels")
        joined = 1.0
        for n in rounds:
            joined = links.star(min(n, side))
        while rounds and joined > 0.05:
            joined = links.star(min(rounds[-1], side))
        links.crowded()
        links.resolve(side, tables, 2 * rows * side)
        labels = members.withColumn("comp", F.col("rep"))
        if links.labels is not None:
            labels = members.join(links.labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("comp"))
        labels = labels.groupBy("doc_id").agg(F.min("comp").alias("comp"))
        out = sig.select("doc_id", F.col("n").alias("n_shingles")).join(labels, "doc_id", "left")
        out = out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), F.coalesce(F.coalesce("comp", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
        return scratch.result(out, "components")


__all__ = ["Signer", "connected", "near_duplicates", "shingle_set"]
