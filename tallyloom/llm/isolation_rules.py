"""Quality rules with an isolation forest on rule statistics.

Statistics of every whole text are computed once and written. A forest of random trees is grown over all documents that
pass the base rules, as the method has it: each tree isolates `subsample` documents of its own by random splits, dealt out in
order of a hash of the id, and a document's score is 2**(-mean path length / expected path length), near 1 for anomalies. In
the mean a tree weighs more the better its path lengths tell labelled bad documents from good ones (of each kind the
`label_sample` of lowest hash), since good documents are odd too, in other ways. The threshold comes from all labelled rows
that pass the base rules: of a grid of fixed size, of the cuts that lose at most the share `good_lost` of the good rows, the
one with the largest share of bad rows caught less share of good rows lost. A document is kept if it passes the base rules
and its score's bin is at most the threshold's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Scratch, documents, shared, ship_package, slices, worker_state

_SPACES = re.compile(r"[\x20\x09-\x0D]")
_SYMBOLS = "#*$%&|<>"
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_upper", "n_punct", "n_digits", "n_lines", "n_distinct")
_U = np.uint64
BINS = 2000


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more in the text, the first time included; and the number of distinct words."""
    n = len(words)
    if n < 4:
        return 0, len(set(words))
    memo = worker_state("rule words", lambda: Memo(xxhash.xxh3_64_intdigest))
    ids = np.fromiter(map(memo.__getitem__, words), _U, n)
    with np.errstate(over="ignore"):
        h = (ids[:-2] * _U(0x9E3779B97F4A7C15)) ^ (ids[1:-1] * _U(0xC2B2AE3D27D4EB4F) >> _U(1)) ^ (ids[2:] * _U(0x165667B19E3779F9) >> _U(2))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return int(hit.sum()), len(np.unique(ids))


def dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if _SPACES.sub("", x)]
    return len(lines) - len(set(lines))


_UPPER = bytes(b for b in range(65, 91))
_DIGITS = b"0123456789"
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in _SYMBOLS)


def statistics(text: str | None) -> tuple[int, ...]:
    """_BASE and _MORE of a text; all 0 for null."""
    if not text:
        return (0,) * (len(_BASE) + len(_MORE))
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    repeated, distinct = repeat_words(words)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (len(words), len(text) - spaces, count(_SYMBOLS.encode()), dup_lines(text), repeated, count(_UPPER), count(_PUNCT), count(_DIGITS), text.count("\n") + 1, distinct)


def _statistics(batches):
    for batch in slices(batches):
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        columns = zip(*rows, strict=True) if rows else [()] * len(_BASE + _MORE)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *_BASE, *_MORE])


def features(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    c = {n: np.array(batch.column(n).to_pylist(), float) for n in _BASE + _MORE}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack([c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_punct"] / chars, c["n_digits"] / chars, c["n_distinct"] / words ** 0.9], axis=1)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees in arrays; a node's children are left[i] and left[i] + 1, and depth holds a leaf's path length."""

    def __init__(self, x: np.ndarray, trees: int = 128, subsample: int = 256, seed: int = 2):
        rng = np.random.RandomState(seed)
        self.subsample, self.trees = min(subsample, len(x)), []
        limit = int(np.ceil(np.log2(max(2, self.subsample))))
        enough = len(x) >= trees * self.subsample  # each tree has rows of its own; of fewer rows they are drawn
        for t in range(trees if len(x) else 0):
            rows = x[t * self.subsample : (t + 1) * self.subsample] if enough else x[rng.choice(len(x), self.subsample, replace=False)]
            feature, value, left, depth = [-1], [0.0], [0], [0.0]
            todo = [(0, rows, 0)]
            while todo:
                i, own, level = todo.pop()
                low, high = own.min(axis=0), own.max(axis=0)
                able = np.flatnonzero(high > low)
                if level >= limit or len(own) <= 1 or not len(able):
                    depth[i] = level + _expected(len(own))
                    continue
                f = able[rng.randint(len(able))]
                cut = rng.uniform(low[f], high[f])
                feature[i], value[i], left[i] = int(f), float(cut), len(feature)
                for part in (own[own[:, f] < cut], own[own[:, f] >= cut]):
                    feature.append(-1)
                    value.append(0.0)
                    left.append(0)
                    depth.append(0.0)
                    todo.append((len(feature) - 1, part, level + 1))
            self.trees.append(tuple(map(np.array, (feature, value, left, depth))))
        self.limit, self.weights = limit, np.ones(len(self.trees))

    def path_lengths(self, x: np.ndarray, tree: int) -> np.ndarray:
        feature, value, left, depth = self.trees[tree]
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.limit + 1):
            f = feature[at]
            at = np.where(f >= 0, left[at] + (x[rows, f] >= value[at]), at)
        return depth[at]

    def weigh(self, good: np.ndarray, bad: np.ndarray) -> None:
        """A tree weighs the difference of both kinds' mean path lengths over their variances, 0 if bad ones are the deeper; all weigh the same without rows of both kinds."""
        if not len(good) or not len(bad):
            return
        w = np.zeros(len(self.trees))
        for t in range(len(w)):
            g, b = self.path_lengths(good, t), self.path_lengths(bad, t)
            w[t] = max(0.0, g.mean() - b.mean()) / (g.var() + b.var() + 1.0)
        if w.sum():
            self.weights = w * len(w) / w.sum()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for t in np.flatnonzero(self.weights):
            total += self.weights[t] * self.path_lengths(x, t)
        return 2.0 ** (-total / len(self.trees) / max(_expected(self.subsample), 1e-9))


def _scores(broadcast, kind: str):
    def run(batches):
        forest = broadcast.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(forest.scores(features(batch)))], [*batch.schema.names, "score"])

    return run


def threshold(histogram: list[tuple[int, int, int]], good_lost: float) -> int:
    """Of (bin, good rows, bad rows): the last bin kept (see above; the highest of equal ones); the last of all without rows of both kinds."""
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for b, g, n in histogram:
        good[b], bad[b] = g, n
    if not good.sum() or not bad.sum():
        return BINS - 1
    lost, caught = good.sum() - np.cumsum(good), bad.sum() - np.cumsum(bad)
    worth = np.where(lost <= good_lost * good.sum(), caught * good.sum() - lost * bad.sum(), -np.inf)
    return int(np.flatnonzero(worth == worth.max())[-1])


def rule_decisions(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", *, min_words: int = 50, repeat_percent: int = 50, trees: int = 128, subsample: int = 256, label_sample: int = 4000, good_lost: float = 0.025, seed: int = 2) -> DataFrame:
    """One row per row of df: doc_id, the statistics, base_failed, score (of documents that pass the base rules), kept.

    A null or empty text has no words and fails. Labels with a null id or label are left out; of several labels of one id
    the lowest counts. Without labels of both kinds nothing is rejected beyond the base rules, and so where no document
    passes them. Repeated rows are decided each by itself. The forest (bounded by its parameters) is broadcast.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    with Scratch(spark) as scratch:
        stats = docs.mapInArrow(_statistics, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _BASE + _MORE))
        failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
        stats = scratch.written(stats.withColumn("base_failed", failed), "rule-statistics")
        passed = stats.filter("not base_failed")
        marks = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
        marks = scratch.written(marks, "rule-labels")
        order = (F.xxhash64("doc_id"), "doc_id", *_BASE, *_MORE)
        first = lambda rows, n: features(rows.orderBy(*order).limit(n).orderBy(*order).select(*_BASE, *_MORE).toArrow())
        grown = IsolationForest(first(passed, trees * subsample), trees, subsample, seed)
        known = scratch.written(passed.join(marks, "doc_id").select("doc_id", *_BASE, *_MORE, (F.col("label") > 0).alias("good")), "rule-known")
        grown.weigh(first(known.filter("good"), label_sample), first(known.filter("not good"), label_sample))
        forest = shared(spark, grown)
        scored = passed.mapInArrow(_scores(forest, kind), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _BASE + _MORE) + ", base_failed boolean, score double")
        place = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
        scored = scratch.written(scored.withColumn("bin", place), "rule-scores")
        rows = scored.join(marks, "doc_id").groupBy("bin").agg(F.count_if(F.col("label") > 0).alias("good"), F.count_if(F.col("label") <= 0).alias("bad")).collect()  # at most BINS
        limit = threshold([(r["bin"], r["good"], r["bad"]) for r in rows], good_lost)
        out = scored.unionByName(stats.filter("base_failed"), allowMissingColumns=True)
        out = out.select("doc_id", *_BASE, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("bin") <= limit, F.lit(False))).alias("kept"), "score")
        return scratch.result(out, "rule-decisions")


__all__ = ["IsolationForest", "rule_decisions", "statistics", "threshold"]
