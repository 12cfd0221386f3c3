"""Toxicity by a classifier chain.

Categories are predicted in a fixed order; the model of each takes the words of a text and the probabilities of the
earlier categories. In training, those probabilities are out of fold: each labelled row's comes from a model that hasn't
seen it (folds by crc32 of the id), so later models learn from inputs like those they will get. Models are logistic
regressions with an L2 penalty on hashed words, of which each model keeps at most `kept_words`, those that tell its category
apart best. Trained on a bounded sample: the `sample` labelled documents of lowest hash of their id, of each label of the
category `stratum`, whose rows weigh as much as that label's share of all labelled ones. Cut-offs are the probabilities with the
best F1 over the out-of-fold predictions of all labelled rows, counted on a grid of fixed size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aho_decontaminate import normal_words
from .common import Memo, Scratch, documents, keyed_join, shared, ship_package, slices, worker_state

DIMENSION = 1 << 22
#: A word is kept if its rows differ from the base rate by so many standard deviations, beyond what the best of a million words of chance reach, and it is in so many rows.
LEAST_Z, LEAST_ROWS = 5.5, 5
#: Bins of the log-odds from -LOGITS to LOGITS, on which out-of-fold predictions are counted.
BINS, LOGITS = 4000, 14.0


def word_ids(text: str | None) -> np.ndarray:
    """Distinct hashed words of a whole text, lower-cased for A-Z."""
    memo = worker_state("toxic words", lambda: Memo(lambda w: xxhash.xxh3_64_intdigest(w) & (DIMENSION - 1)))
    words = set(normal_words(text))
    return np.unique(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))


def _words(batches):
    for batch in slices(batches):
        names = [n for n in batch.schema.names if n != "text"]
        found = pa.array([word_ids(t).astype(np.int32) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], [*names, "words"])


class LinearModel:
    """Logistic regression on kept words and dense columns, by Newton steps with conjugate gradients on sparse rows."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, weight: np.ndarray, kept_words: int, l2: float = 1.0, steps: int = 25):
        flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        words, place = np.unique(flat, return_inverse=True)
        both, ones = np.bincount(place, minlength=len(words)), np.bincount(place, y[at], len(words))
        p = y.mean() if len(y) else 0.0
        z = np.abs(ones - both * p) / np.sqrt(both * max(p * (1 - p), 1e-9) + 1e-9)
        best = np.argsort(-z, kind="stable")[:kept_words]
        best = np.sort(best[(z[best] >= LEAST_Z) & (both[best] >= LEAST_ROWS)])
        self.words = words[best]
        order = np.full(len(words), -1)
        order[best] = np.arange(len(best))
        column = order[place]
        use = column >= 0
        self.fit(at[use], column[use], dense, y, weight, l2, steps)

    def fit(self, row, column, dense, y, weight, l2, steps):
        n, k = len(y), len(self.words)
        size = k + dense.shape[1] + 1
        w = np.zeros(size)
        if not 0 < y.sum() < n:
            w[-1] = -20.0 if not y.sum() else 20.0
            self.w = w
            return
        extra = np.concatenate([dense, np.ones((n, 1))], axis=1)
        forward = lambda v: np.bincount(row, v[column], n) + extra @ v[k:]
        back = lambda r: np.concatenate([np.bincount(column, r[row], k), extra.T @ r])
        penalty = np.full(size, l2)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
            gradient = back(weight * (p - y)) + penalty * w
            if np.abs(gradient).max() < 1e-4:
                break
            h = weight * p * (1 - p)
            step, r = np.zeros(size), -gradient
            d, rr = r.copy(), float(r @ r)
            for _ in range(30):
                hd = back(h * forward(d)) + penalty * d
                a = rr / float(d @ hd)
                step += a * d
                r -= a * hd
                new = float(r @ r)
                if new < 1e-10:
                    break
                d, rr = r + new / rr * d, new
            w = w + step
        self.w = w

    def probability(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        k = len(self.words)
        out = dense @ self.w[k:-1] + self.w[-1] if dense.shape[1] else np.full(len(rows), self.w[-1])
        for i, r in enumerate(rows):
            if k and len(r):
                at = np.searchsorted(self.words, r)
                at[at == k] = 0
                out[i] += self.w[:k][at[self.words[at] == r]].sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Chain:
    """models has one a category, fold_models those of each fold of the sample, by fold: None if no rows are left without it.

    With `chained` off no model sees the earlier probabilities: what the chain is measured against.
    """

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, weight: np.ndarray, kept_words: int = 2000, l2: float = 1.0, chained: bool = True):
        self.models, self.fold_models, self.base, self.chained = [], [], [], chained
        dense = np.empty((len(rows), 0))
        for c in range(labels.shape[1]):
            y = labels[:, c].astype(float)
            self.base.append(float(np.average(y, weights=weight)) if len(y) else 0.0)
            found, seen = {}, self.seen(dense)
            for f in np.unique(folds).tolist():
                train = np.flatnonzero(folds != f)
                found[f] = LinearModel([rows[i] for i in train], seen[train], y[train], weight[train], kept_words, l2) if len(train) else None
            self.models.append(LinearModel(rows, seen, y, weight, kept_words, l2))
            self.fold_models.append(found)
            dense = np.concatenate([dense, _logit(self.out_of_fold_step(c, rows, folds, dense))[:, None]], axis=1)

    def seen(self, dense: np.ndarray) -> np.ndarray:
        return dense if self.chained else dense[:, :0]

    def out_of_fold_step(self, c: int, rows: list[np.ndarray], folds: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Of category c, given the log-odds of the earlier ones; rows of a fold without sample rows are new to the whole model."""
        out, dense = np.full(len(rows), self.base[c]), self.seen(dense)
        for f in np.unique(folds).tolist():
            own, model = np.flatnonzero(folds == f), self.fold_models[c].get(f, self.models[c])
            if model is not None:
                out[own] = model.probability([rows[i] for i in own], dense[own])
        return out

    def out_of_fold(self, rows: list[np.ndarray], folds: np.ndarray) -> np.ndarray:
        dense = np.empty((len(rows), 0))
        for c in range(len(self.models)):
            dense = np.concatenate([dense, _logit(self.out_of_fold_step(c, rows, folds, dense))[:, None]], axis=1)
        return 1 / (1 + np.exp(-dense))

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        dense = np.empty((len(rows), 0))
        for model in self.models:
            dense = np.concatenate([dense, _logit(model.probability(rows, self.seen(dense)))[:, None]], axis=1)
        return 1 / (1 + np.exp(-dense))


def bins(p: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((_logit(p) + LOGITS) * (BINS / (2 * LOGITS))), 0, BINS - 1).astype(np.int32)


def best_cut(histogram: list[tuple[int, int, int]]) -> float:
    """Of (bin, rows, positive rows): the cut with the best F1, half-way between neighbouring bins that have rows; 0.5 where no row is positive."""
    found = sorted(histogram, reverse=True)
    if not sum(h[2] for h in found):
        return 0.5
    at, rows, hits = (np.array(c, float) for c in zip(*found, strict=True))
    best = int(np.argmax(2 * np.cumsum(hits) / (np.cumsum(rows) + hits.sum())))
    edge = lambda b: 1 / (1 + np.exp(LOGITS - b * (2 * LOGITS / BINS)))
    return float((edge(at[best]) + (edge(at[best + 1] + 1) if best + 1 < len(at) else 0.0)) / 2)


def _fold(ids: list, folds: int) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % folds for i in ids], np.int64)


def _predict(broadcast, categories: list[str], folds: int):
    def run(batches):
        chain = broadcast.value
        for batch in slices(batches):
            rows = [word_ids(t) for t in batch.column("text").to_pylist()]
            p, places = chain.probabilities(rows), bins(chain.out_of_fold(rows, _fold(batch.column("doc_id").to_pylist(), folds)))
            columns = [pa.array(np.ascontiguousarray(a[:, c])) for a in (p, places) for c in range(len(categories))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(f"{k}_{c}" for k in ("p", "bin") for c in categories)])

    return run


def label_table(labels: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """One row per labelled id: doc_id and 0 or 1 for each category."""
    marks = labels.select(F.col("label_id").alias("doc_id"), *(c.cast("int").alias(n) for n, c in categories.items())).dropna()
    return marks.groupBy("doc_id").agg(*(F.max(n).alias(n) for n in categories))


def train_chain(docs: DataFrame, marks: DataFrame, scratch: Scratch, names: list[str], stratum: str, sample: int, folds: int, kept_words: int, l2: float, chained: bool) -> Chain:
    """marks: label_table(), written."""
    part = lambda condition: marks.filter(condition).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = scratch.written(part(F.col(stratum) > 0).unionByName(part(F.col(stratum) <= 0)), "chain-sample")
    table = keyed_join(docs, chosen, "doc_id", "inner").mapInArrow(_words, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema) + ", words array<int>").toArrow()
    order = sorted(range(len(table)), key=lambda i: (str(table.column("doc_id")[i]), len(table.column("words")[i])))
    table = table.take(pa.array(order, pa.int64()))
    rows = [np.array(r.values.to_numpy(), np.int64) for r in table.column("words")]
    y = np.stack([np.array(table.column(n).to_pylist(), float) > 0 for n in names], axis=1) if rows else np.zeros((0, len(names)))
    counts = marks.agg(F.count("*").alias("n"), F.count_if(F.col(stratum) > 0).alias("yes")).first()
    yes, no = (max(1.0, n / sample) for n in (counts["yes"], counts["n"] - counts["yes"]))
    weight = np.where(y[:, names.index(stratum)], yes, no)
    return Chain(rows, y, _fold(table.column("doc_id").to_pylist(), folds), weight / weight.mean() if rows else weight, kept_words, l2, chained)


def toxicity(df: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", *, stratum: str | None = None, sample: int = 4000, folds: int = 5, kept_words: int = 2000, l2: float = 1.0, chained: bool = True) -> DataFrame:
    """One row per row of df: doc_id, p_<category> and <category> (p above the cut) for each category, in chain order.

    categories: name to a condition on the labels' columns; stratum: one of them, by default the first. Labels with a null id or condition are left out; of several
    labels of one id a category holds if one says so. A null or empty text has no words and gets the models' base rates.
    Without labels, or with one class only, a category is predicted nowhere (or everywhere, if all rows have it). The
    chain (a few thousand weights a category) is broadcast.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = documents(df, id_col, text_col)
    names = list(categories)
    with Scratch(spark) as scratch:
        marks = scratch.written(label_table(labels.withColumn("label_id", F.col(label_id)), categories), "chain-labels")
        chain = shared(spark, train_chain(docs, marks, scratch, names, stratum or names[0], sample, folds, kept_words, l2, chained))
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"p_{c} double" for c in names) + ", " + ", ".join(f"bin_{c} int" for c in names)
        scored = scratch.written(docs.mapInArrow(_predict(chain, names, folds), schema), "chain-scores")
        known = scratch.written(scored.join(marks, "doc_id").select(*(f"bin_{c}" for c in names), *names), "chain-known")
        cuts = {c: best_cut([tuple(r) for r in known.groupBy(f"bin_{c}").agg(F.count("*"), F.count_if(F.col(c) > 0)).collect()]) for c in names}  # at most BINS rows each
        out = scored.select("doc_id", *(f"p_{c}" for c in names), *((F.col(f"p_{c}") > cuts[c]).alias(c) for c in names))
        return scratch.result(out, "chain-predictions")
