"""Licence scans: one generalised suffix automaton over the words of all templates; a text streams through it once.

The automaton holds every run of words of every template and phrase. While a text streams through it, the state after each
word is the longest run that ends there (the matching statistics); a place from which it can't be continued ends a maximal
match. Phrases are read off the states: a phrase ends at a word if it is a suffix of the longest run there. Maximal matches of
`long` words or more (of a template of fewer: the whole) are anchors; anchors in the same order in text and template, at most
`gap` words apart, are chained so that they cover most words of the template. Chains that cover `cover` of it become spans; of
spans that overlap, the one with most covered words stays.

A task holds one text at a time, as bytes, and the automaton, which is broadcast as its templates (a few thousand words, a
parameter). Null and empty texts have no words, no places and no spans. Every row has its own result; nulls in doc_id are kept.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .aho_decontaminate import _TABLE, normal_words, original_offsets
from .common import documents, shared, ship_package, slices, worker_state
from .license_templates import PHRASES, TEMPLATES

#: Bytes of a text that become words at once.
_PIECE = 1 << 16


class SuffixAutomaton:
    """Of several token sequences; `ends` has, for each state, where its runs end: (sequence, place)."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        prefix_states = []
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extended(last, token)
                prefix_states.append((last, number, place))
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state, number, place in prefix_states:
            while state > 0:
                self.ends[state].append((number, place))
                state = self.link[state]

    def _state(self, length: int, link: int, arrows: dict) -> int:
        self.next.append(arrows)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, token: int, target: int) -> int:
        """The state of the runs of `target` that are no longer than one more than those of `at`."""
        if self.length[target] == self.length[at] + 1:
            return target
        copy = self._state(self.length[at] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while at >= 0 and self.next[at].get(token) == target:
            self.next[at][token] = copy
            at = self.link[at]
        return copy

    def _extended(self, last: int, token: int) -> int:
        if token in self.next[last]:  # an earlier sequence has this run
            return self._split(last, token, self.next[last][token])
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, token, self.next[at][token])
        return new


class Library:
    """Templates and phrases in one automaton. phrases, templates: (label, text)."""

    def __init__(self, templates, phrases, long: int = 4, gap: int = 12, cover: float = 0.75):
        self.long, self.gap, self.cover = long, gap, cover
        self.labels = [label for label, _ in (*phrases, *templates)]
        words = [normal_words(text) for _, text in (*phrases, *templates)]
        self.sizes, self.n_phrases = list(map(len, words)), len(phrases)
        self.ids: dict[bytes, int] = {}
        sequences = [[self.ids.setdefault(w, len(self.ids)) for w in ws] for ws in words]
        self.automaton = SuffixAutomaton(sequences)
        # Of each state: the phrases that are suffixes of its runs, by number and length.
        self.suffixes: list[tuple] = [()] * len(self.automaton.next)
        for state, ends in enumerate(self.automaton.ends):
            whole = [(n, self.sizes[n]) for n, place in ends if n < self.n_phrases and place == self.sizes[n] - 1]
            # A place in `ends` may be that of a suffix only: the run must hold the phrase.
            self.suffixes[state] = tuple((n, size) for n, size in whole if size <= self.automaton.length[state])
        for state in sorted(range(1, len(self.suffixes)), key=self.automaton.length.__getitem__):
            above = self.suffixes[self.automaton.link[state]]
            self.suffixes[state] = tuple(dict.fromkeys((*self.suffixes[state], *above)))
        self.shortest = min((max(1, min(long, size)) for size in self.sizes if size), default=1)

    def stream(self, text: str) -> tuple[int, list, list]:
        """The number of words; places of phrases (phrase, first word); maximal matches (state, length, last word)."""
        data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
        arrows, link, length, suffixes, get, shortest = self.automaton.next, self.automaton.link, self.automaton.length, self.suffixes, self.ids.get, self.shortest
        places, matches = [], []
        at = n = state = run = 0
        while at < len(data):
            end = data.find(b" ", at + _PIECE)
            end = len(data) if end < 0 else end
            words = data[at:end].split()
            for k, token in enumerate(map(get, words), n):
                if token is None:
                    if run >= shortest:
                        matches.append((state, run, k - 1))
                    state = run = 0
                    continue
                to = arrows[state].get(token)
                if to is None:
                    if run >= shortest:
                        matches.append((state, run, k - 1))
                    while to is None:  # every token has an arrow from the start
                        state = link[state]
                        run = length[state]
                        to = arrows[state].get(token)
                state, run = to, run + 1
                if suffixes[state]:
                    places += [(p, k - size + 1) for p, size in suffixes[state] if size <= run]
            n += len(words)
            at = end
        if run >= shortest:
            matches.append((state, run, n - 1))
        return n, places, matches

    def spans(self, matches: list) -> list[tuple]:
        """(template, first word, last word, covered words) of the best chains, and the greatest share that any chain covers."""
        chains = []
        recent: dict[int, list] = {}  # of each template: anchors near enough to be continued, as [doc end, template end, covered, first word]
        for state, run, end in matches:
            for number, place in self.automaton.ends[state]:
                if run < min(self.long, self.sizes[number]):
                    continue
                start, from_ = end - run + 1, place - run + 1
                near = [x for x in recent.get(number, ()) if x[0] >= start - 1 - self.gap]
                covered, first = run, start
                for x in near:
                    lap = max(0, x[0] - start + 1, x[1] - from_ + 1)
                    if x[0] < end and x[1] < place and lap < run and from_ - x[1] - 1 <= self.gap and x[2] + run - lap > covered:
                        covered, first = x[2] + run - lap, x[3]
                anchor = [end, place, covered, first]
                # Anchors that end at the same template word with less covered are of no use to later ones.
                recent[number] = [x for x in near if x[1] != place or x[2] > covered] + [anchor]
                chains.append((number, first, end, covered))
        return chains

    def found(self, matches: list) -> tuple[list[tuple], float]:
        chains = self.spans(matches)
        best = max((min(1.0, c / self.sizes[n]) for n, _, _, c in chains), default=0.0)
        full = sorted((c for c in chains if c[0] >= self.n_phrases and c[3] >= self.cover * self.sizes[c[0]]), key=lambda c: (-c[3], -c[3] / self.sizes[c[0]], c[0], c[1]))
        taken: list[tuple] = []
        firsts: list[int] = []
        by_first: dict[int, tuple] = {}
        for c in full:
            k = bisect_right(firsts, c[2]) - 1  # the last span that begins no later than this one ends
            if k < 0 or by_first[firsts[k]][2] < c[1]:
                insort(firsts, c[1])
                by_first[c[1]] = c
                taken.append(c)
        return sorted(taken, key=lambda c: c[1]), best

    def scan(self, text: str | None) -> dict:
        n, places, matches = self.stream(text or "")
        taken, best = self.found(matches)
        offsets = original_offsets(text or "", [(a, b) for _, a, b, _ in taken])
        spans = [
            {"label": self.labels[t], "template": t - self.n_phrases, "first_word": a, "last_word": b, "start": s, "end": e, "covered": c, "share": min(1.0, c / self.sizes[t])}
            for (t, a, b, c), (s, e) in zip(taken, offsets, strict=True)
        ]
        return {"n_words": n, "places": [{"label": self.labels[p], "word": k} for p, k in places], "spans": spans, "share": best}


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))


def _scan(broadcast, id_type):
    def run(batches):
        key, args = broadcast.value
        library = worker_state(("licences", key), lambda: Library(*args))
        for batch in slices(batches):
            rows = [library.scan(text) for text in batch.column("text").to_pylist()]
            kinds = (("n_words", pa.int64()), ("places", _PLACES), ("spans", _SPANS), ("share", pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(id_type), *(pa.array([r[c] for r in rows], kind) for c, kind in kinds)], ["doc_id", *(c for c, _ in kinds)])

    return run


def license_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates=TEMPLATES, phrases=PHRASES, long: int = 4, gap: int = 12, cover: float = 0.75) -> DataFrame:
    """Per row: doc_id, n_words, places of phrases (label, word), spans (label, template's number, first and last word, start and
    end in the original text, covered words, share of the template), share: the most that a chain covers of its template or phrase, 0 to 1.
    """
    ship_package(df.sparkSession)
    args = (tuple(templates), tuple(phrases), long, gap, cover)
    key = hashlib.sha256(repr(args).encode()).hexdigest()
    kind = df.schema[id_col].dataType
    spans = "array<struct<label: string, template: int, first_word: bigint, last_word: bigint, start: bigint, end: bigint, covered: bigint, share: double>>"
    schema = f"doc_id {kind.simpleString()}, n_words long, places array<struct<label: string, word: bigint>>, spans {spans}, share double"
    return documents(df, id_col, text_col).mapInArrow(_scan(shared(df.sparkSession, (key, args)), to_arrow_type(kind)), schema)


def license_labels(df: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row; options as for license_spans."""
    found = license_spans(df, **options)
    joined = lambda *labels: F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")
    words, base = F.transform("places", lambda p: p["word"]), F.transform("places", lambda p: p["label"])
    own = F.transform("spans", lambda s: s["label"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(base, own).alias("labels"), F.col("share").alias("score"), "spans",
    )
