"""Prefix prints, stored transcripts and digest trees against brute force, with planted changes found at their place."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import digests
from tallyloom.operators.digests import content_text, differing_ranges, differing_rows, first_mismatches, prefix_prints, range_tree

EVENTS = "k string, turn long, text string"


def test_prints_of_prefixes(spark):
    """Equal prefixes alone have equal prints, whatever the order and the tasks of the rows; a hot key, nulls and a null key."""
    rows = [("hot", t, f"w{t % 7}") for t in range(400)] + [("twin", t, f"w{t % 7}") for t in range(50)] + [("other", t, None if t == 3 else f"w{t % 7}") for t in range(9)] + [(None, 0, "w0"), ("gap", 2, "w2")]
    random.Random(1).shuffle(rows)
    got = {(r["k"], r["turn"]): r["print"] for r in prefix_prints(spark.createDataFrame(rows, EVENTS).repartition(6), "k", "turn", content_text(F.col("text"))).collect()}
    assert len(got) == len(rows) and len({got["hot", t] for t in range(400)}) == 400
    assert all(got["hot", t] == got["twin", t] for t in range(50)) and all((got["hot", t] == got["other", t]) == (t < 3) for t in range(9)) and got[None, 0] == got["hot", 0] and got["gap", 2] != got["hot", 2]


def test_changes_are_found_at_their_place(spark):
    rows = [(f"c{k}", t, f"text {k} {t}") for k in range(8) for t in range(30)]
    content = content_text(F.col("text"))
    recorded = prefix_prints(spark.createDataFrame(rows, EVENTS), "k", "turn", content)
    now = {(k, t): x for k, t, x in rows}
    now["c1", 7] = "changed"
    now["c1", 20] = "changed too"
    del now["c2", 29]
    del now["c3", 0]
    now["c4", 30] = "one more"
    now["c5", 4] = None
    for t in range(30):
        del now["c6", t]
    now["c9", 3] = "never recorded"
    found = first_mismatches(spark.createDataFrame([(*k, x) for k, x in now.items()], EVENTS), recorded, "k", "turn", content)
    assert {r["k"]: (r["turn"], r["reason"]) for r in found.collect()} == {"c1": (7, "changed"), "c2": (29, "missing_event"), "c3": (0, "missing_event"), "c4": (30, "extra_event"), "c5": (4, "changed"), "c6": (0, "missing_event"), "c9": (3, "extra_event")}


@pytest.mark.parametrize("few", [10_000, 20])
def test_differing_rows_by_trees(spark, monkeypatch, few):
    """Far keys, negative and null ones, repeated rows; only ranges that differ are read."""
    monkeypatch.setattr(digests, "FEW_NODES", few)
    rng = random.Random(3)
    rows = [(rng.randrange(-(2**40), 2**40), f"v{k}") for k in range(500)] + [(k, "near") for k in range(3000)] + [(None, "n"), (7, "near"), (8, "near")]
    frame = lambda x: spark.createDataFrame(x, "k long, text string")
    content = content_text(F.col("text"))
    left = frame(rows)
    assert differing_rows(left, left.repartition(3), "k", content).count() == 0
    other = [r for r in rows if r != (1234, "near")]
    other.remove((7, "near"))
    first = rows[0][0]
    other[0] = (first, None)
    other += [(2**41, "new"), (None, "n")]
    right = frame(other)
    trees = [range_tree(t, "k", content).checkpoint() for t in (left, right)]
    want = {1234: "only_left", 7: "changed", first: "changed", 2**41: "only_right", None: "changed"}
    assert {r["k"]: r["state"] for r in differing_rows(left, right, "k", content, *trees).collect()} == want
    nodes = {r["node"] for r in differing_ranges(*trees).collect()}
    assert nodes == {None if k is None else k >> 8 for k in want}
    assert {r["k"] for r in differing_rows(left.limit(0), frame([(5, "x")]), "k", content).collect()} == {5} and differing_rows(left.limit(0), left.limit(0), "k", content).count() == 0
