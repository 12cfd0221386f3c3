"""Quantiles, interval joins, growing components, audits and selections against brute force on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import task_template
from tallyloom.operators.corpus import SimilarSets, hashed_shingles, similar_pairs
from tallyloom.operators.groups import components, near_groups
from tallyloom.operators.intervals import micros, overlap_totals, overlaps
from tallyloom.operators.isolation import group_selection, isolation_paths, merged_components
from tallyloom.operators.order import running_sums
from tallyloom.operators.pairing import applied_review, pair_dispositions, plan_states
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.operators.reconcile import clone_links


def plain_quantiles(values, disc, cont):
    v = sorted(x for x in values if x is not None and x == x)
    if not v:
        return [None] * (len(disc) + len(cont))
    out = [v[max(1, math.ceil(len(v) * p)) - 1] for p in disc]
    for p in cont:
        at = p * (len(v) - 1)
        a, b = v[math.floor(at)], v[math.ceil(at)]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out


@pytest.mark.parametrize("few", [1, 40, 20_000])
def test_quantiles_equal_sorting(spark, few):
    """Ties, heavy tails of both signs, zeros, infinities, NaN, nulls, a null group and a group without values; bins divided down to one value."""
    rng = random.Random(2)
    draw = {"tails": lambda: rng.choice([-1, 1]) * math.exp(rng.uniform(-600, 600)), "ties": lambda: rng.choice([0.0, -0.0, 2.5, 2.5, -7.0]), None: lambda: rng.gauss(5, 1e-9), "odd": lambda: rng.choice([None, float("nan"), float("inf"), -float("inf"), 5e-324, 1.0]), "one": lambda: 3.25}
    rows = [(g, f()) for g, f in draw.items() for _ in range(400)] + [("none", None), ("none", float("nan"))]
    disc, cont = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}, {"e": 0.5, "f": 0.99}
    found = exact_quantiles(spark.createDataFrame(rows, "k string, x double").repartition(7), F.col("k"), F.col("x"), disc, cont, few=few)
    for r in found.collect():
        values = [x for g, x in rows if g == r["g"]]
        want = plain_quantiles(values, disc.values(), cont.values())
        assert (r["n_rows"], r["n"]) == (len(values), sum(x is not None and x == x for x in values))
        for name, w in zip([*disc, *cont], want, strict=True):
            assert r[name] == w or (r["g"] == "odd" and name in cont) or w is not None and math.isclose(r[name], w, rel_tol=1e-12), (r["g"], name)
    assert found.count() == 6


def test_quantiles_of_large_longs_and_no_rows(spark):
    rows = [(2**62 + k,) for k in range(300)] + [(-(2**62) - k,) for k in range(200)]
    df = spark.createDataFrame(rows, "v long")
    r = exact_quantiles(df, F.lit("x"), F.col("v"), {"a": 0.001, "b": 0.4, "c": 0.402, "d": 0.9}, few=10).first()
    v = sorted(x for (x,) in rows)
    assert (r["a"], r["b"], r["c"], r["d"]) == (v[0], v[199], v[200], v[449])
    assert exact_quantiles(df.filter("v = 0"), F.lit(1), F.col("v"), {"a": 0.5}).count() == 0
    plan = exact_quantiles(df, F.lit("x"), F.col("v"), {"a": 0.5})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("crowd", [4_096, 30])
def test_overlaps_equal_all_pairs(spark, crowd):
    """Short, long, empty, reversed and unknown intervals; a crowded place whose bins are divided; negative times."""
    rng = random.Random(5)

    def side(n):
        rows = [(k, a := rng.randrange(-500, 3000), a + rng.choice([0, 1, 2, 7, 30])) for k in range(n)]
        rows += [(n + k, a := rng.randrange(-500, 3000), a + rng.choice([500, 4000, -3])) for k in range(8)]
        rows += [(2 * n + k, 1000 + k % 5, 1001 + k % 5) for k in range(60)]
        return rows + [(9999, None, 5), (9998, 5, None), (9997, 3, 3)]

    left, right = side(150), side(120)
    frames = [spark.createDataFrame(rows, "id long, start long, end long") for rows in (left, right)]
    found = overlaps(*frames, 10, crowd=crowd)
    real = lambda r: None not in r and r[1] < r[2]
    want = sorted((a[0], b[0], max(a[1], b[1]), min(a[2], b[2])) for a in filter(real, left) for b in filter(real, right) if a[1] < b[2] and b[1] < a[2])
    assert sorted(map(tuple, found.collect())) == want and len(want) > 1000
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert overlaps(frames[0].filter("id < 0"), frames[1], 10).count() == 0
    totals = {}
    for _, b, lo, hi in want:
        n, total = totals.get(b, (0, 0))
        totals[b] = n + 1, total + hi - lo
    summed = overlap_totals(*frames)
    assert {r["id"]: (r["n"], r["total"]) for r in summed.collect()} == totals
    assert overlap_totals(frames[0].filter("id < 0"), frames[1]).count() == 0


def test_totals_of_overlaps_form_no_pairs(spark):
    """Ten million pairs of intervals are summed from as many rows as there are different times."""
    same = spark.range(100_000).selectExpr("id", "id * 0 + 1700000000000000 AS start", "id * 0 + 1700000600000000 AS end")
    found = overlap_totals(same, same.filter("id < 100"))
    assert {tuple(r)[1:] for r in found.collect()} == {(100_000, 60_000_000_000_000)} and found.count() == 100


def test_microseconds(spark):
    r = spark.sql("select timestamp_ntz '2024-03-31 02:30:01.000123' as a, timestamp_ntz '1969-12-31 23:59:59.5' as b").select(micros(F.col("a")), micros(F.col("b"))).first()
    assert tuple(r) == (1711852201000123, -500000)


def test_components_grow_in_any_order(spark):
    """Links that come in two batches, either first, give what all links at once give; labels that aren't touched stay."""
    rng = random.Random(8)
    nodes = spark.range(120).withColumnRenamed("id", "doc_id")
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(1, 1), (200, 3), (200, 201)]
    frame = lambda rows: spark.createDataFrame(rows, "x long, y long")
    every = nodes.union(spark.createDataFrame([(200,), (201,)], "doc_id long"))
    want = {r["doc_id"]: r["component"] for r in components(every, frame(links)).collect()}
    for a, b in ((links[:40], links[40:]), (links[40:], links[:40])):
        start = nodes.withColumn("component", F.col("doc_id"))
        grown = merged_components(merged_components(start, frame(a)), frame(b))
        assert {r["doc_id"]: r["component"] for r in grown.collect()} == want
    none = merged_components(start, frame([]))
    assert none.filter("doc_id <> component").count() == 0 and none.count() == 120


def test_witness_paths(spark):
    """A chain of texts from an item on: distances, parents and paths, through copies too; texts apart from it have none."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    text = lambda a: " ".join(words[a : a + 120])
    docs = [(10, text(0)), (11, text(8)), (12, text(16)), (13, text(16)), (14, text(24)), (20, " ".join(words[::-1][:90])), (21, "short text"), (22, None), (23, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words[:12])), (6, " ".join(words[1:13])), (5, "nothing of the kind at all is in any of them"), (4, None)], "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in isolation_paths(df, items).select("doc_id", "distance", "kind", "parent", "item_id", "path").collect()}
    assert got == {10: (1, "held", 6, 6, "6>10"), 11: (2, "near", 10, 6, "6>10>11"), 12: (3, "near", 11, 6, "6>10>11>12"), 13: (3, "near", 11, 6, "6>10>11>13"), 14: (4, "near", 12, 6, "6>10>11>12>14")}
    assert isolation_paths(df, items.filter("item_id < 6")).count() == 0


def test_whole_groups_are_selected(spark):
    """Against a loop in order; ties of places, a null category, components with members that aren't eligible."""
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(25), f"{rng.randrange(30):02}", rng.random() < 0.7) for k in range(90)]
    first, sizes, so_far, want = {}, {}, {}, {}
    for k, c, comp, place, ok in rows:
        if ok:
            first[comp] = min(first.get(comp, (place, k, c)), (place, k, c), key=lambda x: x[:2])
            sizes[comp] = sizes.get(comp, 0) + 1
    totals = {}
    for comp in sorted(first, key=lambda x: first[x][:2]):
        of = first[comp][2]
        so_far[comp] = totals[of] = totals.get(of, 0) + sizes[comp]
    for k, _, comp, _, ok in rows:
        want[k] = "excluded" if not ok else "category_cap" if so_far[comp] > 9 else "selected"
    df = spark.createDataFrame(rows, "id long, category string, component long, place string, eligible boolean")
    got = group_selection(df, 9).collect()
    assert {r["id"]: r["disposition"] for r in got} == want and all(r["so_far"] == so_far.get(r["component"]) for r in got) and {*want.values()} == {"excluded", "category_cap", "selected"}


def test_running_sums(spark):
    rows = [(g, k, k % 5) for g in ("x", None, "y") for k in range(200 if g == "x" else 3)]
    got = running_sums(spark.createDataFrame(rows, "g string, k long, v long").repartition(3), "g", ["k"], "v", "s").collect()
    assert all(r["s"] == sum(v for g, k, v in rows if g == r["g"] and k <= r["k"]) for r in got) and len(got) == len(rows)


def test_plans_pairs_and_reviews(spark):
    """Missing, unplanned and repeated records; the first valid pair with all dispositions against a loop over all pairs; a review's gates."""
    plan, records = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long"), spark.createDataFrame([(1, 1), (1, 1), (1, 2), (3, 1), (None, 1)], "k long, part int")
    assert {tuple(r) for r in plan_states(plan, records, "k", "part").collect()} == {(1, "planned", 3, 1), (2, "missing", 0, 0), (3, "unplanned", 1, 0), (None, "planned", 1, 0)}
    rng = random.Random(4)
    rows = [(t, rng.randrange(12), rng.choice(["success", "failure", "unknown", None]), rng.choice([True, True, True, False, None])) for t in range(30) for _ in range(9)]
    want = {}
    for task in range(30):
        ids = {}
        for t, i, o, v in rows:
            if t == task:
                ids.setdefault(i, []).append((o, v))
        good = sorted((i, x[0][0]) for i, x in ids.items() if len(x) == 1 and x[0][1] and x[0][0] in ("success", "failure"))
        pairs = [(a, b) for k, a in enumerate(good) for b in good[k + 1 :]]
        valid = [p for p in pairs if p[0][1] != p[1][1]]
        first = sorted(valid[0], key=lambda x: x[1], reverse=True) if valid else ((None,), (None,))
        once = [x[0] for x in ids.values() if len(x) == 1]
        want[task] = (first[0][0], first[1][0], len(ids) - len(once), sum(not v for _, v in once), sum(bool(v) and o not in ("success", "failure") for o, v in once), len(good), len(pairs) - len(valid), len(valid), max(0, len(valid) - 1))
    got = {r["task"]: tuple(r)[1:] for r in pair_dispositions(spark.createDataFrame(rows, "task int, id int, outcome string, valid boolean")).collect()}
    assert got == want and any(w[0] is None for w in want.values()) and any(w[7] > 1 for w in want.values())
    pool = spark.range(100)
    gate = lambda sample, verdicts: tuple(applied_review(spark.createDataFrame([(k,) for k in sample], "id long"), pool, spark.createDataFrame(verdicts, "id long, verdict string")).first())
    fine = [(k, "pass") for k in range(40)]
    assert gate(range(20), [*fine[1:], (0, "fail"), (50, "unknown")]) == (20, 0, 1, 2, 98, False)
    assert gate(range(20), [*fine[2:], (0, "fail"), (1, "unknown")]) == (20, 0, 2, 2, 98, True) and gate(range(41), fine)[5] is True and gate([], fine)[5] is True


def test_similar_pairs_equal_all_pairs(spark):
    """Texts cut to every length about the limit of 85 in 100, edited ones, copies and short ones, against all pairs of their sets."""
    rng, texts = random.Random(7), []
    names = [chr(97 + k // 26) + chr(97 + k % 26) * 2 for k in range(400)]
    for base in range(3):
        own = rng.sample(names, 122)
        texts += [" ".join(own[: 122 - cut]) for cut in range(0, 40, 2)] + [" ".join(own), " ".join(own[:7])]
        for _ in range(12):
            edited = list(own)
            for _ in range(rng.randrange(1, 6)):
                edited[rng.randrange(122)] = rng.choice(names)
            texts.append(" ".join(edited))
    texts += ["", None, " ".join(names[:9]), " ".join(names[:10])]
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in enumerate(texts) if len(w := (t or "").split()) >= 8}
    reps = {k: min(j for j in sets if sets[j] == s) for k, s in sets.items()}
    want = sorted((a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and reps[a] == a and reps[b] == b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, similar_pairs(docs).collect())) == want and len(want) > 200
    groups = {r["doc_id"]: r["component"] for r in near_groups(docs).collect()}
    assert all(groups[a] == groups[b] for a, b, _, _ in want) and all(groups[k] == groups[r] for k, r in reps.items()) and len(set(groups.values())) >= 3


def test_shingles_are_hashed_without_python(spark):
    """Runs of words by their words, not their letters; sorted, without repeats; short and null texts have none."""
    texts = ["a b c d e f g h", "ab c d e f g h i", "a bc d e f g h i", "a b c a b c a b c a b c", "a b c", None]
    found = hashed_shingles(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")
    assert "Python" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "InArrow" not in plan
    rows = {r["doc_id"]: r for r in found.collect()}
    assert {k: r["n"] for k, r in rows.items()} == {0: 6, 1: 6, 2: 6, 3: 3} and all(r["h"] == sorted(set(r["h"])) for r in rows.values())
    assert len({h for r in rows.values() for h in r["h"]}) == 12


def test_sets_are_not_shuffled_to_be_confirmed(spark):
    """Sets of hashes stay where they were written; pairs and ids of few documents go to them."""
    words = [chr(97 + k % 26) + chr(97 + k // 26) for k in range(40)]
    texts = [" ".join(words), " ".join(words), " ".join([*words, "x"]), " ".join(reversed(words))]
    sets = SimilarSets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    pairs = sets.pairs()
    assert [(r["x"], r["y"]) for r in pairs.collect()] == [(0, 2)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan and "Python" not in plan and "InArrow" not in plan


def test_clones_are_found_without_a_shuffle_of_pairs(spark):
    rows = [(k, None if k % 7 == 0 else f"a{k % 3}", None if k % 5 == 0 else f"b{k % 2}") for k in range(60)]
    new, old = (spark.createDataFrame(rows[part], "id long, k1 string, k2 string") for part in (slice(30), slice(30, None)))
    found = clone_links(new, old, ["k1", "k2"])
    common = lambda a, b: ",".join(n for n, x, y in (("k1", a[1], b[1]), ("k2", a[2], b[2])) if x is not None and x == y)
    assert sorted(map(tuple, found.collect())) == sorted((a[0], b[0], c) for a in rows[:30] for b in rows[30:] if (c := common(a, b)))
    assert "collect_set" not in found._jdf.queryExecution().toString()


def test_templates_are_made_of_few_rows_at_a_time(spark):
    plan = spark.range(1).select(task_template(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan
