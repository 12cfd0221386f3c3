"""Row patterns, Merkle manifests and licence scans against brute force; and nulls, ties, empty and odd rows for each."""

import hashlib
import os
import random
import re
import zlib
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries as Q
from tallyloom.llm import row_patterns
from tallyloom.llm.license_scan import Library, license_labels, license_spans
from tallyloom.llm.license_templates import PHRASES, TEMPLATES
from tallyloom.llm.merkle_manifest import Mountains, folded, joined_hash, manifest, proof_hash
from tallyloom.llm.row_patterns import valleys

SMALL = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, value double, extra string, key string"


def cents_of(value):
    return None if value is None or value != value or abs(value) > 2**55 else int((100 * value + 0.5) // 1)


def plain_matches(rows, greedy=True):
    """A backtracking matcher, letter by letter, over each client's distinct rows."""
    out, clients = [], {}
    for r in set(rows):
        if r[2] is not None and r[1] is not None:
            clients.setdefault(r[2], []).append(r)
    for client, own in clients.items():
        own.sort(key=lambda r: (r[1], r[0]))
        cents = [cents_of(r[4]) for r in own]

        def fits(letter, k, a):
            if k >= len(own) or cents[k] is None or cents[k - 1] is None or own[k][1] - own[k - 1][1] > timedelta(minutes=5):
                return False
            if letter == "P":
                return own[k][3] == "click" and cents[k] >= cents[a]
            return own[k][3] not in (None, "error") and (cents[k] < cents[k - 1] if letter == "D" else cents[k] > cents[k - 1])

        n = 0
        for a in range(len(own)):
            if cents[a] is None:
                continue
            down = 0
            while fits("D", a + 1 + down, a):
                down += 1
            hit = None
            for d in range(down, 0, -1):
                up = 0
                while fits("U", a + 1 + d + up, a):
                    up += 1
                for u in range(up, 0, -1) if greedy else range(1, up + 1):
                    if fits("P", a + 1 + d + u, a):
                        hit = (d, u)
                        break
                if hit:
                    break
            if hit:
                n += 1
                last = a + 1 + sum(hit)
                out.append((client, n, own[a][0], own[last][0], last - a + 1, *hit, sum(c or 0 for c in cents[a : last + 1])))
    return sorted(out)


def by_operator(df, greedy=True):
    cents = F.when(~F.isnan("value"), F.floor(100 * F.col("value") + 0.5))
    found = valleys(df, "client_id", "ts", "click_id", cents, F.col("kind") != "error", F.col("kind") == "click", greedy=greedy)
    return sorted((r["key"], r["match_no"], r["first_row"], r["last_row"], r["n_rows"], r["n_down"], r["n_up"], r["total"]) for r in found.collect())


def clicks(seed, n, clients):
    rng, out, at = random.Random(seed), [], START
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 0, 0, 1, 1, 2, 60] if rng.random() < 0.98 else [300]), microseconds=rng.choice([0, 0, 0, 1]))
        kind = rng.choice(["click"] * 9 + ["view"] * 4 + ["error", None])
        value = rng.choice([None, float("nan"), float("inf"), 1e300, 0.125, -3.5]) if rng.random() < 0.06 else rng.randrange(9) * 1.0
        out.append((i, at, rng.choice(clients), kind, value, "x", "k"))
    return out + [(None, START, 1, "click", 1.0, "x", "k"), (7, None, 1, "click", 1.0, "x", "k"), (8, START, None, "click", 1.0, "x", "k")] + out[:20]


@pytest.mark.parametrize("greedy", [True, False])
def test_matches_equal_backtracking(spark, greedy):
    """One client in a third of the rows, equal times, repeated rows, nulls; over four chunks, and over as many as 40."""
    rows = clicks(1, 1500, [1, 1, 1, 2, 3, 4, 5])
    df = spark.createDataFrame(rows, CLICKS)
    want = plain_matches(rows, greedy)
    assert len(want) > 50 and by_operator(df, greedy) == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert by_operator(df, greedy) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("greedy", [True, False])
def test_a_valley_through_many_chunks(spark, greedy):
    """300 rows fall and 300 rise, twelve chunks and more, so tails wait for the chunks behind them."""
    way = [*range(900, 600, -1), *range(600, 902)]
    rows = [(i, START + timedelta(seconds=i), 1, "click" if i % 3 else "view", v / 1.0, "x", "k") for i, v in enumerate(way)]
    rows += [(1000 + i, START + timedelta(seconds=i), 2, "click", float(v), "x", "k") for i, v in enumerate([5, 4, 3, 9, 1, 2, 8, 8])]
    df = spark.createDataFrame(rows, CLICKS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "14")
    try:
        want = plain_matches(rows, greedy)
        assert len(want) > 290 and by_operator(df, greedy) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_patterns_of_empty_and_text_keys(spark):
    assert by_operator(spark.createDataFrame([], CLICKS)) == []
    rows = [(i, START + timedelta(seconds=i), None, "click", float(v), "x", "key") for i, v in enumerate([5, 4, 6, 6])]
    df = spark.createDataFrame(rows, CLICKS).withColumn("client_id", F.lit("ü"))
    assert [(r["key"], r["first_row"], r["last_row"], r["total"]) for r in valleys(df, "client_id", "ts", "click_id", F.col("value"), F.lit(True), F.lit(True)).collect()] == [("ü", 0, 3, 21)]
    assert [r["last_row"] for r in valleys(df, "client_id", "ts", "click_id", F.col("value"), F.lit(True), F.lit(True), greedy=False).collect()] == [3]


def test_patterns_of_the_table(spark):
    """The query equals its SQL and the plain matcher on the whole table."""
    con = duckdb.connect()
    con.sql(f"create view clicks as select * from '{SMALL}/clicks.parquet'")
    cols = ["client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256"]
    ours = sorted(tuple(r) for r in Q.op11_row_patterns(spark, SMALL).select(cols).collect())
    assert ours == sorted(con.sql(f"select {', '.join(cols)} from ({Q.oracle_sql()['op11_row_patterns']})").fetchall()) and ours
    rows = con.sql("select click_id, ts, client_id, kind, value, arrived_at, props from clicks").fetchall()
    assert [r[:6] for r in ours] == [(*m[:5], m[7]) for m in plain_matches(rows)]


def test_stacks_answer_like_plain_search():
    rng = random.Random(4)
    for greedy in (True, False):
        for _ in range(300):
            scan = row_patterns.Scan(0, greedy, True)
            amounts = [rng.randrange(12) for _ in range(rng.randrange(9))]  # pushed from right to left
            for k, a in enumerate(amounts):
                scan.push((True, k, a, k, 0))
            for x in range(-1, 13):
                enough = [k for k, a in enumerate(amounts) if a >= x]
                want = None if not enough else min(enough) if greedy else max(enough)
                hit = scan.found(x)
                assert (hit and hit[0]) == want


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text). By id and leaf: leaf, subroot, root, proof, folded root."""
    sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()

    def tree(leaves):
        """The root, and each leaf's steps (siblings, place)."""
        level, paths, of = list(leaves), [[] for _ in leaves], [[k] for k in range(len(leaves))]
        while len(level) > 1:
            runs = [range(a, min(a + 8, len(level))) for a in range(0, len(level), 8)]
            for run in runs:
                for k in run:
                    for leaf in of[k]:
                        paths[leaf].append(([level[j] for j in run if j != k], k - run[0]))
            of = [[x for k in run for x in of[k]] for run in runs]
            level = [sha(*(level[k] for k in run)) for run in runs]
        return level[0], paths

    first = lambda v: (v is not None, v if v is not None else 0)
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((first(r[0]), sha(*map(enc, r)), r))
    names = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:2])
        built[name] = tree([x[1] for x in trees[name]])
    root, upper = tree([built[name][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for (_, leaf, r), path in zip(trees[name], built[name][1], strict=True):
            path = path + upper[k]
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = None if r[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[4])
                at = sha(*map(enc, (*r[:4], text)))
            for siblings, place in path:
                at = sha(*siblings[:place], at, *siblings[place:])
            out.append((r[0], leaf, built[name][0], root, sha(*(s for siblings, _ in path for s in siblings)), at, at == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, row int, digest string"


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 3}, {"en": 9, "de": 65, "": 2, None: 1}, {f"l{k}": 1 + k * 7 for k in range(11)}, {"en": 700, "fr": 64}])
def test_manifest_equals_plain_hashing(spark, tmp_path, sizes):
    rng, rows = random.Random(3), []
    for lang, n in sizes.items():
        rows += [(rng.choice([None, 5]) if rng.random() < 0.05 else len(rows) + k, rng.choice([None, "s"]), lang, k, rng.choice([None, "", "Ab ü 日本", "plain", "ZZ" * 40])) for k in range(n)]
    rows.append(rows[0])
    rng.shuffle(rows)
    spark.createDataFrame([(*r, "t", 1, "d") for r in rows], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(tuple, Q.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str) == plain_manifest(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_manifest_of_the_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    ours = sorted(map(tuple, Q.op12_merkle_manifest(spark, SMALL).collect()), key=str)
    assert ours == plain_manifest(rows) and {r[6] for r in ours} == {True, False}


def test_manifest_of_no_rows_and_other_fanouts(spark):
    assert manifest(spark.createDataFrame([], DOCS), "lang", "doc_id", ["text"]).count() == 0
    df = spark.range(30).selectExpr("id as doc_id", "'x' as lang", "cast(id as string) as text")
    rows = manifest(df, "lang", "doc_id", ["text"], fanout=3).withColumn("again", folded(F.col("leaf"), F.col("path"))).withColumn("proof", proof_hash(F.col("path"))).collect()
    level = [hashlib.sha256(enc(str(i)).encode()).hexdigest() for i in range(30)]
    while len(level) > 1:
        level = [joined_hash(level[k : k + 3]) for k in range(0, len(level), 3)]
    assert {r["root"] for r in rows} == {r["again"] for r in rows} == {level[0]} and len({r["proof"] for r in rows}) == 30


def test_mountains_emit_whole_runs_and_peaks():
    m, out = Mountains(2), []
    for i in range(3, 9):
        out += m.push("t", i, (str(i), None, None))
    out += m.peaks()
    inner = [(level, i) for _, level, i, _, run in out if run and level]
    peaks = [(level, i) for _, level, i, _, run in out if not (run and level)]
    assert inner == [(1, 2), (1, 3), (2, 1)] and sorted(peaks) == [(0, 3), (0, 8), (2, 1)]


def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(label, k) for k in range(len(words)) for label, phrase in PHRASES if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), found


def test_phrases_equal_plain_search(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    n = 0
    for r in Q.op13_license_scan(spark, SMALL).collect():
        words, found = plain_places(texts[r["doc_id"]])
        labels = sorted({label for label, _ in found})
        at = [k for _, k in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (words, len(found), min(at, default=None), max(at, default=None), ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and r["labels"] == ",".join(sorted(filter(None, r["labels"].split(","))))
        n += len(found)
    assert n >= 2


def longest_runs(library, words):
    """Matching statistics by definition: the longest run of any template or phrase that ends at each word."""
    every = [tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) for _, t in (*PHRASES, *TEMPLATES)]
    runs = {s[a:b] for s in every for a in range(len(s)) for b in range(a + 1, min(len(s), a + 25) + 1)}
    return [max((n for n in range(1, min(k + 1, 25) + 1) if tuple(words[k - n + 1 : k + 1]) in runs), default=0) for k in range(len(words))]


def test_matching_statistics_equal_plain_search():
    library, rng = Library(TEMPLATES, PHRASES), random.Random(9)
    vocabulary = sorted({w for _, t in (*PHRASES, *TEMPLATES) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())})
    for _ in range(40):
        words = []
        while len(words) < 120:
            source = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rng.choice([*TEMPLATES, *PHRASES])[1].lower())
            a = rng.randrange(len(source))
            words += source[a : a + rng.randrange(1, 12)] if rng.random() < 0.7 else [rng.choice(vocabulary + ["unknown"])]
        n, places, matches = library.stream(" ".join(words))
        runs = longest_runs(library, words)
        want = [(k, runs[k]) for k in range(len(words)) if runs[k] >= library.shortest and (k + 1 == len(words) or runs[k + 1] != runs[k] + 1)]
        assert [(end, run) for _, run, end in matches] == want and n == len(words)
        assert sorted((library.labels[p], k) for p, k in places) == sorted(plain_places(" ".join(words))[1])


def test_license_spans(spark):
    label, text = TEMPLATES[0]
    half = " ".join(text.split()[:20])
    altered = text.replace("charge", "any charge").replace("sublicense, ", "").upper()
    rows = [(None, None), (1, ""), (2, f"Intro.\n{altered}\nNext. {text}"), (2, half), (3, "mit license " * 30_000), (4, "x" * 300_000), (5, "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."), (6, "the software is provided to you"), (6, "licensed\tunder CC-BY-NC\n4.0")]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n_words string, places int")
    found = sorted(license_labels(df).collect(), key=lambda r: (r["doc_id"] or 0, r["n_words"]))
    assert [(r["doc_id"], r["base_labels"], r["labels"]) for r in found] == [(None, "", ""), (1, "", ""), (2, "", ""), (2, "", "mit"), (3, "mit", "mit"), (4, "", ""), (5, "", "cc-by-nc"), (6, "", ""), (6, "", "cc-by-nc")]
    whole = found[3]
    spans = whole["spans"]
    assert [s["label"] for s in spans] == [label] * 2 and spans[1]["share"] == 1 and 0.9 < spans[0]["share"] < 1 and whole["score"] == 1
    assert rows[2][1][spans[1]["start"] : spans[1]["end"]] == text.rstrip(".") and rows[2][1][spans[0]["start"] :].startswith("PERMISSION")
    assert found[4]["n_base"] == 30_000 and found[4]["last_word"] == 59_998 and found[4]["score"] == 1
    assert 0 < found[2]["score"] < 0.75 and found[0]["n_words"] == 0 and found[0]["first_word"] is None and found[7]["score"] == 0
    assert license_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert license_labels(df, templates=(), phrases=()).filter("labels <> '' or score <> 0").count() == 0


def test_new_queries_leave_the_shared_folder_clean(spark, tmp_path):
    from tallyloom.llm import common

    before = set(os.listdir(common.scratch_dir(spark).removeprefix("file://"))) if os.path.isdir(common.scratch_dir(spark).removeprefix("file://")) else set()
    Q.op11_row_patterns(spark, SMALL).count()
    Q.op12_merkle_manifest(spark, SMALL).count()
    left = set(os.listdir(common.scratch_dir(spark).removeprefix("file://"))) - before
    assert sorted(x.split("-")[1] for x in left) == ["matches", "proofs"]
