"""Sources, sinks and streams on small files; JSON, call and schema rules on single values."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import calls, json_rules, schemas
from tallyloom.functions.json_rules import outcome
from tallyloom.functions.text import template_of
from tallyloom.operators.evaluation import bootstrap_status
from tallyloom.operators.order import numbered
from tallyloom.sources import arrays, lines, publish, tables
from tallyloom.streaming.windows import first_requests, tumbling


def test_strict_json_files(spark, tmp_path):
    for name, data in {"a": b'{"b": [1, 1.0], "a": "\xc3\xa9"}', "b": b'{"a": 1, "a": 2}', "c": b'"\xff"', "d": b"", "e": b"[1] x", "f": b"1" * 40}.items():
        (tmp_path / f"{name}.json").write_bytes(data)
    rows = {r["path"][-6]: r for r in tables.read_whole_json(spark, f"file://{tmp_path}", most=35).collect()}
    assert {k: r["rule"] for k, r in rows.items()} == {"a": None, "b": "duplicate_key", "c": "not_json", "e": "trailing_text", "f": "over_bytes"}
    assert rows["a"]["canonical"] == '{"a":"é","b":[1,1.0]}' and rows["a"]["nodes"] == 5 and rows["a"]["depth"] == 2


def test_json_lines(spark, tmp_path):
    (tmp_path / "x").write_text('{"a":  1}\n\nNaN\n[2]')
    (tmp_path / "y").write_text("")
    rows = sorted((r["at"], r["line"], r["rule"], r["canonical"]) for r in lines.read_json_lines(spark, f"file://{tmp_path}").collect())
    assert rows == [(0, '{"a":  1}', None, '{"a":1}'), (1, "", "not_json", None), (2, "NaN", "not_finite", None), (3, "[2]", "no_line_end", None)]
    df = spark.createDataFrame([(1, '{"b": 1, "a": [ ]}', "s"), (2, "3", "t")], "i int, j string, split string")
    tables.write_canonical_lines(df, f"file://{tmp_path}/out", "j", "split")
    assert {(r["value"], r["split"]) for r in spark.read.text(f"file://{tmp_path}/out").collect()} == {('{"a":[],"b":1}', "s"), ("3", "t")}
    with pytest.raises(Exception, match="refused: not_finite"):
        tables.write_canonical_lines(spark.createDataFrame([("NaN",)], "j string"), f"file://{tmp_path}/bad", "j")


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "x,y"), (2, None, None)], "i int, l array<int>, t string")
    tables.write_csv(df, f"file://{tmp_path}/c")
    rows = tables.read_csv_strings(spark, f"file://{tmp_path}/c", ["i", "l", "t"]).collect()
    assert sorted((r["i"], r["l"], r["t"]) for r in rows) == [("1", "[1,2]", "x,y"), ("2", None, None)]
    with pytest.raises(ValueError):
        tables.read_csv_strings(spark, "file:///none", ["i", "i"])
    with pytest.raises(Exception, match="(?i)header|schema|malformed"):
        tables.read_csv_strings(spark, f"file://{tmp_path}/c", ["i", "wrong", "t"]).collect()


def test_json_lines_by_byte_ranges(spark, tmp_path):
    """Many tasks give what one gives: places, ends, marks, bad bytes and long lines, with lines across the ranges' bounds."""
    data = {"a": b"".join(b'{"k": %d, "t": "%s"}\n' % (k, b"x" * (k % 90)) for k in range(3000)), "b": b"\xef\xbb\xbf[1]\n[2]\n", "c": b"\xef\xbb\xbf[1]\n[2]", "d": b"", "e": b"\n\n1\r\n\xff\n" + b'"' + b"y" * 500 + b'"\n', "f": "\u00e9\u2028\n".encode(), "g": b"[1]\n[2]"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = lines.read_json_lines(spark, f"file://{tmp_path}", longest=400)
        assert found.rdd.getNumPartitions() > 8
        rows = {}
        for r in found.collect():
            rows.setdefault(r["path"][-1], {})[r["at"]] = r
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, content in data.items():
        parts = content.split(b"\n")
        ended = parts.pop() == b""
        parts = parts if ended else content.split(b"\n")
        assert sorted(rows.get(name, {})) == list(range(len(parts)))
        for k, raw in enumerate(parts):
            r = rows[name][k]
            try:
                text = raw.decode()
                rule = json_rules.json_report(text)["rule"]
            except UnicodeDecodeError:
                text, rule = None, "not_utf8"
            rule = "no_line_end" if not ended and k == len(parts) - 1 else "over_bytes" if len(raw) > 400 else rule
            assert (r["line"], r["rule"]) == (text, rule), (name, k)
    verdicts = {r["path"][-1]: (r["n_records"], r["n_refused"], r["first_at"], r["verdict"]) for r in lines.line_verdicts(found).collect()}
    assert verdicts["a"] == (3000, 0, None, "valid") and verdicts["g"] == (2, 1, 1, "invalid") and verdicts["c"][1] == 2 and "d" not in verdicts
    checked = lines.read_json_lines(spark, f"file://{tmp_path}/a", check=lambda v: "odd" if v["k"] % 2 else None)
    assert checked.filter("rule = 'odd'").count() == 1500


def test_publish_once(spark, tmp_path):
    df = spark.createDataFrame([(k, chr(97 + k % 3)) for k in range(50)], "i int, s string").repartition(4)
    root = f"file://{tmp_path}/p"
    manifest = publish.publish(df, root)
    assert manifest["rows"] == 50 and len(manifest["files"]) == 4 and sum(f["rows"] for f in manifest["files"]) == 50
    assert publish.publish_violations(spark, root).count() == 0
    assert sorted(map(tuple, publish.published(spark, root).collect())) == sorted((k, chr(97 + k % 3)) for k in range(50))
    with pytest.raises(FileExistsError):
        publish.publish(df, root)
    first = manifest["files"][0]["path"]
    (tmp_path / "p" / first).write_bytes(b"other")
    (tmp_path / "p" / manifest["files"][1]["path"]).unlink()
    (tmp_path / "p" / manifest["folder"] / "part-x.parquet").write_bytes(b"more")
    assert sorted(r["problem"] for r in publish.publish_violations(spark, root).collect()) == ["changed", "extra", "missing"]
    assert publish.publish(df.limit(0), f"{tmp_path}/none")["files"] == [] and publish.published(spark, f"{tmp_path}/none", "i int").count() == 0


def test_a_publish_that_fails_leaves_nothing(spark, tmp_path):
    """A failing row, a failing task attempt, and a folder that a killed driver left behind: a rerun succeeds."""
    root = f"file://{tmp_path}/q"
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("no such row"))).otherwise(F.col("id")).alias("i"))
    with pytest.raises(Exception, match="no such row"):
        publish.publish(bad, root)
    left = tmp_path / "q"
    assert not (left / "manifest.json").exists()
    (left / "data-dead").mkdir(parents=True)
    (left / "data-dead" / "part-1.parquet").write_bytes(b"half a file")
    assert publish.publish(spark.range(40), root)["rows"] == 40 and publish.published(spark, root).count() == 40
    # Two writers at once: the second finds the manifest at its commit, and takes its own folder away.
    second = publish._data_source()
    spark.dataSource.register(second)
    with pytest.raises(Exception, match="published already"):
        spark.range(5).write.format("exclusive_parquet").option("folder", "data-late").mode("append").save(root)
    assert not (left / "data-late").exists() and publish.published(spark, root).count() == 40


def test_manifests(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "i int, split string").write.partitionBy("split").parquet(f"file://{tmp_path}/data")
    found = tables.relative(tables.artifact_hashes(spark, f"file://{tmp_path}/data"), f"file://{tmp_path}/data").filter("path like '%.parquet'")
    assert tables.manifest_violations(found, found).count() == 0 and tables.content_fingerprint(found).first()["n"] == 2
    one = found.orderBy("path").first()["path"]
    listed = spark.createDataFrame([(one, "0"), ("../out", "0"), ("gone", "0"), ("twice", "0"), ("twice", "0")], "path string, sha256 string")
    problems = {r["path"]: r["problem"] for r in tables.manifest_violations(found, listed).collect()}
    assert problems.pop(one) == "changed" and problems.pop("../out") == "escapes" and problems.pop("gone") == "missing" and problems.pop("twice") == "repeated" and set(problems.values()) == {"extra"}


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 1009,) for i in range(500)], "k long").repartition(5)
    found = {r["k"]: r["i"] for r in numbered(rows, "k", "i").collect()}
    assert [found[k] for k in sorted(found)] == list(range(500)) and numbered(rows.limit(0), "k", "i").count() == 0


def test_streams(spark, tmp_path):
    """Late rows are dropped by the watermark, and a request is answered once within it."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    batches = [[(1, "2024-01-01 00:05:00", 1, "click", 1.0), (2, "2024-01-01 00:06:00", 1, "click", 2.0)], [(3, "2024-01-01 03:00:00", 2, "view", 5.0)], [(5, "2024-01-01 05:00:00", 2, "view", 1.0)], [(4, "2024-01-01 00:07:00", 1, "click", 9.0), (6, "2024-01-01 09:00:00", 2, "view", 1.0)]]
    for k, rows in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "ts", "user_id", "event_type", "value"), r, strict=True))) for r in rows))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in this order

    def run(make, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        started = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        started.awaitTermination(120)
        return spark.table(name).collect()

    windows = {(str(r["h"]), r["event_type"]): (r["n"], r["total"]) for r in run(lambda s: tumbling(s).select(F.col("w.start").alias("h"), "event_type", "n", "total"), "windows")}
    assert windows[("2024-01-01 00:00:00", "click")] == (2, 3.0)  # the row that came two hours late isn't in
    assert sorted(r["event_id"] for r in run(lambda s: first_requests(s, "30 days"), "requests")) == [1, 3]


def test_calls_and_protocols():
    names = ["f", "f g", "g"]
    good = calls.parse_calls(' [f(a={"x": [1]}, b="q)"), f g( )] ', names)
    assert good == [{"name": "f", "arguments": {"a": {"x": [1]}, "b": "q)"}}, {"name": "f g", "arguments": {}}]
    assert calls.parse_calls(calls.written_calls(good), names) == good
    for text, rule in {"f()": "action_kind_unlabelled", "[h()]": "call_name_or_count", "[]": "call_name_or_count", "[f(1)]": "call_parameter_invalid", "[f(a=1 b=2)]": "call_syntax_unsupported", "[f(a=1,)]": "call_parameter_invalid", "[f(a='x')]": "call_value_not_json", '[f(a={"b":1,"b":2})]': "call_value_not_json", "[f()": "call_syntax_unsupported", "[f()] x": "call_trailing_text", "[f(": "call_syntax_unsupported"}.items():
        assert outcome(calls.parse_calls, text, names) == (rule, None), text
    assert outcome(calls.parse_calls, "[f()]", ["f", "f"])[0] == "ambiguous_tool_names" and outcome(calls.parse_calls, "[" + "x" * 131_072, names)[0] == "call_text_budget"
    assert outcome(calls.parse_calls, "[f(" + ", ".join(f"a{i}=1" for i in range(129)) + ")]", names)[0] == "call_parameter_budget"


def test_schema_values():
    raw = {"type": "dict", "properties": {"a/b": {"type": "int"}, "description": {"type": "string", "description": "x"}}, "required": ["a/b"]}
    assert schemas.shape(raw)["properties"].keys() == {"a/b"}  # a property so named goes, too
    assert schemas.semantics(raw)["properties"].keys() == {"a/b", "description"}
    assert schemas.argument_problem(raw, {"a/b": 2.0}) is None and schemas.argument_problem(raw, {"a/b": True}) == "argument_type" and schemas.argument_problem(raw, {}) == "argument_missing"
    rows = schemas.schema_rows(raw, "/parameters")
    assert [r["pointer"] for r in rows] == ["/parameters", "/parameters/properties/a~1b", "/parameters/properties/description"] and rows[0]["ends"] == 2
    assert schemas.edited('{"a/b": {"c": [1, 2]}}', [("/a~1b/c", None), ("/a~1b/d", '"é"')]) == '{"a/b":{"d":"é"}}'
    deep = {"type": "null"}
    for _ in range(60):
        deep = {"type": "array", "items": deep, "maxItems": 1}
    assert len(schemas.schema_rows(deep, "")) == 33


def test_small_rules():
    assert outcome(json_rules.strict, "[" * 65 + "]" * 65)[0] is None and outcome(json_rules.strict, "[" * 66 + "]" * 66)[0] == "too_deep" and outcome(json_rules.strict, "[" * 100_000)[0] in ("too_deep", "not_json")
    assert outcome(json_rules.bounded, json.dumps(list(range(9000))))[0] == "over_complexity" and outcome(json_rules.bounded, '"' + "x" * 140_000 + '"')[0] == "over_bytes" and outcome(json_rules.strict, "1e999")[0] == "not_finite"
    assert template_of('Call “Ada” at HTTP://x.y/z on 2024-05-06, ｆｕｌｌ ß 日本 ２') == "call SLOT at URL on NUMBER full ss 日 本 NUMBER" and template_of(None) is None
    assert bootstrap_status([]) == ("NO_DATA", None, None) and bootstrap_status([(1, 2)])[0] == "NOT_ESTIMABLE" and bootstrap_status([(None, 2), (1, 1)])[0] == "INCOMPLETE_SCORING" and bootstrap_status([(-1, 1), (1, 1)]) == ("CALCULATED", -1.0, 1.0)


def test_packed_arrays(spark, tmp_path):
    """Any range of rows comes back as it was, from the blocks that hold it; null and empty sequences, long ones, items that don't fit."""
    rows = [(k * 3, None if k == 5 else list(range(k % 17)) + [65_535] * (k % 2)) for k in range(200)] + [(10_000, list(range(3000)))]
    df = spark.createDataFrame(rows, "i long, v array<int>").repartition(5)
    path = f"file://{tmp_path}/a"
    arrays.write_arrays(df, path, "i", "v", width=2, most=100)
    want = sorted((i, v or []) for i, v in rows)
    for start, stop in ((0, None), (0, 1), (37, 143), (200, 500), (50, 50), (900, None)):
        got = arrays.read_arrays(spark, path, start, stop).orderBy("row").collect()
        assert [(r["id"], r["items"]) for r in got] == want[start:stop] and [r["row"] for r in got] == list(range(start, start + len(got)))
        assert all(r["start"] == sum(len(v) for _, v in want[: r["row"]]) for r in got)
    with pytest.raises(Exception, match="doesn't fit"):
        arrays.write_arrays(df, f"file://{tmp_path}/b", "i", "v", width=1)
    arrays.write_arrays(df.limit(0), f"file://{tmp_path}/c", "i", "v")
    assert arrays.read_arrays(spark, f"file://{tmp_path}/c").count() == 0


def test_deadlines_of_a_stream(spark, tmp_path):
    """A stream in several files, out of order within the watermark, gives what the batch gives; rows beyond the watermark are dropped."""
    from datetime import datetime, timedelta
    import random

    from tallyloom.streaming.deadlines import outcomes, outcomes_of_stream

    rng, start = random.Random(6), datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=40 * k + rng.randrange(30), microseconds=rng.randrange(3)), rng.randrange(4), rng.choice(["click", "click", "purchase", "error", "view"])) for k in range(240)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    parts = [rows[:100], rows[100:]]
    for part in parts:
        rng.shuffle(part)
    for name, part in (("a", parts[0]), ("b", parts[1]), ("c", [(900, start + timedelta(days=3), 9, "click")]), ("d", [(901, start + timedelta(minutes=5), 0, "click"), (902, start + timedelta(days=9), 9, "click")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{name}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name in "abcd":
            os.makedirs(tmp_path / "live", exist_ok=True)
            for f in (tmp_path / "in" / name).glob("*.parquet"):
                os.rename(f, tmp_path / "live" / f"{name}-{f.name}")
            stream = outcomes_of_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/live"))
            writer = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").outputMode("append").trigger(availableNow=True)
            writer.start(f"file://{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    want = sorted(tuple(r) for r in outcomes(spark.createDataFrame(rows + [(900, start + timedelta(days=3), 9, "click")], schema)).collect())
    assert got == want and {r[2] for r in got} == {"dispatched", "cancelled", "timed_out"}
