"""Every registered query of the core against its DuckDB SQL on the smallest tables, and a few golden values."""

import os

import duckdb
import pytest

from tallyloom import catalog
from tallyloom.functions.records import canonical, equivalent_texts
from tallyloom.operators.corpus import exact_dedup
from tallyloom.operators.evaluation import bootstrap_interval
from tallyloom.operators.groups import components
from tallyloom.operators.selection import quotas
from tallyloom.operators.tools import merged_intervals

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted((tuple(str(r[c]) for c in cols) for r in df.collect()))
    theirs = duck.sql(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert ours == sorted(tuple(map(str, r)) for r in theirs)


def test_components_of_a_chain_and_a_star(spark):
    nodes = spark.range(40).withColumnRenamed("id", "doc_id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(15)] + [(20, k) for k in range(21, 30)], "x long, y long")
    found = {r["doc_id"]: r["component"] for r in components(nodes, edges).collect()}
    assert all(found[i] == 0 for i in range(16)) and all(found[i] == 20 for i in range(20, 30)) and found[39] == 39


def test_golden_values(spark):
    assert bootstrap_interval([(-1, 1), (1, 1)], 2000) == (-1.0, 1.0)
    assert quotas({"a": 1, "b": 99}, 10) == {"a": 1, "b": 9}
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2)], "k long, start long, end long")
    assert sorted((r["start"], r["end"]) for r in merged_intervals(spans, "k").collect()) == [(0, 7), (9, 10)]
    rows = spark.createDataFrame([(2, "x"), (1, "x"), (3, None)], "i long, k string")
    assert {r["i"]: r["kept"] for r in exact_dedup(rows, "k", ["i"]).collect()} == {1: True, 2: False, 3: True}


def test_json_functions():
    assert canonical('{"b": 1.0, "a": "é"}') == '{"a":"é","b":1.0}' and canonical("NaN") is None and canonical(None) is None and canonical("{") is None
    assert equivalent_texts('{"a": 1, "b": [2]}', '{"b": [2.0], "a": 1.00}') is True
    assert equivalent_texts("1", "true") is False and equivalent_texts("[1, 2]", "[2, 1]") is False and equivalent_texts("x", "1") is None
