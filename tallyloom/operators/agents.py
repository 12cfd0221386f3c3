"""Queries over JSON, calls and schemas. The inputs are written from the tables, sound and broken ones in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import json_rules as J
from ..functions import schemas as S
from ..plans.registry import query
from ..session import ship_package
from ..sources.tables import table
from .judging import pick


@query("""SELECT event_id, rule, CASE WHEN rule IS NULL THEN CASE k WHEN 0 THEN props_c WHEN 1 THEN '[1,1.0,"<é>",null,true]' ELSE '{"a":{"b":[]},"z":' || props_c || '}' END END AS canonical, CASE WHEN rule IS NULL THEN CASE k WHEN 1 THEN 'array' ELSE 'object' END END AS kind, CASE WHEN rule IS NULL THEN CASE k WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 5 END END AS nodes, CASE WHEN rule IS NULL THEN CASE k WHEN 2 THEN 2 ELSE 1 END END AS depth
FROM (SELECT event_id, k, replace(props, ' ', '') AS props_c, CASE k WHEN 3 THEN 'duplicate_key' WHEN 4 THEN 'not_finite' WHEN 5 THEN 'trailing_text' WHEN 6 THEN 'not_json' WHEN 7 THEN 'too_deep' END AS rule FROM (SELECT event_id, props, event_id % 8 AS k FROM events))""")
def props_strict_json(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    wide = F.concat(F.lit(' {"z": '), F.col("props"), F.lit(', "a": {"b": []}}\n'))
    text = pick(F.col("event_id"), F.col("props"), '[1, 1.0, "<é>", null, true]', wide, F.concat(F.lit('{"k": 1, "k": '), F.col("props"), F.lit("}")), '{"k": NaN}', F.concat("props", F.lit(" x")), "{k: 1}", "[" * 66 + "]" * 66)
    found = table(spark, d, "events").select("event_id", J.column_of(J.json_report, J.REPORT, text).alias("r"))
    return found.select("event_id", "r.*")


def _call_report(text: str | None) -> dict:
    rule, found = J.outcome(C.parse_calls, text, ["find part", "find", "order"])
    back = None if rule else C.written_calls(found)
    same = None if rule else C.parse_calls(back, ["find part", "find", "order"]) == found
    return {"rule": rule, "n_calls": None if rule else len(found), "n_arguments": None if rule else sum(len(c["arguments"]) for c in found), "written": back, "same": same}


@query("""SELECT p_partkey, rule, CASE WHEN rule IS NULL THEN CASE k WHEN 1 THEN 2 ELSE 1 END END AS n_calls, CASE WHEN rule IS NULL THEN CASE k WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END END AS n_arguments, CASE WHEN rule IS NULL THEN CASE k WHEN 0 THEN '[find part(size=' || p_size || ', brand="' || p_brand || '")]' WHEN 1 THEN '[find(x={"a":[1,' || p_size || ']}), order()]' ELSE '[order()]' END END AS written, CASE WHEN rule IS NULL THEN true END AS same
FROM (SELECT *, ['', '', '', 'call_parameter_invalid', 'call_value_not_json', 'call_trailing_text', 'call_name_or_count', 'action_kind_unlabelled', 'call_parameter_invalid', 'call_syntax_unsupported', 'call_value_not_json', 'call_name_or_count'][k + 1] AS r0, nullif(r0, '') AS rule FROM (SELECT p_partkey, p_size, p_brand, p_partkey % 12 AS k FROM part))""")
def call_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    size, brand = F.col("p_size").cast("string"), F.col("p_brand")
    whole = F.concat(F.lit("[find part(size="), size, F.lit(', brand="'), brand, F.lit('")]'))
    text = pick(
        F.col("p_partkey"), whole, F.concat(F.lit(' [ find( x = {"a": [1, '), size, F.lit("]} ) , order()]\n")), "[order( )]", F.concat(F.lit("[find("), size, F.lit(")]")),
        F.concat(F.lit("[find(brand='"), brand, F.lit("')]")), F.concat(whole, F.lit(" and more")), "[found(x=1)]", "find(x=1)", "[find(x=1, x=2)]", "[find(x=1]", "[find(x=NaN)]", "[" + ", ".join(["order()"] * 17) + "]",
    )
    found = J.column_of(_call_report, "struct<rule string, n_calls bigint, n_arguments bigint, written string, same boolean>", text)
    return table(spark, d, "part").select("p_partkey", found.alias("r")).select("p_partkey", "r.*")


_MARKER = "Functions that can be called, as JSON:"


def _list_report(text: str | None) -> dict:
    rule, found = J.outcome(C.listed_tools, text, _MARKER)
    return {"rule": rule, "n_tools": None if rule else len(found[0]), "n_characters": None if rule else found[2] - found[1]}


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'unsupported_tool_format' WHEN 2 THEN 'tool_json_invalid' WHEN 3 THEN 'tool_list_shape' END AS rule, CASE WHEN s_suppkey % 4 = 0 THEN 2 END AS n_tools, CASE WHEN s_suppkey % 4 = 0 THEN 26 + length(s_name) END AS n_characters FROM supplier""")
def tool_lists(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    tools = F.concat(F.lit('[{"name": "'), F.col("s_name"), F.lit('"}, {"n": "b"}] x'))
    mark = F.lit(f"You may call. {_MARKER} ")
    text = pick(F.col("s_suppkey"), F.concat(mark, tools), F.concat(mark, mark, tools), F.concat(mark, F.lit("[{]")), F.concat(mark, F.lit("[1, 2]")))
    found = J.column_of(_list_report, "struct<rule string, n_tools bigint, n_characters bigint>", text)
    return table(spark, d, "supplier").select("s_suppkey", found.alias("r")).select("s_suppkey", "r.*")


_ARGUMENTS = {"type": "object", "properties": {"size": {"type": "integer", "minimum": 1, "maximum": 40}, "brand": {"type": "string", "maxLength": 8}, "tags": {"type": "array", "items": {"enum": [1, "a"], "type": "integer"}, "maxItems": 2}}, "required": ["size"], "additionalProperties": False}


@query("""SELECT p_partkey, CASE WHEN k = 1 THEN 'argument_type' WHEN k = 2 THEN 'argument_missing' WHEN k = 3 THEN 'argument_undeclared' WHEN p_size > 40 THEN 'argument_range' WHEN k = 0 AND length(p_brand) > 8 THEN 'argument_size' WHEN k = 4 THEN 'argument_enum' END AS rule FROM (SELECT *, p_partkey % 6 AS k FROM part)""")
def argument_checks(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    size, brand = F.col("p_size").cast("string"), F.col("p_brand")
    text = pick(F.col("p_partkey"), F.concat(F.lit('{"size": '), size, F.lit('.0, "brand": "'), brand, F.lit('"}')), '{"size": true}', '{"brand": "x"}', '{"size": 5, "z": 1}', F.concat(F.lit('{"size": '), size, F.lit(', "tags": [1, 2]}')), F.concat(F.lit('{"size": '), size, F.lit(', "tags": [1, 1.0]}')))
    return table(spark, d, "part").select("p_partkey", J.column_of(lambda t: S.argument_problem(_ARGUMENTS, J.strict(t)), "string", text).alias("rule"))


@query("""SELECT s_suppkey, k <> 2 AS same_shape, k <> 2 AS same_semantics_key, k = 0 OR k = 1 AS same_text FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS k FROM supplier)""")
def equivalent_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Two writings of a schema: equal up to spaces, up to key order, up to annotations, and different by a bound."""
    ship_package(spark)
    base = '{"type": "object", "properties": {"a": {"type": "string", "maxLength": 5}}, "required": ["a"], "additionalProperties": false}'
    other = pick(F.col("s_suppkey"), base.replace(" ", ""), '{"additionalProperties": false, "required": ["a"], "properties": {"a": {"maxLength": 5, "type": "string"}}, "type": "object"}', base.replace('"maxLength": 5', '"maxLength": 5, "description": "d"'), base.replace("5", "6"))
    report = lambda t: {"same_shape": S.shape(J.strict(t)) == S.shape(J.strict(base)), "same_semantics_key": J.digest(S.semantics(J.strict(t))) == J.digest(S.semantics(J.strict(base))), "same_text": J.dumped(J.strict(t)) == J.dumped(J.strict(base))}
    return table(spark, d, "supplier").select("s_suppkey", J.column_of(report, "struct<same_shape boolean, same_semantics_key boolean, same_text boolean>", other).alias("r")).select("s_suppkey", "r.*")


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 2 THEN 'call_id_repeated' WHEN 3 THEN 'kind_and_content' WHEN 4 THEN 'over_complexity' END AS rule, CASE s_suppkey % 5 WHEN 0 THEN '{"content":"a \\u003c b","kind":"final","tool_calls":[]}' WHEN 1 THEN '{"content":"","kind":"tool_calls","tool_calls":[{"arguments":{"q":"' || s_name || '"},"call_id":"c1","name":"find"}]}' END AS written, CASE s_suppkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 9 END AS nodes, CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 END AS depth FROM supplier""")
def action_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Actions parsed within the bounds of run time, written without angle brackets, and parsed back."""
    ship_package(spark)
    call = F.concat(F.lit('{"call_id": "c1", "name": "find", "arguments": {"q": "'), F.col("s_name"), F.lit('"}}'))
    calls = lambda *c: F.concat(F.lit('{"kind": "tool_calls", "content": "", "tool_calls": ['), *c, F.lit("]}"))
    text = pick(F.col("s_suppkey"), '{"kind": "final", "tool_calls": [], "content": "a < b"}', calls(call), calls(call, F.lit(","), call), '{"kind": "final", "tool_calls": [], "content": ""}', "[" * 30 + "]" * 30)

    def report(t: str | None) -> dict:
        rule, value = J.outcome(J.parsed_action, t)
        nodes, depth = (None, None) if rule else J.size(value)
        written = None if rule else J.escaped(value)
        if written is not None and J.parsed_action(written) != value:
            raise AssertionError("not the same action")
        return {"rule": rule, "written": written, "nodes": nodes, "depth": depth}

    return table(spark, d, "supplier").select("s_suppkey", J.column_of(report, "struct<rule string, written string, nodes bigint, depth bigint>", text).alias("r")).select("s_suppkey", "r.*")
