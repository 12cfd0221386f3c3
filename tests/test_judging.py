"""Tool schemas, protocols, traces and decisions on small tables, against what each case must give."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.json_rules import strict
from tallyloom.operators import toolschemas
from tallyloom.operators.judging import decision_rules, dependencies, judged_traces, pair_comparisons, preferred_pairs, protocol_breaks
from tallyloom.operators.toolschemas import catalog_counts, flag_rows, policy_edits, policy_tools, prompt_projection, strict_tools

CLOSED = {"type": "object", "properties": {"a": {"type": "string", "maxLength": 5}}, "required": ["a"], "additionalProperties": False}


def tool(parameters, **more):
    return {"name": "f", "description": "d", "parameters": parameters, **more}


def frame(spark, values, name="tool"):
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in enumerate(values)], f"id int, {name} string")


def test_flags(spark):
    deep = {"type": "null"}
    for _ in range(14):
        deep = {"type": "array", "items": deep, "maxItems": 1}
    ready = {"tool_version": "1", "timeout_ms": 5, "side_effect_class": "read_only"}
    cases = [
        (tool(CLOSED, **ready), set()), (tool(CLOSED), {"side_effect_unknown_or_forbidden", "tool_runtime_metadata_missing"}), (tool({**CLOSED, "properties": {"x": deep}, "required": []}, **ready), {"schema_depth_or_shape", "schema_contract_rejected"}),
        (tool({"type": "object"}, **ready), {"schema_object_unclosed", "schema_properties_missing", "schema_contract_rejected"}), (tool({"type": "array", "maxItems": 5}, **ready), {"schema_depth_or_shape", "schema_contract_rejected"}),
        (tool({**CLOSED, "properties": {"a": {"type": "string", "maxLength": True}}}, **ready), {"schema_contract_rejected"}), (tool({**CLOSED, "required": ["z"]}, **ready), {"schema_contract_rejected"}), (tool(None, **ready), {"schema_depth_or_shape", "schema_contract_rejected"}),
        ({**tool(CLOSED, **ready), "name": "Not Fit"}, {"tool_name_incompatible"}), (tool({**CLOSED, "properties": {"a": {"type": "array", "items": {"type": "integer", "pattern": "x"}}}}, **ready), {"schema_array_unbounded", "schema_keyword_unsupported", "schema_contract_rejected"}),
    ]
    found = {}
    for r in flag_rows(frame(spark, [c for c, _ in cases])).collect():
        found.setdefault(r["id"], set()).add(r["flag"])
    assert [found.get(k, set()) for k in range(len(cases))] == [w for _, w in cases]
    more = [tool(CLOSED, **ready), tool(CLOSED), tool(CLOSED, extra=1), tool(CLOSED, **{**ready, "timeout_ms": 0}), tool(CLOSED, **{**ready, "timeout_ms": True})]
    assert [r["rule"] for r in strict_tools(frame(spark, more)).orderBy("id").collect()] == [None, "tool_incompatible", "tool_metadata_ambiguous", "tool_contract_rejected", "tool_contract_rejected"]


def test_tools_made_portable(spark):
    raw = {"name": "Größe Of", "description": "d", "parameters": {"type": "dict", "properties": {"a/b": {"type": "int", "default": 3, "description": "say \"x\""}, "t": {"type": "array", "items": {"type": "string"}}}}}
    bad = [
        ({"type": "any"}, "policy_schema_type_unknown"), ({"type": "object", "properties": {"a": {"type": "int", "default": "x"}, "b": {"type": "odd"}}}, "policy_default_conflicts_with_schema"), ({"type": "object", "properties": {"a": {"type": "odd"}}, "additionalProperties": True}, "policy_explicit_open_object"),
        ({"type": "array"}, "policy_array_items_missing"), ({"type": "object", "properties": {"s": {"type": "string", "maxLength": 1 << 20}}}, "policy_explicit_bound_invalid_or_too_wide"), ({"type": "string"}, "policy_tool_contract_rejected"),
        ({"type": "object", "properties": {}, "required": ["z"]}, "policy_tool_contract_rejected"), ({"type": "object", "properties": {"s": {"type": "string", "default": "y" * 16_380}}}, "policy_default_description_too_long"), ({"type": "object"}, "policy_schema_properties"),
    ]
    tools = [raw, *(tool(p) for p, _ in bad), tool(CLOSED, required=["a"]), tool(CLOSED, more=1), {**tool(CLOSED), "name": ""}, {**tool(CLOSED), "description": 5}]
    rows = policy_tools(frame(spark, tools)).orderBy("id").collect()
    assert [r["rule"] for r in rows] == [None, *(w for _, w in bad), "policy_outer_required_ambiguous", "policy_tool_metadata_unknown", "source_tool_name_missing", "policy_description_not_string"]
    made = strict(rows[0]["tool"])
    assert made["name"].startswith("ta_gr_e_of_") and made["parameters"]["type"] == "object" and made["parameters"]["additionalProperties"] is False
    inner = made["parameters"]["properties"]
    assert inner["a/b"] == {"type": "integer", "description": 'say "x"\nSource default annotation (never auto-filled): 3.'} and inner["t"] == {"type": "array", "items": {"type": "string", "maxLength": 16_384}, "maxItems": 1000}
    edits = {(r["pointer"], r["reason"]) for r in policy_edits(frame(spark, tools[:1]))[1].collect()}
    assert ("/parameters/properties/a~1b/type", "explicit_type_alias") in edits and ("/name", "reversible_name_mapping") in edits and len(edits) == 8
    ready = {"tool_version": "1", "timeout_ms": 5, "side_effect_class": "read_only"}
    assert flag_rows(frame(spark, [made | ready])).count() == 0  # what the policy makes is portable


def test_catalog(spark):
    tools = spark.createDataFrame([(json.dumps(tool({"type": ["string"], "default": None})), 2), (json.dumps(tool(5)), 1)], "tool string, n long")
    assert {tuple(r) for r in catalog_counts(tools).collect()} == {("node", "union", 2), ("keyword", "type", 2), ("keyword", "default", 2), ("default", "union:null", 2), ("count", "invalid_or_excessively_deep_node", 1)}


def test_prompts(spark):
    ask = [[{"role": "user", "content": "q"}]]
    prompt = lambda *names, question=ask, parameters=CLOSED, **more: {"id": 1, "question": question, "function": [{"name": n, "description": "d", "parameters": parameters} for n in names], **more}
    float_ = {**CLOSED, "type": "dict", "properties": {"a": {"type": "float"}}, "required": []}
    two = {"type": "object", "properties": {"a": {"type": "array", "pattern": 1}, "b": 5}}
    cases = [prompt("a.B", "c"), prompt("x", parameters=float_), prompt("a", "a"), prompt("a b"), prompt("a", question=[]), prompt("a", answer=1), prompt(), prompt("a", parameters=two), {**prompt("a"), "function": [{"name": "a", "parameters": CLOSED}]}]
    rows = prompt_projection(frame(spark, cases, "prompt")).orderBy("id").collect()
    assert [(r["aliases"], r["n_rewrites"]) for r in rows[:2]] == [(["bench_0_a_b", "bench_1_c"], 0), (["bench_0_x"], 2)]
    codes = [[(x["pointer"], x["code"]) for x in r["issues"]] for r in rows]
    assert codes[2:7] == [[("/function", "unsupported_or_duplicate_function_name")]] * 2 + [[("/question", "unsupported_question_history")]] + [[("", "unsupported_prompt_fields_or_tool_count")]] * 2
    at = "/function/0/parameters"
    assert codes[7] == sorted([(at, "object_not_explicitly_closed"), (f"{at}/properties/a", "unsupported_schema_keyword"), (f"{at}/properties/a", "array_without_supported_bound"), (f"{at}/properties/a/items", "schema_not_object"), (f"{at}/properties/b", "schema_not_object")])
    assert codes[8] == [("/function/0", "unsupported_function_fields")] and all(r["aliases"] is None for r in rows[2:])


def test_protocols(spark):
    cases = {
        "fine": (["user", ("assistant", "a"), ("assistant", "b")][:2] + [("tool", "a")], None), "open": (["user", ("assistant", "a"), "user"], "call_not_observed"), "ends open": (["user", ("assistant", "a")], "call_not_observed"), "twice": (["user", ("assistant", "a"), ("tool", "a"), ("tool", "a")], "observation_without_call"),
        "again": (["user", ("assistant", "a"), ("tool", "a"), ("assistant", "a"), ("tool", "a")], "call_id_repeated"), "before": (["user", ("tool", "a"), ("assistant", "a")], "observation_without_call"), "last": (["user", "assistant"], "not_before_a_decision"), "first": (["user", ("tool", None)], "observation_without_call"),
    }
    rows = [(k, i, m if isinstance(m, str) else m[0], m[1] if not isinstance(m, str) and m[0] == "assistant" else None, m[1] if not isinstance(m, str) and m[0] == "tool" else None) for k, (ms, _) in cases.items() for i, m in enumerate(ms)]
    found = protocol_breaks(spark.createDataFrame(rows, "k string, place int, role string, call string, answers string"), "k")
    assert {r["k"]: r["rule"] for r in found.collect()} == {k: w for k, (_, w) in cases.items()}


def test_traces(spark):
    run, see = lambda c: ("tool_execution", c, None, None, False), lambda c, s="completed", r=False: ("observing", c, c, s, r)
    end = ("finalized", None, None, None, False)
    cases = {
        "good": ([run("1"), see("1"), end], ("success", "answer_and_execution_agree", 1, 1, 0, None)), "other": ([run("1"), ("observing", "1", "2", "completed", False)], ("unknown", "observation_without_execution", 1, 1, 0, None)), "two": ([run("1"), run("2")], ("unknown", "invalid_execution_order", 2, 1, 1, None)),
        "retry": ([run("1"), see("1", "failed", True), run("2"), see("2"), end], ("failure", "execution_not_permitted", 2, 1, 1, True)), "lost": ([run("1"), see("1", "failed", True), ("cancelled", None, None, None, False)], ("failure", "terminated", 1, 1, 0, False)), "none": ([run("1"), see("1")], ("failure", "no_final_action", 1, 1, 0, None)),
    }
    rows = [(k, i, i, e, "call" if c else None, c, r, s and f"r:{s}", s, t) for k, (es, _) in cases.items() for i, (e, c, r, s, t) in enumerate(es)]
    events = spark.createDataFrame(rows, "k string, place int, index int, event string, call string, call_id string, result_id string, result string, status string, retryable boolean")
    keys = [(k,) for k in cases]
    ways = spark.createDataFrame([(k, ["call"], ["call|r:completed"]) for (k,) in keys], "k string, calls array<string>, steps array<string>")
    finals = spark.createDataFrame([(k, "final:1", True) for k in ("good", "retry")], "k string, final string, agrees boolean")
    got = {r["k"]: tuple(r)[1:] for r in judged_traces(events, "k", ways, finals).collect()}
    assert got == {k: w for k, (_, w) in cases.items()}
    pairs = spark.createDataFrame([(0, 1)], "parent int, child int")
    order = lambda *names: [(n,) for n in names]
    made = [("x", i, n) for i, (n,) in enumerate(order("deciding", "tool_execution", "observing", "deciding", "tool_execution"))] + [("y", i, n) for i, (n,) in enumerate(order("deciding", "tool_execution", "tool_execution", "observing"))] + [("z", 0, "deciding")]
    assert {r["k"]: r["observed"] for r in dependencies(spark.createDataFrame(made, "k string, place int, event string"), "k", pairs).collect()} == {"x": True, "y": False, "z": False}


@pytest.fixture(scope="module")
def rules(spark):
    make = spark.createDataFrame
    return {
        "cases": make([(1, 2, True, True), (2, 0, False, True), (3, 1, False, False)], "case int, needed int, closed boolean, stated boolean"), "strategies": make([(1, ["a", "b"]), (1, ["b", "a"]), (2, []), (3, ["a"])], "case int, steps array<string>"),
        "domain": make([(1, "f", "a"), (1, "g", "b")], "case int, name string, call string"), "answers": make([(1, "final:1"), (2, "final:1"), (3, "final:1")], "case int, answer string"),
    }


def test_decisions(spark, rules):
    cases = [
        (1, [], "tool_calls", [("f", "a")], None, ("legal", "known_permitted_continuation")), (1, ["b"], "tool_calls", [("f", "a")], None, ("legal", "known_permitted_continuation")), (1, ["c"], "final", [], "final:1", ("unknown", "invalid_prior_semantics")),
        (1, [], "tool_calls", [("h", "z"), ("f", "a")], None, ("illegal", "tool_confusion")), (1, [], "tool_calls", [("f", "q")], None, ("illegal", "argument_semantics")), (1, ["a", "b"], "tool_calls", [("f", "a")], None, ("illegal", "extra_call")),
        (1, [], "tool_calls", [("f", "a"), ("f", "a")], None, ("unknown", "unenumerated_not_proven_wrong")), (1, ["a", "b"], "final", [], "final:1", ("legal", "known_permitted_answer")), (1, ["a"], "final", [], "final:1", ("illegal", "premature_termination")), (1, ["a", "b"], "final", [], "final:2", ("illegal", "final_semantics")),
        (2, [], "tool_calls", [("f", "a")], None, ("illegal", "unnecessary_tool")), (2, [], "clarify", [], "clarify:?", ("unknown", "unenumerated_not_proven_wrong")), (3, [], "final", [], "final:1", ("unknown", "unenumerated_not_proven_wrong")), (3, [], "tool_calls", [("h", "z")], None, ("unknown", "unenumerated_not_proven_wrong")),
    ]
    rows = [(i, c, seen, kind, calls, answer) for i, (c, seen, kind, calls, answer, _) in enumerate(cases)]
    decisions = spark.createDataFrame(rows, "id int, case int, observed array<string>, kind string, calls array<struct<name: string, call: string>>, answer string")
    got = {r["id"]: (r["verdict"], r["reason"]) for r in decision_rules(decisions, **rules).collect()}
    assert got == {i: c[-1] for i, c in enumerate(cases)}


def test_pairs_of_trajectories(spark, rules):
    step = lambda pair, side, place, calls, answer=None, input_="i": (pair, side, place, input_, 1, ["a"] if place else [], "tool_calls" if calls else "final", calls, answer)
    a, b, wrong = [("f", "a")], [("g", "b")], [("h", "z")]
    rows = [step(1, "left", 0, a), step(1, "right", 0, wrong), step(2, "left", 0, a), step(2, "right", 0, b), step(3, "left", 0, a), step(3, "right", 0, a), step(4, "left", 0, a), step(4, "right", 0, a), step(4, "left", 1, [], "final:1"), step(4, "right", 1, b), step(5, "left", 0, a, input_="x"), step(5, "right", 0, wrong), step(6, "left", 0, a), step(6, "right", 0, wrong)]
    decisions = spark.createDataFrame(rows, "pair int, side string, place int, input string, case int, observed array<string>, kind string, calls array<struct<name: string, call: string>>, answer string")
    pairs = spark.createDataFrame([(1, "success", "failure"), (2, "failure", "success"), (3, "success", "failure"), (4, "failure", "success"), (5, "success", "failure"), (6, "success", "success")], "pair int, left string, right string")
    got = {r["pair"]: tuple(r)[1:] for r in preferred_pairs(pairs, decisions, **rules).collect()}
    assert got == {1: ("selected", 0, "tool_confusion"), 2: ("legal_alternative_tie", 0, None), 3: ("equivalent_decisions", None, None), 4: ("selected", 1, "premature_termination"), 5: ("different_actual_prefix", 0, None), 6: ("same_outcome", None, None)}


def test_pairs_are_joined_by_merge(spark):
    """Trajectories grow with the table, so no side of theirs may be broadcast, however small the planner thinks it."""
    plan = pair_comparisons(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert "SortMergeJoin" in plan and not [line for line in joins if "[pair#" in line or "[id#" in line]


def test_no_rows(spark, rules):
    none = spark.range(0)
    assert flag_rows(none.select("id", F.lit("").alias("tool"))).count() == 0 and policy_tools(none.select("id", F.lit("").alias("tool"))).count() == 0


def test_tools_of_one_text_are_read_once(spark, monkeypatch):
    seen, plain = [], toolschemas.flag_rows
    monkeypatch.setattr(toolschemas, "flag_rows", lambda tools: seen.append(tools.count()) or plain(tools))
    toolschemas.tool_flag_counts(spark, "/root/testdata/sf0.001")
    tools = toolschemas.raw_tools(spark, "/root/testdata/sf0.001")
    assert seen == [tools.select("tool").distinct().count()] and seen[0] < tools.count()
