"""Tool schemas as tables of nodes: one pass flattens a tool's JSON, and every rule is a column over its nodes.

A tool may be used as it is (flags), be made portable by a stated policy (edits, or the first rule that refuses it), or be
projected from a benchmark's prompt (renamed types, all issues). Edits are rows, applied to the JSON at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_rules as J
from ..functions import schemas as S
from ..functions.schemas import ALIASES, COMMON, DEEPEST, KEYWORDS, MOST_ITEMS, MOST_LENGTH, MOST_PROPERTIES
from ..plans.registry import query
from ..session import checkpoint_folder, ship_package
from ..sources.tables import table
from .judging import pick

#: Codes of the edits' reasons, in alphabetical order.
ALIAS, DESCRIBED, BOUNDED, CLOSED, RENAMED, ANNOTATED = "explicit_type_alias", "preserve_default_in_description", "project_bounded_", "project_closed_object", "reversible_name_mapping", "typed_annotation_not_argument"
_NOTE = "Source default annotation (never auto-filled): "


def by_kind(kind: Column, values: dict[str, Column], otherwise: Column) -> Column:
    for name, value in values.items():
        otherwise = F.when(kind == name, value).otherwise(otherwise)
    return otherwise


def words(*names: str) -> Column:
    return F.array(*map(F.lit, sorted(names))).cast("array<string>")


def renamed(named: Column, aliases: dict[str, str]) -> Column:
    return by_kind(named, {a: F.lit(b) for a, b in aliases.items()}, named)


def with_facts(tools: DataFrame, column: str) -> DataFrame:
    """tools and the struct `facts` of a column of tools' JSON, with their schema's nodes in preorder."""
    ship_package(tools.sparkSession)
    return tools.withColumn("facts", J.column_of(S.tool_facts, S.TOOL_FACTS, F.col(column)))


def node_rules(nodes: DataFrame, aliases: dict[str, str], default_allowed: bool) -> DataFrame:
    """nodes (id, n: a node's facts) with kind, and whether the node is of a known kind, has foreign keywords, and is bounded."""
    kind = renamed(F.col("n.named"), aliases)
    rows = nodes.withColumn("kind", kind)
    own = by_kind(F.col("kind"), {k: words(*COMMON, *v, *(["default"] if default_allowed else [])) for k, v in KEYWORDS.items()}, words())
    bound = by_kind(F.col("kind"), {"array": F.col("n.max_items"), "string": F.col("n.max_length")}, F.lit("ok"))
    return rows.withColumns({"known": F.coalesce(F.col("kind").isin(*KEYWORDS), F.lit(False)), "foreign": F.size(F.array_except("n.keys", own)) > 0, "bound": bound, "shaped": F.col("n.is_object") & (F.col("n.depth") <= DEEPEST)})


def contract(aliased: bool) -> Column:
    """Whether a node is outside the portable subset; of an aliased one what the policy adds isn't asked for."""
    n = lambda c: F.col(f"n.{c}")
    of = lambda k: F.col("kind") == k
    outside = ~F.col("shaped") | ~F.col("known") | F.col("foreign") | ~n("enum_ok") | ~n("described") | of("object") & ~n("required_ok") | of("array") & ~n("has_items")
    outside = outside | of("object") & (F.coalesce(n("n_properties"), F.lit(-1)) < 0) | of("object") & (n("n_properties") > MOST_PROPERTIES)
    if not aliased:
        outside = outside | of("object") & (n("closed") != "false") | (F.col("bound") != "ok")
    return F.coalesce(outside, F.lit(True))


def flag_rows(tools: DataFrame) -> DataFrame:
    """(id, flag) of tools (id, tool) as they are: what keeps each from being used; nothing is repaired."""
    facts = with_facts(tools, "tool").select("id", "facts").checkpoint()
    rows = node_rules(facts.select("id", F.explode("facts.nodes").alias("n")), {}, False)
    reached, kind = F.col("n.reached"), F.col("kind")
    anywhere = F.size(F.array_except("n.keys", words(*COMMON.union(*KEYWORDS.values())))) > 0
    mapped = kind.isin("object", "dict")
    whole = F.col("shaped")
    flags = F.array(
        F.when(reached & ~whole, "schema_depth_or_shape"), F.when(reached & whole & ~F.col("known"), "schema_type_unsupported"), F.when(reached & whole & anywhere, "schema_keyword_unsupported"),
        F.when(reached & whole & mapped & (F.col("n.closed") != "false"), "schema_object_unclosed"), F.when(reached & whole & mapped & F.col("n.n_properties").isNull(), "schema_properties_missing"),
        F.when(reached & whole & (kind == "string") & (F.col("n.max_length") == "absent"), "schema_string_unbounded"), F.when(reached & whole & (kind == "array") & (F.col("n.max_items") == "absent"), "schema_array_unbounded"),
        F.when(contract(False) | (F.col("n.place") == 0) & F.coalesce(kind != "object", F.lit(True)), "schema_contract_rejected"),
    )
    f = lambda c: F.col(f"facts.{c}")
    outer = F.array(F.when(~F.coalesce(f("name").rlike("^[a-z][a-z0-9_]{0,63}$"), F.lit(False)), "tool_name_incompatible"), F.when(~F.coalesce(f("side_effects").isin("read_only", "sandbox_only"), F.lit(False)), "side_effect_unknown_or_forbidden"), F.when(F.size(F.array_except(words("tool_version", "timeout_ms"), f("keys"))) > 0, "tool_runtime_metadata_missing"))
    return rows.select("id", F.explode(F.array_compact(flags)).alias("flag")).union(facts.select("id", F.explode(F.array_compact(outer)))).distinct()


def strict_tools(tools: DataFrame) -> DataFrame:
    """(id, rule) of tools (id, tool): why each can't be used without any change, or null if it can."""
    flagged = flag_rows(tools).select("id", F.lit(True).alias("flagged")).distinct()
    f = lambda c: F.col(f"facts.{c}")
    odd = (F.size(F.array_except(f("keys"), words("name", "description", "parameters", "required", "tool_version", "timeout_ms", "side_effect_class"))) > 0) | ~f("required_null")
    rule = F.when(odd, "tool_metadata_ambiguous").when(F.col("flagged"), "tool_incompatible").when(~f("described") | F.coalesce(~f("timeout").between(1, 60_000), F.lit(True)), "tool_contract_rejected")
    return with_facts(tools, "tool").join(flagged, "id", "left").select("id", rule.alias("rule"))


def policy_edits(tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a stated policy makes of tools (id, tool): verdicts (id, rule, name), and edits (id, place, pointer, reason, value).

    Aliases of types are renamed, objects closed and strings and arrays bounded where nothing is said of it, defaults moved to
    descriptions, and names made safe; rule is the first, in the order of a walk through the schema, that refuses the tool.
    """
    facts = with_facts(tools, "tool").select("id", "facts").checkpoint()
    rows = node_rules(facts.select("id", F.explode("facts.nodes").alias("n")), ALIASES, True)
    n = lambda c: F.col(f"n.{c}")
    of = lambda k: F.col("kind") == k
    rule = F.when(~F.col("shaped"), F.when(n("real"), "policy_schema_depth_or_shape").otherwise("policy_array_items_missing")).when(~F.col("known"), "policy_schema_type_unknown").when(F.col("foreign"), "policy_schema_keyword_unsupported")
    rule = rule.when(~n("described"), "policy_description_not_string").when(of("object") & F.coalesce(n("n_properties") > MOST_PROPERTIES, F.lit(True)), "policy_schema_properties")
    rule = rule.when(of("object") & (n("closed") == "other"), "policy_explicit_open_object").when(F.col("bound") == "bad", "policy_explicit_bound_invalid_or_too_wide")
    long = n("description_length") + F.char_length(n("default")) + len(_NOTE) + 2 > MOST_LENGTH
    late = F.when(n("default").isNotNull() & ~n("default_fits"), "policy_default_conflicts_with_schema").when(n("default").isNotNull() & long, "policy_default_description_too_long")
    found = F.array_compact(F.array(F.when(rule.isNotNull(), F.struct(n("place").alias("at"), F.lit(0).alias("late"), F.lit(0).alias("up"), rule.alias("rule"))), F.when(late.isNotNull(), F.struct(n("ends").alias("at"), F.lit(1).alias("late"), (-n("depth")).alias("up"), late.alias("rule")))))
    first = rows.select("id", F.explode(found).alias("r")).groupBy("id").agg(F.min("r").alias("r")).select("id", F.col("r.rule").alias("inner"))
    whole = rows.groupBy("id").agg((F.bool_or(contract(True)) | ~F.bool_or((n("place") == 0) & of("object"))).alias("outside"))
    f = lambda c: F.col(f"facts.{c}")
    slug = F.regexp_replace(F.translate(f("name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", "_")
    slug = F.substring(F.regexp_replace(slug, "^_+|_+$", ""), 1, 47)
    name = F.concat(F.lit("ta_"), F.when(slug == "", "tool").otherwise(slug))
    verdict = F.when(F.coalesce(f("name"), F.lit("")) == "", "source_tool_name_missing").when(F.size(F.array_except(f("keys"), words("name", "description", "parameters", "required"))) > 0, "policy_tool_metadata_unknown")
    verdict = verdict.when(~f("required_null"), "policy_outer_required_ambiguous").when(~f("described"), "policy_description_not_string").when(F.col("inner").isNotNull(), F.col("inner")).when(F.coalesce("outside", F.lit(True)), "policy_tool_contract_rejected")
    verdicts = facts.join(first, "id", "left").join(whole, "id", "left").select("id", verdict.alias("rule"), F.when(verdict.isNull(), name).alias("name"), f("digest").alias("digest"))
    edit = lambda holds, at, reason, value: F.when(holds, F.struct(F.concat(n("pointer"), F.lit(at)).alias("pointer"), reason.alias("reason"), value.alias("value")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = F.concat_ws("\n", F.when(F.col("n.description_length") > 0, F.col("n.description")), F.concat(F.lit(_NOTE), n("default"), F.lit(".")))
    has = n("default").isNotNull()
    edits = F.array(
        edit(F.col("kind") != n("named"), "/type", F.lit(ALIAS), quoted(F.col("kind"))), edit(of("object") & (n("closed") == "absent"), "/additionalProperties", F.lit(CLOSED), F.lit("false")),
        edit(of("array") & (F.col("bound") == "absent"), "/maxItems", F.lit(f"{BOUNDED}array"), F.lit(str(MOST_ITEMS))), edit(of("string") & (F.col("bound") == "absent"), "/maxLength", F.lit(f"{BOUNDED}string"), F.lit(str(MOST_LENGTH))),
        edit(has, "/default", F.lit(ANNOTATED), F.lit(None).cast("string")), edit(has, "/description", F.lit(DESCRIBED), F.element_at(F.split(F.to_json(F.struct(text.alias("t"))), ":", 2), 2)),
    )
    taken = verdicts.filter("rule is null")
    inside = rows.join(taken.select("id"), "id", "left_semi").select("id", n("place").alias("place"), F.explode(F.array_compact(edits)).alias("e")).select("id", "place", "e.*")
    inside = inside.withColumn("value", F.when(F.col("reason") == DESCRIBED, F.regexp_replace("value", r"\}$", "")).otherwise(F.col("value")))
    names = taken.select("id", F.lit(-1).alias("place"), F.lit("/name").alias("pointer"), F.lit(RENAMED).alias("reason"), quoted(F.concat_ws("_", "name", F.substring("digest", 1, 12))).alias("value"))
    return verdicts.drop("digest"), inside.unionByName(names)


def policy_tools(tools: DataFrame) -> DataFrame:
    """(id, rule, tool) of tools (id, tool): each portable by policy, its edits applied, or the rule that refuses it."""
    verdicts, edits = policy_edits(tools)
    listed = edits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "pointer", "value"))).alias("edits"))
    made = J.column_of(lambda text, edits: S.edited(text, [(e["pointer"], e["value"]) for e in edits]), "string", F.col("tool"), F.col("edits"))
    rows = tools.join(verdicts, "id").join(listed, "id", "left")
    return rows.filter("rule is null").select("id", "rule", made.alias("tool")).unionByName(rows.filter("rule is not null").select("id", "rule", F.lit(None).cast("string").alias("tool")))


def catalog_counts(tools: DataFrame) -> DataFrame:
    """(what, name, n) over tools (tool, n): kinds of schema nodes, keywords, and defaults by declared and actual type, each occurrence counted."""
    rows = with_facts(tools, "tool").select("n", F.explode("facts.nodes").alias("x")).filter("x.real")
    one = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    kind = F.when(F.col("x.named") == "[]", "union").when(F.col("x.named").isin(*KEYWORDS, *ALIASES), F.col("x.named")).otherwise("other_or_missing")
    actual = F.when(F.col("x.default_kind") == "integer", "number").otherwise(F.col("x.default_kind"))
    facts = F.concat(F.array(one("node", kind)), F.transform("x.keys", lambda k: one("keyword", k)), F.when(F.col("x.default").isNotNull(), F.array(one("default", F.concat_ws(":", kind, actual)))).otherwise(F.array().cast("array<struct<what: string, name: string>>")))
    odd = F.array(one("count", F.lit("invalid_or_excessively_deep_node")))
    return rows.select("n", F.explode(F.when(F.col("x.is_object"), facts).otherwise(odd)).alias("r")).groupBy("r.what", "r.name").agg(F.sum("n").alias("n"))


def prompt_projection(prompts: DataFrame) -> DataFrame:
    """(id, aliases, n_rewrites, issues) of a benchmark's prompts (id, prompt): functions under names of their own with two types renamed, or all issues.

    issues: sorted (pointer, code) of everything that can't be projected without loss; aliases and n_rewrites are null then.
    """
    ship_package(prompts.sparkSession)
    facts = prompts.select("id", J.column_of(S.prompt_facts, S.PROMPT_FACTS, F.col("prompt")).alias("p")).checkpoint()
    each = facts.select("id", F.posexplode("p.functions").alias("i", "f"))
    rows = node_rules(each.filter("f.fields_ok").select("id", "i", F.explode("f.nodes").alias("n")), {"dict": "object", "float": "number"}, False)
    n = lambda c: F.col(f"n.{c}")
    of = lambda k: F.col("kind") == k
    kept = F.col("n.is_object") & F.col("known")
    codes = {
        "schema_not_object": ~n("is_object"), "unsupported_parameter_type": n("is_object") & ~F.col("known"), "unsupported_schema_keyword": kept & F.col("foreign"), "object_not_explicitly_closed": kept & of("object") & (n("closed") != "false"),
        "unsupported_object_properties": kept & of("object") & F.coalesce(n("n_properties") > MOST_PROPERTIES, F.lit(True)), "array_without_supported_bound": kept & of("array") & (n("max_items") != "ok"), "string_without_supported_bound": kept & of("string") & (n("max_length") != "ok"),
    }
    at = F.concat(F.lit("/function/"), F.col("i").cast("string"), n("pointer"))
    issue = lambda pointer, code: F.struct(pointer.alias("pointer"), F.lit(code).alias("code"))
    inner = rows.select("id", F.explode(F.array_compact(F.array(*(F.when(holds, issue(at, code)) for code, holds in codes.items())))).alias("x"))
    names = F.transform("p.functions", lambda f: f["name"])
    plain = F.forall(names, lambda x: F.coalesce(x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$"), F.lit(False))) & (F.size(F.array_distinct(names)) == F.size(names))
    whole, named = F.col("p.fields_ok"), F.coalesce(plain, F.lit(False))
    outer = F.array_compact(F.array(F.when(~whole, issue(F.lit(""), "unsupported_prompt_fields_or_tool_count")), F.when(whole & ~named, issue(F.lit("/function"), "unsupported_or_duplicate_function_name")), F.when(whole & named & ~F.col("p.question_ok"), issue(F.lit("/question"), "unsupported_question_history"))))
    fields = each.filter("not f.fields_ok").select("id", issue(F.concat(F.lit("/function/"), F.col("i").cast("string")), "unsupported_function_fields").alias("x"))
    sound = facts.filter(whole & named).select("id")
    every = facts.select("id", F.explode(outer).alias("x")).union(inner.union(fields).join(sound, "id", "left_semi"))
    issues = every.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("issues"))
    rewrites = rows.groupBy("id").agg(F.count_if(F.col("kind") != n("named")).alias("n"))
    slug = lambda f, i: F.concat(F.lit("bench_"), i.cast("string"), F.lit("_"), F.substring(F.regexp_replace(F.lower(f["name"]), "[^a-z0-9_]", "_"), 1, 48))
    rows = facts.join(issues, "id", "left").join(rewrites, "id", "left")
    fine = F.col("issues").isNull()
    return rows.select("id", F.when(fine, F.transform("p.functions", slug)).alias("aliases"), F.when(fine, F.coalesce("n", F.lit(0))).alias("n_rewrites"), F.coalesce("issues", F.array().cast("array<struct<pointer: string, code: string>>")).alias("issues"))


def raw_tools(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, tool): a tool's JSON for each part; of six forms in turn, the first portable by policy with edits."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    tool = lambda schema: F.concat(F.lit('{"name": "Get '), name, F.lit('", "description": "d", "parameters": '), schema, F.lit("}"))
    forms = [
        F.concat(F.lit('{"type": "dict", "properties": {"size": {"type": "int", "default": '), size, F.lit('}, "tag/x": {"type": "string"}}}')),
        F.lit('{"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number"}, "maxItems": 5}}, "additionalProperties": false}'),
        F.lit('{"type": "object", "properties": {"a": {"type": "string", "pattern": "x"}}}'),
        F.lit('{"type": "object", "properties": {}, "additionalProperties": true}'),
        F.concat(F.lit('{"type": "dict", "properties": {"a": {"type": "string", "default": '), size, F.lit("}}}")),
        F.lit('{"type": ["string", "null"]}'),
    ]
    return table(spark, d, "part").select("p_partkey", tool(pick(F.col("p_partkey"), *forms)).alias("tool"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN 'policy_schema_keyword_unsupported' WHEN 3 THEN 'policy_explicit_open_object' WHEN 4 THEN 'policy_default_conflicts_with_schema' WHEN 5 THEN 'policy_schema_type_unknown' END AS rule, CASE WHEN p_partkey % 6 < 2 THEN 'ta_get_' || replace(p_name, ' ', '_') END AS name, CASE p_partkey % 6 WHEN 0 THEN 7 WHEN 1 THEN 1 END AS n_changes, CASE p_partkey % 6 WHEN 0 THEN 'explicit_type_alias,preserve_default_in_description,project_bounded_string,project_closed_object,reversible_name_mapping,typed_annotation_not_argument' WHEN 1 THEN 'reversible_name_mapping' END AS reasons FROM part""")
def tool_conversion(spark: SparkSession, d: str) -> DataFrame:
    verdicts, edits = policy_edits(raw_tools(spark, d).withColumnRenamed("p_partkey", "id"))
    sums = edits.groupBy("id").agg(F.count("*").alias("n_changes"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return verdicts.join(sums, "id", "left").select(F.col("id").alias("p_partkey"), "rule", "name", "n_changes", "reasons")


@query("""WITH t AS (SELECT p_partkey % 6 AS k, p_name, p_size FROM part), r AS (SELECT k, CASE k WHEN 0 THEN 'explicit_type_alias,preserve_default_in_description,project_bounded_string,project_closed_object,reversible_name_mapping,typed_annotation_not_argument' WHEN 1 THEN 'reversible_name_mapping' END AS reasons, p_name || CASE WHEN k = 0 THEN '#' || p_size ELSE '' END AS tool FROM t WHERE k < 2), x AS (SELECT unnest(string_split(reasons, ',')) AS reason, tool FROM r) SELECT reason, count(*) AS n_occurrences, count(DISTINCT tool) AS n_tools FROM x GROUP BY 1""")
def conversion_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Each reason by occurrences and by different tools; a tool's text is converted once, however often it occurs."""
    tools = raw_tools(spark, d).groupBy("tool").agg(F.count("*").alias("n"), F.min("p_partkey").alias("id"))
    _, edits = policy_edits(tools.select("id", "tool"))
    each = edits.select("id", "reason").distinct().join(tools.select("id", "n"), "id")
    return each.groupBy("reason").agg(F.sum("n").alias("n_occurrences"), F.count("*").alias("n_tools"))


_FLAGS = ["schema_object_unclosed,schema_string_unbounded,schema_type_unsupported,schema_keyword_unsupported", "", "schema_object_unclosed,schema_string_unbounded,schema_keyword_unsupported", "schema_object_unclosed", "schema_object_unclosed,schema_string_unbounded,schema_type_unsupported,schema_keyword_unsupported", "schema_type_unsupported"]


@query("WITH t AS (SELECT " + repr(_FLAGS) + """[p_partkey % 6 + 1] || ',schema_contract_rejected' AS f, p_partkey % 6 AS k FROM part), x AS (SELECT k, unnest(string_split(f, ',')) AS flag FROM t UNION ALL SELECT k, 'tool_name_incompatible' FROM t UNION ALL SELECT k, 'side_effect_unknown_or_forbidden' FROM t UNION ALL SELECT k, 'tool_runtime_metadata_missing' FROM t) SELECT flag, count(*) AS n FROM x WHERE flag <> '' AND NOT (flag = 'schema_contract_rejected' AND k = 1) GROUP BY 1""")
def tool_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tools by flag; a tool's text is read once, however often it occurs."""
    checkpoint_folder(spark)
    tools = raw_tools(spark, d).groupBy("tool").agg(F.count("*").alias("n"), F.min("p_partkey").alias("id")).checkpoint()
    return flag_rows(tools.select("id", "tool")).join(tools.select("id", "n"), "id").groupBy("flag").agg(F.sum("n").alias("n"))


@query("""WITH t AS (SELECT p_partkey % 6 AS k, count(*) AS n FROM part GROUP BY 1), r AS (SELECT * FROM (VALUES (0, 'node', 'dict', 1), (0, 'node', 'int', 1), (0, 'node', 'string', 1), (0, 'keyword', 'type', 3), (0, 'keyword', 'properties', 1), (0, 'keyword', 'default', 1), (0, 'default', 'int:number', 1),
(1, 'node', 'object', 1), (1, 'node', 'array', 1), (1, 'node', 'number', 1), (1, 'keyword', 'type', 3), (1, 'keyword', 'properties', 1), (1, 'keyword', 'items', 1), (1, 'keyword', 'maxItems', 1), (1, 'keyword', 'additionalProperties', 1),
(2, 'node', 'object', 1), (2, 'node', 'string', 1), (2, 'keyword', 'type', 2), (2, 'keyword', 'properties', 1), (2, 'keyword', 'pattern', 1), (3, 'node', 'object', 1), (3, 'keyword', 'type', 1), (3, 'keyword', 'properties', 1), (3, 'keyword', 'additionalProperties', 1),
(4, 'node', 'dict', 1), (4, 'node', 'string', 1), (4, 'keyword', 'type', 2), (4, 'keyword', 'properties', 1), (4, 'keyword', 'default', 1), (4, 'default', 'string:number', 1), (5, 'node', 'union', 1), (5, 'keyword', 'type', 1)) v(k, what, name, m)) SELECT what, name, CAST(sum(n * m) AS BIGINT) AS n FROM r JOIN t USING (k) GROUP BY ALL""")
def schema_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of schema nodes, keywords, and defaults by declared and actual type, over every occurrence of a tool."""
    tools = raw_tools(spark, d).groupBy("tool").agg(F.count("*").alias("n"))
    return catalog_counts(tools)


@query("""SELECT p_partkey, CASE WHEN k < 2 THEN 'bench_0_get_' || replace(p_name, ' ', '_') END AS aliases, CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 END AS n_rewrites, ['', '', 'object_not_explicitly_closed,string_without_supported_bound', 'unsupported_question_history', 'unsupported_or_duplicate_function_name', 'unsupported_parameter_type', 'unsupported_prompt_fields_or_tool_count'][k + 1] AS issues, [0, 0, 2, 1, 1, 1, 1][k + 1] AS n_issues FROM (SELECT p_partkey, p_name, p_partkey % 7 AS k FROM part)""")
def benchmark_projection(spark: SparkSession, d: str) -> DataFrame:
    """Prompts projected without loss, or with all their issues."""
    name = F.concat(F.lit("get."), F.replace("p_name", F.lit(" "), F.lit("_")))
    prompt = lambda schema, names=name, question='[[{"role": "user", "content": "q"}]]', more="": F.concat(F.lit('{"id": 1, "question": ' + question + ', "function": [{"name": "'), names, F.lit('", "description": "d", "parameters": ' + schema + "}]" + more + "}"))
    closed = '{"type": "object", "properties": {"a": {"type": "number"}}, "additionalProperties": false}'
    forms = [
        prompt('{"type": "dict", "properties": {"a": {"type": "float"}}, "additionalProperties": false}'), prompt(closed), prompt('{"type": "object", "properties": {"a": {"type": "string"}}}'),
        prompt(closed, question="[]"), prompt(closed, names=F.lit("get it")), prompt('{"type": "any"}'), prompt(closed, more=', "answer": 1'),
    ]
    found = prompt_projection(table(spark, d, "part").select(F.col("p_partkey").alias("id"), pick(F.col("p_partkey"), *forms).alias("prompt")))
    codes = F.array_join(F.array_sort(F.array_distinct(F.transform("issues", lambda x: x["code"]))), ",")
    return found.select(F.col("id").alias("p_partkey"), F.array_join("aliases", ",").alias("aliases"), "n_rewrites", codes.alias("issues"), F.size("issues").cast("bigint").alias("n_issues"))
