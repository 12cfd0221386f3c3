"""Decisions of conversations: prefixes, the history protocol, exclusion of whole sources, sequences and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def _by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


@query("SELECT conv_id, turn, text AS target, n_before, roles FROM (SELECT conv_id, turn, role, text, count(*) OVER w AS n_before, coalesce(string_agg(role, ',') OVER w, '') AS roles FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant'")
def decision_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant turn with all strictly earlier turns, never itself."""
    before = _by_turn().rowsBetween(Window.unboundedPreceding, -1)
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("target"), F.collect_list("role").over(before).alias("r"))
    return turns.filter("role = 'assistant'").select("conv_id", "turn", "target", F.size("r").cast("bigint").alias("n_before"), F.array_join("r", ",").alias("roles"))


@query("WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations) SELECT conv_id, CASE WHEN bool_or(turn <> place) THEN 'gap' WHEN bool_or(NOT coalesce(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant' END, false)) THEN 'role_order' ELSE 'ok' END AS verdict FROM t GROUP BY 1")
def history_protocol(spark: SparkSession, d: str) -> DataFrame:
    """Turns contiguous from 0; system or user first, a user after system and assistant, an assistant after user."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(_by_turn()).alias("prev"), (F.row_number().over(_by_turn()) - 1).alias("place"))
    fine = F.when(F.col("prev").isNull(), F.col("role").isin("system", "user")).when(F.col("prev").isin("system", "assistant"), F.col("role") == "user").when(F.col("prev") == "user", F.col("role") == "assistant")
    verdict = F.when(F.bool_or(F.col("turn") != F.col("place")), "gap").when(F.bool_or(~F.coalesce(fine, F.lit(False))), "role_order").otherwise("ok")
    return t.groupBy("conv_id").agg(verdict.alias("verdict"))


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE c.conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'user' AND length(text) > 1000)")
def whole_source_exclusion(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    bad = turns.filter((F.col("role") == "user") & (F.length("text") > 1000)).select("conv_id").distinct()
    return turns.select("conv_id", "turn").join(bad, "conv_id", "left_anti")


_LENGTHS = r"SELECT conv_id, turn, role, len(regexp_extract_all(text, '[^\s]+')) AS n FROM conversations"


@query(f"WITH t AS ({_LENGTHS}), p AS (SELECT conv_id, turn, role, n AS response, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS context FROM t) SELECT conv_id, turn, CAST(context AS BIGINT) AS context, CAST(response AS BIGINT) AS response, CASE WHEN context > 256 AND response > 64 THEN 'both' WHEN context > 256 THEN 'context_only' WHEN response > 64 THEN 'response_only' ELSE 'eligible' END AS verdict FROM p WHERE role = 'assistant'")
def length_predicate_profile(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).cast("bigint")
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", n.alias("response"))
    t = t.withColumn("context", F.coalesce(F.sum("response").over(_by_turn().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    long_context, long_response = F.col("context") > 256, F.col("response") > 64
    verdict = F.when(long_context & long_response, "both").when(long_context, "context_only").when(long_response, "response_only").otherwise("eligible")
    return t.filter("role = 'assistant'").select("conv_id", "turn", "context", "response", verdict.alias("verdict"))


@query(r"WITH t AS (SELECT conv_id, turn, role, list_transform(regexp_extract_all(text, '[^\s]+'), lambda x: length(x)) AS ids, lag(list_transform(regexp_extract_all(text, '[^\s]+'), lambda x: length(x))) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations) SELECT conv_id, turn, CAST(len(coalesce(prompt, [])) AS BIGINT) AS n_prompt, CAST(len(ids) + 1 AS BIGINT) AS n_supervised, repeat('0', CAST(len(coalesce(prompt, [])) AS INTEGER)) || repeat('1', CAST(len(ids) + 1 AS INTEGER)) AS mask, array_to_string(list_concat(list_concat(coalesce(prompt, []), ids), [0]), ',') AS ids FROM t WHERE role = 'assistant'")
def sequence_mask(spark: SparkSession, d: str) -> DataFrame:
    """Prompt, completion and one end id (0), with a loss mask over completion and end; words' lengths stand in for ids."""
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0)), lambda x: F.length(x))
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", ids.alias("ids")).withColumn("prompt", F.coalesce(F.lag("ids").over(_by_turn()), F.array().cast("array<int>")))
    mask = F.concat(F.repeat(F.lit("0"), F.size("prompt")), F.repeat(F.lit("1"), F.size("ids") + 1))
    joined = F.array_join(F.concat("prompt", "ids", F.array(F.lit(0))).cast("array<string>"), ",")
    return t.filter("role = 'assistant'").select("conv_id", "turn", F.size("prompt").cast("bigint").alias("n_prompt"), (F.size("ids") + 1).cast("bigint").alias("n_supervised"), mask.alias("mask"), joined.alias("ids"))


@query(r"WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[^\s]+') AS a, lag(regexp_extract_all(text, '[^\s]+')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), u AS (SELECT conv_id, turn, b IS NULL AS none, len(a) AS na, coalesce(len(b), 0) AS nb, list_filter(range(1, least(len(a), coalesce(len(b), 0)) + 1), lambda i: a[i] IS DISTINCT FROM b[i]) AS off FROM t) SELECT conv_id, turn, CAST(CASE WHEN none THEN 0 WHEN len(off) = 0 THEN least(na, nb) ELSE off[1] - 1 END AS BIGINT) AS n_common FROM u")
def prefix_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Words that a turn has in common with the one before, from the first on."""
    w = F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))
    t = table(spark, d, "conversations").select("conv_id", "turn", w.alias("a")).withColumn("b", F.lag("a").over(_by_turn()))
    same = F.expr("aggregate(zip_with(a, b, (x, y) -> x <=> y), named_struct('n', 0L, 'on', true), (s, e) -> named_struct('n', s.n + IF(s.on and e, 1L, 0L), 'on', s.on and e), s -> s.n)")
    return t.select("conv_id", "turn", F.coalesce(same, F.lit(0).cast("bigint")).alias("n_common"))
