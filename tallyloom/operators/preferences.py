"""Lengths of preference pairs, score gates, and checks of records, over rows written from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


@query("SELECT conv_id, sum(n) FILTER (WHERE first) AS prompt_tokens, CAST(sum(n) FILTER (WHERE NOT first) + 1 AS BIGINT) AS completion_tokens, CASE WHEN sum(n) + 1 <= 300 THEN 'accepted' ELSE 'context_overflow' END AS disposition FROM (SELECT conv_id, len(string_split(text, ' ')) AS n, turn = min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) GROUP BY 1 HAVING count(*) > 1")
def preference_lengths(spark: SparkSession, d: str, cap: int = 300) -> DataFrame:
    """Prompt and completion lengths with the end token; overlong pairs keep their row and their disposition."""
    first = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("f"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.size(F.split("text", " ", -1)).cast("bigint").alias("n")).join(first, "conv_id")
    own = lambda c: F.sum(F.when(c, F.col("n")))
    sums = turns.groupBy("conv_id").agg(own(F.col("turn") == F.col("f")).alias("prompt_tokens"), (own(F.col("turn") != F.col("f")) + 1).alias("completion_tokens")).filter("completion_tokens is not null")
    return sums.withColumn("disposition", F.when(F.col("prompt_tokens") + F.col("completion_tokens") <= cap, "accepted").otherwise("context_overflow"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 11 <> 0 THEN len(gates) = 0 END AS strict_success, array_to_string(gates, ',') AS gates FROM (SELECT o_orderkey, o_custkey, list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'runtime:' || o_orderstatus END, CASE WHEN o_orderkey % 7 = 0 THEN 'invalid_raw_action' END, CASE WHEN o_custkey % 11 = 0 THEN 'official_scorer_error' WHEN o_totalprice < 50000 THEN 'official_mismatch' END], lambda x: x IS NOT NULL) AS gates FROM orders)""")
def score_gates(spark: SparkSession, d: str) -> DataFrame:
    """All reasons against a success; an error of the scorer leaves it unmeasured, never matched."""
    error = F.col("o_custkey") % 11 == 0
    gates = F.array_compact(F.array(F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("runtime:"), F.col("o_orderstatus"))), F.when(F.col("o_orderkey") % 7 == 0, "invalid_raw_action"), F.when(error, "official_scorer_error").when(F.col("o_totalprice") < 50000, "official_mismatch")))
    return table(spark, d, "orders").select("o_orderkey", F.when(~error, F.size(gates) == 0).alias("strict_success"), F.array_join(gates, ",").alias("gates"))


@query("""SELECT conv_id, string_agg('{"message":{"content":' || to_json(text) || ',"role":"' || role || '"},"message_index":' || i || '}', chr(10) ORDER BY i) AS rendered FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY 1""")
def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Messages as canonical JSON with their place, in order."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    line = lambda x, i: F.concat(F.lit('{"message":'), F.to_json(F.struct(x["text"].alias("content"), x["role"].alias("role"))), F.lit(',"message_index":'), i.cast("string"), F.lit("}"))
    return turns.select("conv_id", F.array_join(F.transform("m", line), "\n").alias("rendered"))


@query("""SELECT doc_id, p, c, n, CASE WHEN p <= 0 THEN 'prompt_tokens' WHEN c IS NULL THEN 'no_completion' WHEN p + c + 1 <> n THEN 'total_tokens' END AS problem FROM (SELECT doc_id, n_chars AS n, CASE WHEN strpos(text, chr(10)) > 0 THEN strpos(text, chr(10)) - 1 ELSE length(text) END AS p, CASE WHEN strpos(text, chr(10)) > 0 THEN length(text) - strpos(text, chr(10)) END AS c FROM documents WHERE text IS NOT NULL) WHERE problem IS NOT NULL""")
def sequence_violations(spark: SparkSession, d: str) -> DataFrame:
    """The arithmetic of measured sequences: of every document's first line and the rest, with the break between, and its stated length; P + 1 + C = N."""
    at = F.instr("text", "\n")
    size = F.char_length("text")
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.when(at > 0, at - 1).otherwise(size).cast("bigint").alias("p"), F.when(at > 0, size - at).cast("bigint").alias("c"), F.col("n_chars").alias("n"))
    problem = F.when(F.col("p") <= 0, "prompt_tokens").when(F.col("c").isNull(), "no_completion").when(F.col("p") + F.col("c") + 1 != F.col("n"), "total_tokens")
    return rows.withColumn("problem", problem).filter("problem is not null")


@query("""WITH s AS (SELECT DISTINCT * FROM sales), l AS (SELECT sale_id, count(*) AS n_lines, min(shipped_at) AS shipped FROM (SELECT DISTINCT * FROM sale_lines) GROUP BY 1)
SELECT sale_id, rule, count(*) AS n FROM (SELECT s.sale_id, CASE WHEN status IS NULL OR status NOT IN ('open', 'done', 'held') THEN 'status' WHEN sold_at IS NULL THEN 'no_start' WHEN arrived_at < sold_at THEN 'ends_before_start' WHEN client_id IS NULL THEN 'no_owner' WHEN status = 'done' AND total IS NULL THEN 'terminal_without_total' WHEN status = 'done' AND n_lines IS NULL THEN 'terminal_without_lines' WHEN shipped < sold_at THEN 'line_before_start' END AS rule FROM s LEFT JOIN l ON l.sale_id = s.sale_id) WHERE rule IS NOT NULL GROUP BY ALL""")
def run_record_violations(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that each sale's records break, repeated rows aside: status, start, end, owner, total and lines must agree."""
    lines = table(spark, d, "sale_lines").distinct().groupBy("sale_id").agg(F.count("*").alias("n_lines"), F.min("shipped_at").alias("shipped"))
    rows = table(spark, d, "sales").distinct().join(lines, "sale_id", "left")
    done = F.col("status") == "done"
    rule = F.when(~F.coalesce(F.col("status").isin("open", "done", "held"), F.lit(False)), "status").when(F.col("sold_at").isNull(), "no_start").when(F.col("arrived_at") < F.col("sold_at"), "ends_before_start").when(F.col("client_id").isNull(), "no_owner")
    rule = rule.when(done & F.col("total").isNull(), "terminal_without_total").when(done & F.col("n_lines").isNull(), "terminal_without_lines").when(F.col("shipped") < F.col("sold_at"), "line_before_start")
    return rows.select("sale_id", rule.alias("rule")).filter("rule is not null").groupBy("sale_id", "rule").agg(F.count("*").alias("n"))


@query(r"""SELECT item_id, 'task-' || substr(sha256('{"case":"' || sha256(regexp_replace(text, '\s+', ' ', 'g')) || '"}'), 1, 32) AS task_id, regexp_replace(text, '\s+', ' ', 'g') = text AS agrees FROM benchmark""")
def authored_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks named by the digest of their case, with single blanks, against the names of the texts as they stand."""
    ident = lambda text: F.concat(F.lit("task-"), F.substring(F.sha2(F.concat(F.lit('{"case":"'), F.sha2(text, 256), F.lit('"}')), 256), 1, 32))
    items = table(spark, d, "benchmark")
    authored = items.select("item_id", ident(F.col("text")).alias("authored"))
    return items.select("item_id", ident(F.regexp_replace("text", r"\s+", " ")).alias("task_id")).join(authored, "item_id").select("item_id", "task_id", (F.col("task_id") == F.col("authored")).alias("agrees"))


@query("SELECT client_id, source, CASE WHEN source IS NULL THEN 'unknown_source' WHEN source <> 'partner' AND email IS NULL THEN 'scripted_is_not_formal' WHEN source <> 'partner' AND client_id IS DISTINCT FROM master_id THEN 'not_the_selected_model' END AS rule FROM clients")
def generation_models(spark: SparkSession, d: str) -> DataFrame:
    """Formal records, of all sources but partners, need an address of their own and must be their client's selected one."""
    formal = F.col("source") != "partner"
    rule = F.when(F.col("source").isNull(), "unknown_source").when(formal & F.col("email").isNull(), "scripted_is_not_formal").when(formal & ~F.col("client_id").eqNullSafe(F.col("master_id")), "not_the_selected_model")
    return table(spark, d, "clients").select("client_id", "source", rule.alias("rule"))


@query("""WITH t AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations)
SELECT conv_id, count(*) FILTER (role = 'assistant') AS n_calls, CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN count(*) FILTER (role = 'assistant' AND was = 'user') END AS n_matching, count(*) FILTER (role = 'assistant' AND was IS DISTINCT FROM 'user') AS n_unnecessary, 'N/A' AS recovery FROM t GROUP BY 1""")
def single_decision_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics of decisions: those that answer a user's turn match, others are needless; without decisions a match is unknown; what a single decision can't show is N/A."""
    turns = table(spark, d, "conversations").select("conv_id", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("was"))
    made, asked = F.col("role") == "assistant", F.col("was").eqNullSafe(F.lit("user"))
    sums = turns.groupBy("conv_id").agg(F.count_if(made).alias("n_calls"), F.count_if(made & asked).alias("m"), F.count_if(made & ~asked).alias("n_unnecessary"))
    return sums.select("conv_id", "n_calls", F.when(F.col("n_calls") > 0, F.col("m")).alias("n_matching"), "n_unnecessary", F.lit("N/A").alias("recovery"))
