"""Recorded executions and decisions judged by joins and windows: protocols, traces, permitted continuations, preferred pairs.

Calls, results and answers stand as canonical JSON texts, so that equal ones are equal strings. What a case permits is a table
of strategies; each gives the digests of its prefixes, and a history is permitted if its digest is among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def pick(number: Column, *options) -> Column:
    """One of the options (columns or texts) in turn."""
    return F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), (number % len(options) + 1).cast("int"))


def history(steps: Column) -> Column:
    """The digest of a sequence of canonical texts."""
    return F.sha2(F.concat(F.size(steps).cast("string"), F.lit(":"), F.array_join(steps, "\x1f")), 256)


def permitted(strategies: DataFrame) -> DataFrame:
    """(case, seen, whole) of every prefix of every strategy (case, steps): its digest, and whether it is all of one."""
    each = strategies.select("case", "steps", F.explode(F.sequence(F.lit(0), F.size("steps"))).alias("k"))
    prefix = each.select("case", history(F.slice("steps", F.lit(1), F.col("k"))).alias("seen"), (F.col("k") == F.size("steps")).alias("w"))
    return prefix.groupBy("case", "seen").agg(F.bool_or("w").alias("whole"))


def decision_rules(decisions: DataFrame, cases: DataFrame, strategies: DataFrame, domain: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, verdict, reason) of decisions (id, case, observed, kind, calls, answer): legal, illegal, or unknown.

    observed: steps seen so far; calls: (name, call) of each call made; answer: the canonical answer of another kind of action.
    cases: (case, needed, closed, stated): how many calls are needed, whether only listed answers are right, and whether the
    domain (case, name, call) of right calls is stated. strategies: (case, steps); answers: (case, answer). Only what is
    stated makes a decision illegal; what no strategy lists is unknown.
    """
    ways = permitted(strategies)
    made = F.transform("calls", lambda c: c["call"])
    rows = decisions.join(cases, "case").withColumns({"now": history(F.col("observed")), "then": history(F.concat("observed", made))})
    rows = rows.join(ways.select("case", F.col("seen").alias("now"), F.col("whole").alias("ended")), ["case", "now"], "left")
    rows = rows.join(ways.select("case", F.col("seen").alias("then"), F.lit(True).alias("continued")), ["case", "then"], "left")
    rows = rows.join(answers.select("case", "answer", F.lit(True).alias("listed")).distinct(), ["case", "answer"], "left")
    single = rows.select("id", "case", F.posexplode("calls").alias("at", "c")).select("id", "case", "at", "c.name", "c.call")
    named = domain.select("case", "name", F.lit(True).alias("known_name")).distinct()
    exact = domain.select("case", "call", F.lit(True).alias("known_call")).distinct()
    outside = single.join(named, ["case", "name"], "left").join(exact, ["case", "call"], "left").filter("known_call is null")
    wrong = outside.groupBy("id").agg(F.min_by(F.when(F.col("known_name").isNull(), "tool_confusion").otherwise("argument_semantics"), "at").alias("wrong"))
    calling, n_seen, n_made = F.col("kind") == "tool_calls", F.size("observed"), F.size("calls")
    without = cases.join(domain.select("case").distinct(), "case", "left_anti").select("case", F.lit(True).alias("empty_domain"))
    rows = rows.join(by_merge(wrong), "id", "left").join(without, "case", "left")
    ladder = [
        (F.col("ended").isNull(), "unknown", F.lit("invalid_prior_semantics")),
        (calling & F.col("continued"), "legal", F.lit("known_permitted_continuation")),
        (calling & F.col("stated") & F.col("empty_domain"), "illegal", F.lit("unnecessary_tool")),
        (calling & F.col("stated") & F.col("wrong").isNotNull(), "illegal", F.col("wrong")),
        (calling & F.col("stated") & (n_seen + n_made > F.col("needed")), "illegal", F.lit("extra_call")),
        (~calling & F.col("listed") & F.col("ended"), "legal", F.lit("known_permitted_answer")),
        (~calling & F.col("closed") & F.col("listed").isNull(), "illegal", F.lit("final_semantics")),
        (~calling & F.col("stated") & (n_seen < F.col("needed")), "illegal", F.lit("premature_termination")),
    ]
    verdict, reason = F.lit("unknown"), F.lit("unenumerated_not_proven_wrong")
    for holds, kind, why in reversed(ladder):
        holds = F.coalesce(holds, F.lit(False))
        verdict, reason = F.when(holds, kind).otherwise(verdict), F.when(holds, why).otherwise(reason)
    return rows.select("id", verdict.alias("verdict"), reason.alias("reason"))


def by_merge(rows: DataFrame) -> DataFrame:
    """rows, joined by sorting both sides: their width as the planner guesses it tells nothing of texts and arrays made meanwhile, and a side taken as small would go whole through the driver."""
    return rows.hint("merge")


def preferred_pairs(pairs: DataFrame, decisions: DataFrame, **tables: DataFrame) -> DataFrame:
    """(pair, disposition, place, reason): whether a success is preferred to a failure, and from which decision on.

    pairs: (pair, left, right): outcomes; decisions: (pair, side, place, input, case, observed, kind, calls, answer), side
    being left or right; tables as for decision_rules. The first place counts at which the two were asked differently (no
    pair) or answered differently: they are a pair there if the success's decision is legal and the failure's illegal.
    """
    sides = F.when((F.col("left") == "success") & (F.col("right") == "failure"), "left").when((F.col("left") == "failure") & (F.col("right") == "success"), "right")
    placed = pairs.withColumn("good", sides)
    said = F.concat_ws("|", "kind", F.transform("calls", lambda c: c["call"]), "answer")
    own = decisions.withColumn("said", said).join(by_merge(placed.filter("good is not null").select("pair", "good")), "pair").withColumn("is_good", F.col("side") == F.col("good"))
    a, b = (own.filter(c).select("pair", "place", F.col("input").alias(f"input_{k}"), F.col("said").alias(f"said_{k}")) for c, k in (("is_good", "a"), ("not is_good", "b")))
    differ = a.join(by_merge(b), ["pair", "place"]).filter("input_a <> input_b OR said_a <> said_b")
    first = differ.groupBy("pair").agg(F.min(F.struct("place", (F.col("input_a") != F.col("input_b")).alias("asked"))).alias("f")).select("pair", F.col("f.place").alias("place"), "f.asked")
    judged = own.join(by_merge(first.filter("not asked").select("pair", "place")), ["pair", "place"]).withColumn("id", F.struct("pair", "is_good"))
    rules = decision_rules(judged.select("id", "case", "observed", "kind", "calls", "answer"), **tables)
    by = lambda good, c: F.max(F.when(F.col("id.is_good") == good, F.col(c)))
    both = rules.groupBy(F.col("id.pair").alias("pair")).agg(by(True, "verdict").alias("g"), by(False, "verdict").alias("b"), by(False, "reason").alias("why"))
    out = placed.join(by_merge(first), "pair", "left").join(by_merge(both), "pair", "left")
    chosen = (F.col("g") == "legal") & (F.col("b") == "illegal")
    disposition = F.when(F.col("good").isNull(), "same_outcome").when(F.col("place").isNull(), "equivalent_decisions").when(F.col("asked"), "different_actual_prefix").when(chosen, "selected")
    disposition = disposition.when((F.col("g") == "legal") & (F.col("b") == "legal"), "legal_alternative_tie").otherwise("unknown_current_semantics")
    return out.select("pair", disposition.alias("disposition"), "place", F.when(chosen, F.col("why")).alias("reason"))


def protocol_breaks(messages: DataFrame, key: str) -> DataFrame:
    """(key, rule) of histories (key, place, role, call, answers): the first rule broken, or null.

    A call's id is new; a tool's message answers an open call; no other message comes while a call is open; the last message
    is a user's or a tool's, with no call open. A call is open from its message to the first tool's message that answers it.
    """
    own = Window.partitionBy(key)
    seen = lambda c: F.row_number().over(Window.partitionBy(key, c).orderBy("place"))
    numbered = messages.withColumns({"nth_call": F.when(F.col("call").isNotNull(), seen("call")), "nth_answer": F.when(F.col("answers").isNotNull(), seen("answers"))})
    calls = messages.filter("call is not null").groupBy(key, F.col("call").alias("answers")).agg(F.min("place").alias("called"))
    rows = numbered.join(calls, [key, "answers"], "left")
    answered = (F.col("role") == "tool") & F.coalesce((F.col("nth_answer") == 1) & (F.col("called") < F.col("place")), F.lit(False))
    change = F.when(F.col("nth_call") == 1, 1).otherwise(0) - F.when(answered, 1).otherwise(0)
    running = F.sum("change").over(own.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"answered": answered, "change": change}).withColumn("open", F.coalesce(running, F.lit(0)))
    rule = F.when((F.col("role") == "tool") & ~F.col("answered"), "observation_without_call").when((F.col("role") != "tool") & (F.col("open") > 0), "call_not_observed").when(F.col("nth_call") > 1, "call_id_repeated")
    found = rows.withColumn("rule", rule).groupBy(key).agg(F.min(F.when(F.col("rule").isNotNull(), F.struct("place", "rule"))).alias("first"), F.sum("change").alias("left"), F.max_by("role", "place").alias("last"))
    ended = F.when(F.col("left") > 0, "call_not_observed").when(~F.col("last").isin("user", "tool"), "not_before_a_decision")
    return found.select(key, F.coalesce("first.rule", ended).alias("rule"))


#: Events after which a trace can't succeed.
FAILING = ("rejected", "budget_exhausted", "timed_out", "cancelled")


def judged_traces(events: DataFrame, key: str, strategies: DataFrame, finals: DataFrame) -> DataFrame:
    """(key, outcome, reason, n_calls, n_matching, n_unnecessary, recovered) of recorded executions.

    events: (key, place, index, event, call, call_id, result_id, result, status, retryable); strategies: (key, calls, steps),
    steps being call and result texts joined; finals: (key, final, agrees): the last action, null if there was none, and
    whether it is a permitted answer. The executor is sequential: an observation answers the execution right before it. Broken
    records are unknown; what failed, was cut short or differs from every strategy is a failure.
    """
    order = Window.partitionBy(key).orderBy("place")
    acts = events.filter(F.col("event").isin("tool_execution", "observing"))
    before = {c: F.lag(c).over(order) for c in ("event", "call", "call_id")}
    acts = acts.withColumns({f"was_{c}": w for c, w in before.items()})
    after_run = F.coalesce(F.col("was_event") == "tool_execution", F.lit(False))
    answers = after_run & F.coalesce((F.col("call") == F.col("was_call")) & (F.col("call_id") == F.col("was_call_id")) & (F.col("result_id") == F.col("call_id")), F.lit(False))
    broken = F.when(F.col("event") == "tool_execution", F.when(after_run | F.col("call").isNull(), "invalid_execution_order")).when(~answers, "observation_without_execution")
    gaps = events.filter("index <> place").select(key, "place", F.lit(0).alias("rank"), F.lit("discontinuous").alias("rule"))
    breaks = acts.select(key, "place", F.lit(1).alias("rank"), broken.alias("rule")).filter("rule is not null").union(gaps)
    first = breaks.groupBy(key).agg(F.min(F.struct("place", "rank", "rule")).alias("b")).select(key, F.col("b.rule").alias("broken"))
    ran = F.col("event") == "tool_execution"
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("place", "call", "result")))), lambda x: F.struct(x["call"].alias("call"), F.concat_ws("|", x["call"], x["result"]).alias("step")))
    sums = acts.groupBy(key).agg(in_order(ran).alias("runs"), in_order(~ran).alias("seen"), F.max_by("event", "place").alias("last"))
    ended = events.groupBy(key).agg(F.bool_or(F.col("event").isin(*FAILING)).alias("failing"))
    late = F.max(F.when((F.col("event") == "observing") & (F.col("status") == "completed"), F.col("place"))).over(Window.partitionBy(key, "call"))
    retried = acts.withColumn("late", late).filter("event = 'observing' AND status <> 'completed' AND retryable")
    back = retried.groupBy(key).agg(F.bool_and(F.coalesce(F.col("late") > F.col("place"), F.lit(False))).alias("recovered"))
    ways = strategies.groupBy(key).agg(F.collect_list("calls").alias("ways"), F.collect_list("steps").alias("wholes"))
    rows = ended.join(first, key, "left").join(sums, key, "left").join(back, key, "left").join(ways, key, "left").join(finals, key, "left")
    nothing = F.array().cast("array<string>")
    calls = F.coalesce(F.transform("runs", lambda x: x["call"]), nothing)
    steps = F.coalesce(F.transform("seen", lambda x: x["step"]), nothing)
    rows = rows.withColumns({"calls": calls, "steps": steps})
    upto = lambda s, n: F.slice(s, F.lit(1), n)
    numbers = F.filter(F.sequence(F.lit(0), F.size("calls")), lambda n: n > 0)
    matching = F.size(F.filter(numbers, lambda n: F.exists("ways", lambda s: (F.size(s) >= n) & (upto(s, n) == upto(F.col("calls"), n)))))
    longest = F.array_max(F.transform("ways", lambda s: F.size(s)))
    outcome = F.when(F.col("broken").isNotNull(), "unknown")
    reason = F.when(F.col("broken").isNotNull(), F.col("broken"))
    for holds, why in ((F.col("failing"), "terminated"), (F.col("last") == "tool_execution", "incomplete_execution"), (~F.array_contains("wholes", F.col("steps")), "execution_not_permitted"), (F.col("final").isNull(), "no_final_action"), (~F.col("agrees"), "final_value_differs")):
        outcome, reason = outcome.when(holds, "failure"), reason.when(holds, why)
    return rows.select(
        key, outcome.otherwise("success").alias("outcome"), reason.otherwise("answer_and_execution_agree").alias("reason"), F.size("calls").cast("bigint").alias("n_calls"), matching.cast("bigint").alias("n_matching"),
        F.greatest(F.size("calls") - longest, F.lit(0)).cast("bigint").alias("n_unnecessary"), "recovered",
    )


def dependencies(events: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(key, observed): whether, for each pair (parent, child) of executions by number, the parent was observed before the decision that made the child."""
    order = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda name: F.sum(F.when(F.col("event") == name, 1).otherwise(0)).over(order)
    rows = events.withColumns({"decision": count("deciding"), "run": count("tool_execution")})
    made = rows.filter("event = 'tool_execution'").select(key, (F.col("run") - 1).alias("child"), F.col("decision").alias("made"))
    seen = rows.filter("event = 'observing' AND run > 0").groupBy(key, (F.col("run") - 1).alias("parent")).agg(F.max("decision").alias("seen"))
    wanted = events.select(key).distinct().crossJoin(F.broadcast(pairs))  # a few pairs, the same for every trace
    both = wanted.join(made, [key, "child"], "left").join(seen, [key, "parent"], "left")
    return both.groupBy(key).agg(F.bool_and(F.coalesce(F.col("seen") < F.col("made"), F.lit(False))).alias("observed"))


_FIND, _SEEK, _TWO = ('{"arguments":{"x":1},"name":"find"}', '{"arguments":{},"name":"seek"}', '{"arguments":{"x":2},"name":"find"}')


def _rules(spark: SparkSession) -> dict[str, DataFrame]:
    """Two cases that need one call and have one answer; in the second other answers may be right, too."""
    frame = spark.createDataFrame
    return {
        "cases": frame([(0, 1, True, True), (1, 1, False, True)], "case int, needed int, closed boolean, stated boolean"), "strategies": frame([(0, [_FIND]), (1, [_FIND])], "case int, steps array<string>"),
        "domain": frame([(0, "find", _FIND), (1, "find", _FIND)], "case int, name string, call string"), "answers": frame([(0, "final:7"), (1, "final:7")], "case int, answer string"),
    }


def _said(form: Column) -> list[Column]:
    """kind, calls and answer of six actions: the right call, another tool, another argument, two calls, the answer, another answer."""
    call = lambda name, text: F.struct(F.lit(name).alias("name"), F.lit(text).alias("call"))
    find, none = call("find", _FIND), F.array().cast("array<struct<name: string, call: string>>")
    calls = pick(form, F.array(find), F.array(call("seek", _SEEK)), F.array(call("find", _TWO)), F.array(find, find), none, none)
    return [F.when(form < 4, "tool_calls").otherwise("final").alias("kind"), calls.alias("calls"), F.when(form == 4, "final:7").when(form == 5, "final:8").alias("answer")]


def _seen(yes: Column) -> Column:
    return F.when(yes, F.array(F.lit(_FIND))).otherwise(F.array().cast("array<string>"))


@query("""SELECT s_suppkey, CASE WHEN seen THEN CASE k WHEN 4 THEN 'legal' ELSE 'illegal' END ELSE CASE k WHEN 0 THEN 'legal' ELSE 'illegal' END END AS verdict, CASE WHEN seen AND k IN (0, 3) THEN 'extra_call' WHEN NOT seen AND k = 0 THEN 'known_permitted_continuation' WHEN k = 3 THEN 'extra_call' WHEN k = 1 THEN 'tool_confusion' WHEN k = 2 THEN 'argument_semantics' WHEN k = 5 THEN 'final_semantics' WHEN seen THEN 'known_permitted_answer' ELSE 'premature_termination' END AS reason FROM (SELECT s_suppkey, s_suppkey % 6 AS k, s_suppkey % 4 < 2 AS seen FROM supplier)""")
def decision_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Six actions in turn, before and after the one needed call was observed."""
    key = F.col("s_suppkey")
    decisions = table(spark, d, "supplier").select(key.alias("id"), F.lit(0).alias("case"), _seen(key % 4 < 2).alias("observed"), *_said(key % 6))
    return decision_rules(decisions, **_rules(spark)).withColumnRenamed("id", "s_suppkey")


@query("""SELECT p_partkey, CASE WHEN k = 3 THEN 'same_outcome' WHEN k = 5 THEN 'different_actual_prefix' WHEN k = 1 THEN 'unknown_current_semantics' ELSE 'selected' END AS disposition, CASE WHEN k IN (1, 5) THEN 1 WHEN k <> 3 THEN 0 END AS place, CASE WHEN k IN (0, 2) THEN 'argument_semantics' WHEN k = 4 THEN 'tool_confusion' END AS reason FROM (SELECT p_partkey, p_partkey % 6 AS k FROM part)""")
def pair_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of recorded trajectories: where the first illegal decision differs from a legal one made from the same input."""
    k, odd = F.col("pair") % 6, F.col("pair") % 2 != 0
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("pair"))
    other = F.when(k == 3, "success").otherwise("failure")
    pairs = parts.select("pair", F.when(odd, "success").otherwise(other).alias("left"), F.when(odd, other).otherwise("success").alias("right"))
    sides = parts.select("pair", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))
    good = (F.col("side") == "left") == odd
    rows = sides.select("pair", "side", (good | (k == 3)).alias("good"), F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    first = F.col("place") == 0
    form = F.when(first, F.when(F.col("good") | (k % 2 != 0), 0).when(k < 4, 2).otherwise(1)).otherwise(F.when(F.col("good"), 4).otherwise(5))
    asked = F.when(first, "turn 0").when(F.col("good") | (k != 5), "turn 1").otherwise("turn 1, another branch")
    decisions = rows.select("pair", "side", "place", asked.alias("input"), F.when(k == 1, 1).otherwise(0).alias("case"), _seen(~first).alias("observed"), *_said(form))
    return preferred_pairs(pairs, decisions, **_rules(spark)).select(F.col("pair").alias("p_partkey"), "disposition", F.col("place").cast("bigint").alias("place"), "reason")


@query("""SELECT DISTINCT conv_id, CASE WHEN k = 1 THEN 'call_not_observed' WHEN k = 2 THEN 'observation_without_call' WHEN k = 3 THEN 'call_id_repeated' WHEN k = 4 THEN 'not_before_a_decision' END AS rule FROM (SELECT conv_id, conv_id % 5 AS k FROM conversations)""")
def protocol_checks(spark: SparkSession, d: str) -> DataFrame:
    """Histories with calls and observations written after each conversation's first turn, broken in four ways in turn."""
    first = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("t"))
    turn = lambda place, role, call, answers: F.struct(F.lit(place).alias("place"), F.lit(role).alias("role"), F.lit(call).cast("string").alias("call"), F.lit(answers).cast("string").alias("answers"))
    user, call, seen = turn(0, "user", None, None), turn(1, "assistant", "c1", None), turn(2, "tool", None, "c1")
    forms = [[user, call, seen], [user, call, turn(2, "user", None, None)], [user, turn(1, "tool", None, "c9")], [user, call, seen, turn(3, "assistant", "c1", None)], [user, turn(1, "assistant", None, None)]]
    rows = first.select("conv_id", F.explode(pick(F.col("conv_id"), *(F.array(*f) for f in forms))).alias("m")).select("conv_id", "m.*")
    return protocol_breaks(rows, "conv_id")


def _trace(user: Column) -> Column:
    """Events of a recorded execution for a user, of eight forms in turn: place, index, event, call's id, status, retryable."""
    event = lambda place, name, call=None, status=None, index=None, retry=False: F.struct(F.lit(place).alias("place"), F.lit(place if index is None else index).alias("index"), F.lit(name).alias("event"), F.lit(call).cast("string").alias("call_id"), F.lit(status).cast("string").alias("status"), F.lit(retry).alias("retryable"))
    run = lambda at, call="c1": [event(at, "tool_execution", call), event(at + 1, "observing", call, "completed")]
    forms = [
        [event(0, "deciding"), *run(1), event(3, "finalized")], [event(0, "deciding"), *run(1), event(3, "timed_out")], [event(0, "deciding"), event(1, "tool_execution", "c1"), event(2, "finalized")],
        [event(0, "deciding"), event(1, "observing", "c1", "completed")], [event(0, "deciding"), *run(1)[:1], event(2, "observing", "c2", "completed")], [event(0, "deciding"), event(1, "tool_execution", "c1", index=5)],
        [event(0, "deciding"), event(1, "tool_execution", "c1"), event(2, "observing", "c1", "failed", retry=True), event(3, "deciding"), *run(4, "c2"), event(6, "finalized")], [event(0, "finalized")],
    ]
    return pick(user, *(F.array(*f) for f in forms))


@query("""SELECT user_id, CASE WHEN k IN (3, 4, 5) THEN 'unknown' WHEN k IN (0, 6) AND user_id % 3 <> 0 THEN 'success' ELSE 'failure' END AS outcome, CASE k WHEN 1 THEN 'terminated' WHEN 2 THEN 'incomplete_execution' WHEN 3 THEN 'observation_without_execution' WHEN 4 THEN 'observation_without_execution' WHEN 5 THEN 'discontinuous' WHEN 7 THEN 'execution_not_permitted' ELSE CASE WHEN user_id % 3 <> 0 THEN 'answer_and_execution_agree' ELSE 'final_value_differs' END END AS reason,
CASE WHEN k IN (3, 7) THEN 0 WHEN k = 6 THEN 2 ELSE 1 END AS n_calls, CASE WHEN k IN (3, 7) THEN 0 ELSE 1 END AS n_matching, CASE WHEN k = 6 THEN 1 ELSE 0 END AS n_unnecessary, CASE WHEN k = 6 THEN true END AS recovered FROM (SELECT DISTINCT user_id, user_id % 8 AS k FROM events)""")
def trace_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Recorded executions judged against permitted ones and answers, with diagnostics of their calls; broken records are unknown."""
    users = table(spark, d, "events").select("user_id").distinct()
    call = F.concat(F.lit('{"arguments":{"user":'), F.col("user_id").cast("string"), F.lit('},"name":"find"}'))
    result = lambda status: F.concat(F.lit('{"status":"'), status, F.lit('"}'))
    rows = users.select("user_id", F.explode(_trace(F.col("user_id"))).alias("e")).select("user_id", "e.*")
    events = rows.withColumns({"call": F.when(F.col("call_id").isNotNull(), call), "result_id": F.when(F.col("status").isNotNull(), F.col("call_id")), "result": F.when(F.col("status").isNotNull(), result(F.col("status")))})
    step = lambda status: F.concat_ws("|", call, result(F.lit(status)))
    whole = F.explode(F.array(F.array(step("completed")), F.array(step("failed"), step("completed"))))
    # Of a call and its repetition after a failure, the permitted calls are those of the first alone.
    strategies = users.select("user_id", F.array(call).alias("calls"), whole.alias("steps"))
    ended = rows.filter("event = 'finalized'").select("user_id").distinct()
    finals = ended.select("user_id", F.concat(F.lit("final:"), (F.col("user_id") % 16).cast("string")).alias("final"), (F.col("user_id") % 3 != 0).alias("agrees"))
    return judged_traces(events, "user_id", strategies, finals)


@query("SELECT s_suppkey, s_suppkey % 4 <> 2 AS observed FROM supplier")
def dependency_observations(spark: SparkSession, d: str) -> DataFrame:
    """Whether an execution's dependent one was decided only after its observation: two decisions, and one for both."""
    event = lambda place, name: F.struct(F.lit(place).alias("place"), F.lit(name).alias("event"))
    apart = [event(i, n) for i, n in enumerate(("deciding", "tool_execution", "observing", "deciding", "tool_execution", "observing"))]
    together = [event(i, n) for i, n in enumerate(("deciding", "tool_execution", "observing", "tool_execution", "observing"))]
    rows = table(spark, d, "supplier").select("s_suppkey", F.explode(F.when(F.col("s_suppkey") % 4 == 2, F.array(*together)).otherwise(F.array(*apart))).alias("e")).select("s_suppkey", "e.*")
    return dependencies(rows, "s_suppkey", spark.createDataFrame([(0, 1)], "parent int, child int"))
