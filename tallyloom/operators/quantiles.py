"""Exact quantiles by distributed selection: histograms refined around the wanted ranks, with no buffer of values.

A first histogram has a bin for each power of two, of either sign; each bin keeps its count, least and greatest value. The bin
that holds a wanted rank is divided anew, linearly between its own least and greatest value, until it holds few rows; those
are counted by value. What is kept between passes is one row for each group and wanted rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import checkpoint_folder
from ..sources.tables import table

#: Bins of a divided bin; rows below which a bin is counted by value; groups and ranks that are broadcast at most.
BINS, FEW, BROADCAST_RANKS = 4096, 20_000, 100_000


def _power(x: Column) -> Column:
    """A bin for each sign and power of two, in the order of the values."""
    far = F.when(F.abs(x) == float("inf"), F.lit(3000)).otherwise(F.floor(F.log2(F.abs(x))).cast("int") + 1100)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("int") * far)


def _picked(bins: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """The bin of each wanted rank: (g, t, place, n, lo, hi), its place counted from the bin's first row."""
    order = Window.partitionBy(*by).orderBy("bin")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = bins.withColumn("before", before).withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by]
    hit = placed.join(ranks, [*same, F.col("before") < F.col("place"), F.col("place") <= F.col("before") + F.col("n")])
    return hit.select("g", "t", (F.col("place") - F.col("before")).alias("place"), "n", "lo", "hi")


def exact_quantiles(df: DataFrame, group: Column, value: Column, disc: dict[str, float] | None = None, cont: dict[str, float] | None = None, few: int | None = None) -> DataFrame:
    """(g, n_rows, n, and a column for each name): of each group its rows, its known values, and quantiles of those.

    disc: the value at place ceil(n * p) (the first at least), of the values' type; cont: linear between the two values about
    place p * (n - 1), a double. Null and NaN values aren't known; a group without known values has null quantiles.
    """
    checkpoint_folder(df.sparkSession)
    disc, cont, few = disc or {}, cont or {}, FEW if few is None else few
    x = F.col("v").cast("double")
    rows = df.select(group.alias("g"), F.when(~F.isnan(value.cast("double")), value).alias("v"))
    measures = [F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    first = rows.groupBy("g", _power(x).alias("bin")).agg(*measures).checkpoint()
    sizes = first.groupBy("g").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))), F.lit(0)).alias("n"))
    places = [F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1)) for p in disc.values()]
    for p in cont.values():
        at = F.lit(p) * (F.col("n") - 1)
        places += [F.floor(at) + 1, F.ceil(at) + 1]
    ranks = sizes.filter("n > 0").select("g", F.posexplode(F.array(*(p.cast("bigint") for p in places))).alias("t", "place"))
    state = _picked(first.filter("bin is not null"), ranks, ["g"]).checkpoint()
    found = state.filter("lo = hi").select("g", "t", "lo")
    todo = state.filter("lo < hi")
    while (left := todo.count()) > 0:
        wanted = F.broadcast(todo) if left <= BROADCAST_RANKS else todo
        near = rows.withColumnRenamed("g", "_g").join(wanted, F.col("_g").eqNullSafe(F.col("g")) & F.col("v").between(F.col("lo"), F.col("hi"))).withColumn("small", F.col("n") <= few)
        # Of one sign, so no difference is too large; of longs and decimals it is exact.
        share = (F.col("v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double")
        bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1))
        dense = near.filter("not small").select("g", "t", bin_.alias("bin"), "v").groupBy("g", "t", "bin").agg(*measures)
        finer = _picked(dense, todo.select("g", "t", "place"), ["g", "t"])
        own = near.filter("small").select("g", "t", F.col("v").alias("bin"), "v").groupBy("g", "t", "bin").agg(*measures)
        ended = _picked(own, todo.select("g", "t", "place"), ["g", "t"])
        state = finer.unionByName(ended).checkpoint()
        found = found.union(state.filter("lo = hi").select("g", "t", "lo"))
        todo = state.filter("lo < hi")
    at = lambda k: F.max(F.when(F.col("t") == k, F.col("lo")))
    out = [at(k).alias(name) for k, name in enumerate(disc)]
    pairs = [(name, p, len(disc) + 2 * k) for k, (name, p) in enumerate(cont.items())]
    values = found.groupBy("g").agg(*out, *(f for _, _, k in pairs for f in (at(k).cast("double").alias(f"_a{k}"), at(k + 1).cast("double").alias(f"_b{k}")))).withColumnRenamed("g", "_g")
    both = sizes.join(values, F.col("_g").eqNullSafe(F.col("g")), "left")
    part = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    lines = [(F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * part(p)).alias(name) for name, p, k in pairs]
    return both.select("g", "n_rows", "n", *disc, *lines)


@query("""SELECT coalesce(lang, 'all') AS lang, count(*) AS n, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99 FROM documents GROUP BY ROLLUP (lang)""")
def length_quantiles_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Of each language and of all together."""
    level = lambda total, lang: F.struct(F.lit(total).alias("total"), lang.cast("string").alias("lang"))
    rows = table(spark, d, "documents").select("n_chars", F.explode(F.array(level(0, F.col("lang")), level(1, F.lit(None)))).alias("level"))
    found = exact_quantiles(rows, F.col("level"), F.col("n_chars"), {f"p{p}": p / 100 for p in (50, 90, 95, 99)})
    return found.select(F.coalesce("g.lang", F.lit("all")).alias("lang"), F.col("n_rows").alias("n"), "p50", "p90", "p95", "p99")


@query("SELECT round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents")
def length_linear_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = exact_quantiles(table(spark, d, "documents"), F.lit(0), F.col("n_chars"), cont={f"p{p}": p / 100 for p in (50, 95, 99)})
    return found.select(*(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query("SELECT event_type, count(*) AS n_planned, count(v) AS n_known, count(*) - count(v) AS n_missing, round(sum(v), 4) AS total, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, count(*) < 100 AS exploratory FROM (SELECT event_type, CASE WHEN value >= 5 THEN value - 5 END AS v FROM events) GROUP BY 1")
def numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of values less 5, of which negative ones aren't known: every measure is over the known ones, null where there is none; below 100 rows it is exploratory."""
    rows = table(spark, d, "events").select("event_type", F.when(F.col("value") >= 5, F.col("value") - 5).alias("v"))
    sums = rows.groupBy("event_type").agg(F.round(F.sum("v"), 4).alias("total"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("max"))
    found = exact_quantiles(rows, F.col("event_type"), F.col("v"), cont={"p50": 0.5, "p95": 0.95})
    both = found.join(sums, F.col("g").eqNullSafe(F.col("event_type")))
    missing, few = F.col("n_rows") - F.col("n"), F.col("n_rows") < 100
    return both.select("event_type", F.col("n_rows").alias("n_planned"), F.col("n").alias("n_known"), missing.alias("n_missing"), "total", "mean", "max", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), few.alias("exploratory"))


@query("SELECT field, count(v) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, round(sum(v) * 1.0 / sum(sum(v)) OVER (), 6) AS share FROM (SELECT role AS field, length(text) AS v FROM conversations) GROUP BY 1")
def length_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts, quantiles and the share of all characters, by field."""
    rows = table(spark, d, "conversations").select(F.col("role").alias("field"), F.char_length("text").cast("bigint").alias("v"))
    found = exact_quantiles(rows, F.col("field"), F.col("v"), {"p50": 0.5, "p95": 0.95})
    sums, whole = rows.groupBy("field").agg(F.sum("v").alias("total")), rows.agg(F.sum("v").alias("whole"))
    both = found.join(sums, F.col("g").eqNullSafe(F.col("field"))).join(F.broadcast(whole))  # one row
    return both.select("field", "n", "p50", "p95", F.round(F.col("total") / F.col("whole"), 6).alias("share"))


@query("SELECT client_id IS NULL AS unknown_client, kind, count(*) AS n, quantile_disc(value, 0.01) AS p1, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.999) AS p999, round(quantile_cont(value, 0.75), 6) AS upper FROM clicks GROUP BY ALL")
def click_value_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of clicks' values, with heavy tails of both signs, by kind and by whether the client is known."""
    rows = table(spark, d, "clicks").select("value", F.struct(F.col("client_id").isNull().alias("unknown"), "kind").alias("k"))
    found = exact_quantiles(rows, F.col("k"), F.col("value"), {"p1": 0.01, "p50": 0.5, "p999": 0.999}, {"upper": 0.75})
    return found.select(F.col("g.unknown").alias("unknown_client"), "g.kind", F.col("n_rows").alias("n"), "p1", "p50", "p999", F.round("upper", 6).alias("upper"))
