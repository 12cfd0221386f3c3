"""Overlaps of two tables of intervals that share no key: as pairs, or counted and summed without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import checkpoint_folder
from ..sources.tables import table
from .order import running_totals

#: Parts of a level's bin, or of one that is divided; rows of both sides beyond which a bin is divided.
PARTS, CROWD = 64, 4_096
#: Most crowded bins that are broadcast.
BROADCAST_BINS = 500_000


def _binned(rows: DataFrame, width: int, levels: int) -> DataFrame:
    """A row for each bin an interval touches: at its own level, where it spans few bins, and at the coarser ones."""
    span = F.col("end") - F.col("start")
    own = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        own = F.when(span <= width * PARTS ** (k + 1), k).otherwise(own)
    at = rows.withColumn("own", own).withColumn("level", F.explode(F.sequence(F.col("own"), F.lit(levels - 1))))
    size = F.lit(width).cast("bigint") * F.pow(F.lit(PARTS), F.col("level")).cast("bigint")
    sized = at.withColumn("size", size)
    first, last = (F.floor(c / F.col("size")) for c in (F.col("start"), F.col("end") - 1))
    each = sized.withColumn("lo", F.explode(F.sequence(first, last))).withColumn("lo", F.col("lo") * F.col("size"))
    return each.withColumn("hi", F.col("lo") + F.col("size")).drop("size")


def _divided(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """rows, those of crowded bins once for each part of the bin that they touch."""
    marked = rows.join(crowded, ["level", "lo", "hi"], "left")
    step = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / PARTS), F.lit(1)).cast("bigint")
    first = F.floor((F.greatest("start", "lo") - F.col("lo")) / step)
    last = F.floor((F.least(F.col("end") - 1, F.col("hi") - 1) - F.col("lo")) / step)
    part = F.explode(F.when(F.col("crowded"), F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("bigint"))))
    each = marked.withColumn("part", part).withColumn("step", step)
    lo = F.when(F.col("part") < 0, F.col("lo")).otherwise(F.col("lo") + F.col("part") * F.col("step"))
    hi = F.when(F.col("part") < 0, F.col("hi")).otherwise(F.least(F.col("hi"), F.col("lo") + (F.col("part") + 1) * F.col("step")))
    return each.withColumns({"lo": lo, "hi": hi}).drop("part", "step", "crowded")


def overlaps(left: DataFrame, right: DataFrame, width: int, *, levels: int = 4, rounds: int = 2, crowd: int = CROWD) -> DataFrame:
    """(left_id, right_id, start, end): the pairs of intervals that overlap, and where; left, right: (id, start, end), whole numbers.

    Intervals are half open, start to end; empty and unknown ones overlap nothing. Each touches bins of `width` units, longer
    ones bins `PARTS` times as wide for each level; a pair meets at the coarser of its two levels, in the bin that holds the
    place where the overlap begins, and so once. Bins of more than `crowd` rows are divided, up to `rounds` times. Rows
    of the result apart, no step needs an interval's rows together.
    """
    spark = left.sparkSession
    checkpoint_folder(spark)
    real = "start < end"
    sides = [_binned(side.select("id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).filter(real), width, levels) for side in (left, right)]
    for _ in range(rounds):
        sides = [side.checkpoint() for side in sides]
        counts = [side.groupBy("level", "lo", "hi").agg(F.count("*").alias(f"n{k}")) for k, side in enumerate(sides)]
        crowded = counts[0].join(counts[1], ["level", "lo", "hi"]).filter(f"n0 + n1 > {crowd} AND hi - lo > 1").select("level", "lo", "hi", F.lit(True).alias("crowded")).checkpoint()
        n = crowded.count()
        if not n:
            break
        sides = [_divided(side, F.broadcast(crowded) if n <= BROADCAST_BINS else crowded) for side in sides]
    x, y = (side.select("level", "lo", "hi", F.col("own").alias(f"own_{s}"), F.col("id").alias(f"{s}_id"), F.col("start").alias(f"start_{s}"), F.col("end").alias(f"end_{s}")) for side, s in zip(sides, ("left", "right"), strict=True))
    begins = F.greatest("start_left", "start_right")
    met = x.join(y, ["level", "lo", "hi"]).filter((F.col("start_left") < F.col("end_right")) & (F.col("start_right") < F.col("end_left")) & (F.greatest("own_left", "own_right") == F.col("level")) & (begins >= F.col("lo")) & (begins < F.col("hi")))
    return met.select("left_id", "right_id", begins.alias("start"), F.least("end_left", "end_right").alias("end"))


def overlap_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, n, total) of the intervals of `right` that overlap any of `left`: how many, and how long together; both (id, start, end), whole numbers.

    No pair is formed. Up to any time t, the starts before it less the ends are the intervals open, and the time spent in
    them all is t times these, less the sum of the starts' times, plus that of the ends'. An interval's figures are differences of such running sums
    at its end and start. Equal times go as one point, so rows are as many as different times.
    """
    real = "start < end"
    l, r = left.filter(real).select("start", "end"), right.filter(real).select("id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    # At one time: ends come first, then what is asked, then starts.
    point = lambda at, kind, n_starts, n_ends: F.struct(F.col(at).cast("bigint").alias("t"), F.lit(kind).alias("kind"), F.lit(n_starts).cast("bigint").alias("starts"), F.lit(n_ends).cast("bigint").alias("ends"))
    points = l.select(F.explode(F.array(point("start", 2, 1, 0), point("end", 0, 0, 1))).alias("p")).union(r.select(F.explode(F.array(point("start", 1, 0, 0), point("end", 1, 0, 0)))))
    at = points.groupBy("p.t", "p.kind").agg(F.sum("p.starts").alias("starts"), F.sum("p.ends").alias("ends")).withColumns({"g": F.lit(0), "moment": F.col("t").cast("decimal(38,0)") * (F.col("starts") - F.col("ends"))})
    sums = running_totals(at, "g", ["t", "kind"], {"starts": "n_starts", "ends": "n_ends", "moment": "moments"}).filter("kind = 1")
    spent = F.col("t").cast("decimal(38,0)") * (F.col("n_starts") - F.col("n_ends")) - F.col("moments")
    known = sums.select("t", "n_starts", "n_ends", spent.alias("spent")).checkpoint()
    begun = known.select(F.col("t").alias("start"), F.col("n_ends").alias("gone"), F.col("spent").alias("spent_before"))
    ended = known.select(F.col("t").alias("end"), F.col("n_starts").alias("come"), "spent")
    met = r.hint("merge").join(begun, "start").join(ended.hint("merge"), "end").withColumn("n", F.col("come") - F.col("gone")).filter("n > 0")
    return met.select("id", "n", (F.col("spent") - F.col("spent_before")).cast("bigint").alias("total"))


def micros(ts: Column) -> Column:
    """A timestamp's microseconds since 1970; of one without a zone, as if in UTC."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000
    second = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1_000_000
    return day + second + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


_CLICKS = "(SELECT click_id, epoch_us(ts) AS s, epoch_us(arrived_at) AS e FROM clicks WHERE ts < arrived_at)"


@query(f"""SELECT event_id, count(*) AS n_clicks, CAST(sum(least(c.e, v.e) - greatest(c.s, v.s)) AS BIGINT) AS overlap_us
FROM {_CLICKS} c JOIN (SELECT event_id, epoch_us(ts) AS s, epoch_us(ts) + 600000000 AS e FROM events WHERE event_type = 'error') v ON c.s < v.e AND v.s < c.e GROUP BY 1""")
def clicks_under_way(spark: SparkSession, d: str) -> DataFrame:
    """Of the ten minutes after each error event: the clicks that were under way then (made, not yet arrived), and for how long together."""
    clicks = table(spark, d, "clicks").select(F.col("click_id").alias("id"), micros(F.col("ts")).alias("start"), micros(F.col("arrived_at")).alias("end"))
    errors = table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), micros(F.col("ts")).alias("start"))
    found = overlap_totals(clicks, errors.withColumn("end", F.col("start") + 600_000_000))
    return found.groupBy(F.col("id").alias("event_id")).agg(F.sum("n").alias("n_clicks"), F.sum("total").alias("overlap_us"))
