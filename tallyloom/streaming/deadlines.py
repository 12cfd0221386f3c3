"""Requests with a queue deadline: dispatched, cancelled or timed out; the same on a stream, with event-time timers, as in a batch.

A `click` opens a request of its user; the user's first `purchase` after it dispatches it, the first `error` cancels it, if it
comes before the deadline; else it times out then. A request that ends stays ended.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import micros
from ..plans.registry import query
from ..session import ship_package
from ..sources.tables import table

DEADLINE_US = 600_000_000
OUTCOMES = {"purchase": "dispatched", "error": "cancelled"}
_RESULT = "user_id long, event_id long, outcome string, ended_us long"


def outcomes(events: DataFrame, deadline_us: int = DEADLINE_US) -> DataFrame:
    """(user_id, event_id, outcome, ended_us) of every click (event_id, user_id, event_type, ts); rows without a user or time are left out.

    Time is cut into spans as long as the deadline; a row stands in its own span and in the one before it, so the window that
    looks ahead from a click sees two spans of one user, and a user's rows needn't meet. Of equal times, lower ids come first.
    """
    rows = events.filter("user_id is not null and ts is not null").select("user_id", "event_id", "event_type", micros(F.col("ts")).alias("t")).filter(F.col("event_type").isin("click", *OUTCOMES))
    own = F.floor(F.col("t") / deadline_us)
    ends = F.col("event_type") != "click"
    spans = rows.withColumn("own", own).withColumn("span", F.explode(F.when(ends, F.array(own, own - 1)).otherwise(F.array(own))))
    ahead = Window.partitionBy("user_id", "span").orderBy("t", "event_id").rowsBetween(1, Window.unboundedFollowing)
    first = F.first(F.when(ends, F.struct("t", "event_type")), ignorenulls=True).over(ahead)
    found = spans.withColumn("end", first).filter("event_type = 'click'")
    timely = F.coalesce(F.col("end.t") < F.col("t") + deadline_us, F.lit(False))
    kind = F.when(F.col("end.event_type") == "purchase", OUTCOMES["purchase"]).otherwise(OUTCOMES["error"])
    return found.select("user_id", "event_id", F.when(timely, kind).otherwise("timed_out").alias("outcome"), F.when(timely, F.col("end.t")).otherwise(F.col("t") + deadline_us).alias("ended_us"))


def _processor(deadline_us: int):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Requests(StatefulProcessor):
        """Keeps a user's rows until the watermark has passed the deadlines they matter to; a request is judged by its timer."""

        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getMapState("open", "event_id long", "t long")
            self.ends = handle.getMapState("ends", "event_id long", "t long, kind string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            for frame in rows:
                for ident, t, kind in zip(frame["event_id"], frame["t_us"], frame["event_type"], strict=True):
                    if kind == "click":
                        self.open.updateValue((int(ident),), (int(t),))
                        # A millisecond on, so that all rows before the deadline have come.
                        self.handle.registerTimer(int(t + deadline_us) // 1000 + 1)
                    else:
                        self.ends.updateValue((int(ident),), (int(t), str(kind)))
                        self.handle.registerTimer(int(t + deadline_us) // 1000 + 2)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = expiredTimerInfo.getExpiryTimeInMs()
            ends = sorted((v[0], k[0], v[1]) for k, v in self.ends.iterator())
            out = []
            for (ident,), (t,) in list(self.open.iterator()):
                if (t + deadline_us) // 1000 + 1 <= now:
                    hit = next((e for e in ends if (e[0], e[1]) > (t, ident)), None)
                    timely = hit is not None and hit[0] < t + deadline_us
                    out.append((key[0], ident, OUTCOMES[hit[2]] if timely else "timed_out", hit[0] if timely else t + deadline_us))
                    self.open.removeKey((ident,))
            for t, ident, _ in ends:
                if (t + deadline_us) // 1000 + 2 <= now:  # every request that it could end is judged
                    self.ends.removeKey((ident,))
            return iter((pd.DataFrame(out, columns=["user_id", "event_id", "outcome", "ended_us"]),) if out else ())

        def close(self) -> None:
            pass

    return Requests()


def outcomes_of_stream(events: DataFrame, deadline_us: int = DEADLINE_US, late: str = "1 hour") -> DataFrame:
    """outcomes() of a stream, each once the watermark, `late` behind, has passed its deadline; rows in any order up to then count, later ones are dropped.

    Needs a state store that keeps maps (spark.sql.streaming.stateStore.providerClass: the RocksDB one).
    """
    ship_package(events.sparkSession)
    rows = events.filter("user_id is not null and ts is not null").filter(F.col("event_type").isin("click", *OUTCOMES))
    timed = rows.select("user_id", "event_id", "event_type", micros(F.col("ts")).alias("t_us"), F.col("ts").cast("timestamp").alias("t")).withWatermark("t", late)
    return timed.groupBy("user_id").transformWithStateInPandas(_processor(deadline_us), _RESULT, "append", "eventTime")


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t FROM events WHERE event_type IN ('click', 'purchase', 'error')),
x AS (SELECT c.user_id, c.event_id, c.t, min(struct_pack(t := z.t, i := z.event_id, k := z.event_type)) AS z FROM e c LEFT JOIN e z ON z.user_id = c.user_id AND z.event_type <> 'click' AND (z.t, z.event_id) > (c.t, c.event_id) AND z.t < c.t + 600000000 WHERE c.event_type = 'click' GROUP BY ALL)
SELECT user_id, event_id, CASE WHEN z.k IS NULL THEN 'timed_out' WHEN z.k = 'purchase' THEN 'dispatched' ELSE 'cancelled' END AS outcome, coalesce(z.t, t + 600000000) AS ended_us FROM x""")
def request_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """What became of every click's request within ten minutes, in batch; `outcomes_of_stream` gives the same rows on a stream."""
    return outcomes(table(spark, d, "events"))
