"""An extension over events that the batch engine doesn't need: watermarked windows and sessions, batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; on a stream, rows later than the watermark are dropped."""
    timed = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return timed.groupBy(F.window("t", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_requests(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first row of each (user, type) within the watermark: idempotent replay of a stream."""
    timed = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return timed.dropDuplicatesWithinWatermark(["user_id", "event_type"])


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return tumbling(table(spark, d, "events")).select(F.unix_timestamp("w.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e), c AS (SELECT user_id, k, count(*) AS m FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(m) AS longest FROM c GROUP BY 1")
def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    timed = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    sessions = timed.groupBy("user_id", F.session_window("t", "30 minutes")).agg(F.count("*").alias("m"))
    return sessions.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("m").alias("longest"))
