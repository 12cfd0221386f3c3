"""Queries over the record functions: canonical JSON, times, map differences and padded sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import canonical_json, changed_keys, equivalent_json, padded, pointer_token, utc_timestamp
from ..functions.text import smallest_bucket
from ..plans.registry import query
from ..session import ship_package
from ..sources.tables import table


@query("SELECT event_id, json AS canonical, sha256(json) AS digest, event_id % 2 = 0 AS same FROM (SELECT event_id, '{\"a\":[true,null],\"p\":' || replace(props, ' ', '') || '}' AS json FROM events)")
def canonical_props(spark: SparkSession, d: str) -> DataFrame:
    """Canonical text and digest of events' properties in a wider object, and whether another writing of it is equivalent."""
    ship_package(spark)
    wide = F.concat(F.lit('{"p": '), F.col("props"), F.lit(', "a": [true, null]}'))
    other = F.concat(F.lit('{"a": ['), F.when(F.col("event_id") % 2 == 0, "true").otherwise("1"), F.lit(', null], "p": '), F.col("props"), F.lit("}"))
    found = table(spark, d, "events").select("event_id", canonical_json(wide).alias("canonical"), equivalent_json(wide, other).alias("same"))
    return found.select("event_id", "canonical", F.sha2("canonical", 256).alias("digest"), "same")


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN epoch(date_trunc('second', ts))::BIGINT END AS second FROM events")
def utc_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of stamps written with Z, a zero offset and another offset, the last of which isn't UTC."""
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+00:00"), F.lit("+02:00")), (F.col("event_id") % 3 + 1).cast("int"))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, d, "events").select("event_id", F.unix_timestamp(utc_timestamp(stamp)).alias("second"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'a~1size' ELSE 'a~1size,b~0type' END AS changed, p_partkey % 3 = 1 AS single FROM part")
def revised_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Which attributes a revision changes, as steps of JSON pointers, and whether it is exactly one."""
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    maps = [F.create_map(F.lit("a/size"), s, F.lit("b~type"), t) for s, t in ((size, F.col("p_type")), (F.when(k > 0, F.concat(size, F.lit("+"))).otherwise(size), F.when(k < 2, F.col("p_type"))))]
    keys = changed_keys(*maps)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(keys, pointer_token), ",").alias("changed"), (F.size(keys) == 1).alias("single"))


@query("SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, CAST(bucket AS BIGINT) AS n_padded, CASE WHEN bucket IS NOT NULL THEN CAST(bucket - n AS BIGINT) END AS n_pads FROM (SELECT doc_id, n, CASE WHEN n <= 64 THEN 64 WHEN n <= 256 THEN 256 WHEN n <= 1024 THEN 1024 END AS bucket FROM (SELECT doc_id, len(string_split(coalesce(text, ''), ' ')) AS n FROM documents))")
def padded_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Word lengths of each text as ids, padded on the right to the smallest of three sizes that holds them; null if none does."""
    ids = F.transform(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: F.length(w) + 1)
    docs = table(spark, d, "documents").select("doc_id", ids.alias("ids")).withColumn("bucket", smallest_bucket(F.size("ids"), [64, 256, 1024]))
    row = docs.withColumn("row", padded(F.col("ids"), 0, F.col("bucket"))).withColumn("fits", F.col("bucket").isNotNull())
    pads = F.size(F.filter("row", lambda i: i == 0))
    return row.select("doc_id", "bucket", *(F.when(F.col("fits"), c.cast("long")).alias(n) for c, n in ((F.size("row"), "n_padded"), (pads, "n_pads"))))
