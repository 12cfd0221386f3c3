"""Sequences exported as packed arrays, and what the files give back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import checkpoint_folder
from ..sources.arrays import read_arrays, write_arrays
from ..sources.tables import table


@query("""WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS v FROM documents WHERE text IS NOT NULL)
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row, CAST(coalesce(sum(len(v)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(len(v) AS BIGINT) AS n_items, CAST(list_sum(v) AS BIGINT) AS total, CAST(list_max(v) AS BIGINT) AS longest FROM w""")
def packed_word_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The word lengths of all documents, exported as packed arrays in order of their ids, and read back: row, place and sums."""
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/packed-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.transform(F.split("text", " ", -1), F.char_length).alias("v"))
    write_arrays(docs, path, "doc_id", "v")
    found = read_arrays(spark, path)
    total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.col("id").alias("doc_id"), "row", "start", F.size("items").cast("long").alias("n_items"), total.alias("total"), F.array_max("items").alias("longest"))
