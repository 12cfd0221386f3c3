"""A corpus pipeline of five of the llm operators: rules, near duplicates, decontamination, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of documents. A
stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.aho_decontaminate import contamination
from tallyloom.llm.common import Scratch, keyed_join, kept
from tallyloom.llm.isolation_rules import rule_decisions
from tallyloom.llm.minhash_tensor import near_duplicates
from tallyloom.llm.piece_codec import encode_and_decode
from tallyloom.llm.queries import tokenizer_path
from tallyloom.llm.secret_forest import redact


def _without(docs: DataFrame, decisions: DataFrame, rejected: str, name: str) -> DataFrame:
    """docs without the ids for which the condition holds; broadcast only if those are few."""
    gone = kept(decisions.filter(rejected).select("doc_id").filter("doc_id is not null").distinct(), name)
    return keyed_join(docs, gone, "doc_id", "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, rule_decisions(docs, labels), "not kept", "rejected")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of smallest id."""
    return _without(docs, near_duplicates(docs), "not kept", "duplicates")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found, "contaminated", "contaminated")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows; no document goes."""
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    return redact(docs).withColumn("n_chars", size)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts; documents whose text doesn't survive the round trip show in decoded_sha256."""
    return encode_and_decode(docs, tokenizer_path("piece_bpe_32k.model"), outputs=False)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_dedup), ("decontamination", decontamination), ("secret scan", secret_scan), ("pieces", pieces)]

#: The forests, the minhash candidates and the vocabulary of pieces can't be expressed in SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"), "snappy")
        return scratch.result(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
