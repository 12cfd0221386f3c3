"""Sources and sinks: tables, strict JSON, CSV, and content-checked artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_rules import REPORT, column_of, json_report
from ..session import ship_package

#: Most bytes of a whole document.
DOCUMENT_BYTES = 512 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strictly(rows: DataFrame, column: str) -> DataFrame:
    """rows with the strict reading of a column of JSON: rule (that refuses it, or null), canonical, kind, nodes, depth."""
    ship_package(rows.sparkSession)
    return rows.withColumn("_r", column_of(json_report, REPORT, F.col(column))).select(*rows.columns, "_r.*")


def read_whole_json(spark: SparkSession, path: str, most: int = DOCUMENT_BYTES) -> DataFrame:
    """(path, rule, canonical, kind, nodes, depth) of files of one JSON value each; `over_bytes` ones aren't read, bytes that aren't UTF-8 are refused. Spark lists no empty file, so it gives no row."""
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= most).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    large = files.filter(F.col("length") > most).select("path", F.lit("over_bytes").alias("rule"))
    return strictly(small, "text").drop("text").unionByName(large, allowMissingColumns=True)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All cells as strings; a row of another shape fails the read, and so does another header."""
    if len(set(columns)) != len(columns):
        raise ValueError("a column stands twice")
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def write_csv(df: DataFrame, path: str) -> None:
    """Nested values as JSON text."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")}
    df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns)).write.mode("errorifexists").csv(path, header=True)


def write_canonical_lines(df: DataFrame, path: str, column: str, by: str | None = None) -> None:
    """A column of JSON as lines of canonical text, in a folder for each value of `by`; refuses the whole write if any row isn't strict JSON."""
    read = strictly(df, column)
    line = F.when(F.col("rule").isNotNull(), F.raise_error(F.concat(F.lit("refused: "), F.col("rule")))).otherwise(F.col("canonical"))
    writer = read.select(line.alias("value"), *([by] if by else [])).write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).text(path)


def artifact_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def leaves_root(path: Column) -> Column:
    """Whether a relative path is absolute, empty, names a parent, or uses another system's separators."""
    return path.startswith("/") | (path == "") | path.contains("\\") | path.rlike(r"(^|/)\.\.?(/|$)") | path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")


def manifest_violations(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows (path, problem) where files and a manifest (path, sha256) of relative paths differ: escaping, repeated, missing, extra or changed."""
    listed = manifest.groupBy("path").agg(F.first("sha256").alias("want"), F.count("*").alias("times"))
    both = found.select("path", F.col("sha256").alias("have")).join(listed, "path", "full")
    problem = F.when(leaves_root(F.col("path")), "escapes").when(F.col("times") > 1, "repeated").when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have") != F.col("want"), "changed")
    return both.select("path", problem.alias("problem")).filter("problem is not null")


def relative(hashes: DataFrame, root: str) -> DataFrame:
    """artifact_hashes with paths from a root folder on."""
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return hashes.withColumn("path", F.element_at(F.split("path", base.replace(".", "[.]"), 2), 2))


def content_fingerprint(hashes: DataFrame) -> DataFrame:
    """One row: a digest of any number of files' `path:sha256`, by the sums of two parts of each line's SHA-256, and their number."""
    digest = F.sha2(F.concat_ws(":", "path", "sha256"), 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return hashes.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(16)), 256).alias("fingerprint"), F.count("*").alias("n"))
