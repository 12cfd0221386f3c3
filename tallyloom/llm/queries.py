"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .aho_decontaminate import contamination
from .classifier_chain import toxicity
from .common import Scratch
from .huffman_ids import read_ids, write_ids
from .interpolated_lm import interpolated_scores
from .isolation_rules import rule_decisions
from .license_scan import license_labels
from .merkle_manifest import folded, manifest, proof_hash
from .minhash_tensor import near_duplicates
from .piece_codec import encode_and_decode
from .row_patterns import valleys
from .secret_forest import secret_findings
from .trie_counts import rank_scores, token_counts
from .warc_derivatives import derivatives, read_derivatives, response_rows, responses, stored, write_records


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(_table(spark, sf_dir, "documents"))


def op2_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_decisions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def categories() -> dict:
    """In chain order: of low quality; toxic, which sees the first's probability; both, which sees the two. The labels' table has no finer categories."""
    toxic, low = F.col("toxic") > 0, F.col("quality") <= 0
    return {"low_quality": low, "toxic": toxic, "toxic_junk": toxic & low}


def op3_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), categories(), stratum="toxic")


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), outputs=False)


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored WARC responses, their derivatives as stored records, and what those hold."""
    with Scratch(spark) as scratch:
        source, made = scratch.path("responses"), scratch.path("derivatives")
        write_records(responses(_table(spark, sf_dir, "pages")), source, "content")
        write_records(derivatives(response_rows(stored(spark, source))), made)
        return scratch.result(read_derivatives(stored(spark, made)).withColumnRenamed("key", "page_id"), "warc-rows")


def op6_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        path = scratch.path("id-blocks")
        write_ids(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
        return scratch.result(read_ids(spark, path, outputs=False), "id-rows")


def op7_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), rank_scores(tokenizer_path("piece_bpe_32k.model")))


def op8_aho_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_findings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op10_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.when(~F.isnan("value"), F.floor(100 * F.col("value") + 0.5))
    found = valleys(_table(spark, sf_dir, "clicks"), "client_id", "ts", "click_id", cents, F.col("kind") != "error", F.col("kind") == "click")
    times = lambda letter, n: F.repeat(F.lit(letter), F.col(n).cast("int"))
    labels = F.concat(F.lit("A"), times("D", "n_down"), times("U", "n_up"), F.lit("P"))
    return found.select(F.col("key").alias("client_id"), F.col("match_no").cast("long").alias("match_no"), F.col("first_row").alias("first_id"), F.col("last_row").alias("last_id"), "n_rows", F.col("total").alias("sum_cents"), F.sha2(labels, 256).alias("labels_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower)
    found = manifest(_table(spark, sf_dir, "documents"), "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": tampered})
    root = folded(F.coalesce("altered", "leaf"), F.col("path"))
    out = found.select(F.col("row").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(_table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict:
    own = (op1_deleted_interpolation, op2_isolation_rules, op3_classifier_chain, op4_piece_codec, op5_warc_derivatives, op6_huffman_ids, op7_trie_counts, op8_aho_decontaminate, op9_secret_forest, op10_minhash_tensor, op11_row_patterns, op12_merkle_manifest, op13_license_scan)
    return {f.__name__: f for f in own}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP8 = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM win), place AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n
), gram AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM place
), hit AS (SELECT doc_id, item_id, i, gram.n FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n
), words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words ON doc.doc_id = words.doc_id LEFT JOIN items ON doc.doc_id = items.doc_id
"""

_OP10 = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id, doc_id AS root FROM doc
  UNION
  SELECT way.y, reach.root FROM reach JOIN way ON way.x = reach.doc_id WHERE reach.root < way.y
), comp AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = doc.doc_id AS kept
FROM doc JOIN comp ON comp.doc_id = doc.doc_id LEFT JOIN size ON size.doc_id = doc.doc_id
"""


_OP11 = """
WITH numbered AS (
  SELECT client_id, click_id, ts, kind, CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents,
    row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS i
  FROM (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)
), near AS (
  SELECT *, ts <= lag(ts) OVER own + INTERVAL 5 MINUTE AS soon, lag(cents) OVER own AS before,
    sum(coalesce(cents, 0)) OVER (PARTITION BY client_id ORDER BY i) AS so_far, count(*) OVER (PARTITION BY client_id) AS n
  FROM numbered WINDOW own AS (PARTITION BY client_id ORDER BY i)
), letter AS (
  SELECT *, coalesce(soon AND kind <> 'error' AND cents < before, false) AS d, coalesce(soon AND kind <> 'error' AND cents > before, false) AS u,
    coalesce(soon AND kind = 'click' AND cents IS NOT NULL AND before IS NOT NULL, false) AS p
  FROM near
), run AS (
  SELECT *, coalesce(min(CASE WHEN NOT d THEN i END) OVER ahead, n + 1) AS d_end, coalesce(min(CASE WHEN NOT u THEN i END) OVER ahead, n + 1) AS u_end
  FROM letter WINDOW ahead AS (PARTITION BY client_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), found AS (
  SELECT a.client_id, a.i, any_value(fall.d_end) AS up_from, max(goal.i) AS last
  FROM run a JOIN run fall ON fall.client_id = a.client_id AND fall.i = a.i + 1 AND fall.d
  JOIN run rise ON rise.client_id = a.client_id AND rise.i = fall.d_end AND rise.u
  JOIN run goal ON goal.client_id = a.client_id AND goal.i BETWEEN rise.i + 1 AND rise.u_end AND goal.p AND goal.cents >= a.cents
  GROUP BY a.client_id, a.i
)
SELECT found.client_id, row_number() OVER (PARTITION BY found.client_id ORDER BY found.i) AS match_no, a.click_id AS first_id, z.click_id AS last_id,
  last - found.i + 1 AS n_rows, CAST(z.so_far - a.so_far + a.cents AS BIGINT) AS sum_cents,
  sha256('A' || repeat('D', CAST(up_from - 1 - found.i AS INT)) || repeat('U', CAST(last - up_from AS INT)) || 'P') AS labels_sha256
FROM found JOIN run a ON a.client_id = found.client_id AND a.i = found.i JOIN run z ON z.client_id = found.client_id AND z.i = last
"""


def oracle_sql() -> dict[str, str]:
    """What DuckDB can express: operators 8, 10 and 11. The others are held against brute force in tests/llm."""
    return {"op8_aho_decontaminate": _OP8, "op10_minhash_tensor": _OP10, "op11_row_patterns": _OP11}
