"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe_automaton, embedding_dedup, near_dup, packing, quality, secret_scan, sharding, syncmers, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: fixed formats, and literals that reach sensitive names."""
    return secret_scan.secret_digests(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimax contiguous shards of all documents by text hash order, equal bytes."""
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents", "doc_id", "text"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 ids with their BM25 neighbours."""
    return packing.pack_documents(_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five words a shingle, similarity 0.75 or more."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the merge automaton and decoded again."""
    return bpe_automaton.round_trip_digests(_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as frequency-ranked token files and read back."""
    files = token_files.write_token_files(_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, files)


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of all documents, their edited texts and their successors."""
    return syncmers.edited_fingerprints(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at a cosine of 0.95 or more."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that may be learned from."""
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from weak labels alone."""
    return quality.quality_scores(_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_near_dup": op4_near_dup,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_token_files": op6_token_files,
    "op7_syncmers": op7_syncmers,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

#: Every pair that shares a shingle, by an inverted index; then the smallest id reachable.
NEAR_DUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT a AS doc_id, b AS other FROM pairs
  UNION SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON r.other = p.a
), components AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(c.low, s.doc_id)) AS kept
FROM sets s LEFT JOIN components c ON s.doc_id = c.doc_id
"""

#: All pairs of usable vectors of equal dimension.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
usable AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n
), reach AS (SELECT a AS vec_id, b AS other FROM pairs UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON r.other = p.a),
components AS (SELECT vec_id, min(other) AS low FROM reach GROUP BY vec_id),
degrees AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) AS kept
FROM v LEFT JOIN degrees d ON v.vec_id = d.vec_id LEFT JOIN components c ON v.vec_id = c.vec_id
"""

ORACLE_SQL: dict[str, str] = {
    "op8_embedding_dedup": EMBEDDING_SQL,
    "op4_near_dup": NEAR_DUP_SQL,
}
