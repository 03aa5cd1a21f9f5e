"""Inputs of the named queries, derived from whole driver tables; each beside the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Two snapshots of the orders: in the new one 1/17 is gone, 1/13 of the rest has another price, and 1/29 came again under new keys.
OLD_ORDERS = "SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice AS p, o_orderpriority AS pr FROM orders"
NEW_ORDERS = """SELECT o_orderkey AS k, o_orderstatus AS st, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p, o_orderpriority AS pr
  FROM orders WHERE o_orderkey % 17 <> 0
  UNION ALL SELECT o_orderkey + 1000000, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 29 = 0"""


def order_snapshots(spark: SparkSession, sf_dir: str, branch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The old and the new orders; with ``branch``, a column of that name says which part of the SQL a row is from."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("p"), F.col("o_orderpriority").alias("pr"))
    changed = o.where("k % 17 <> 0").withColumn("p", F.expr("CASE WHEN k % 13 = 0 THEN p + 1 ELSE p END"))
    again = o.where("k % 29 = 0").withColumn("k", F.col("k") + 1000000)
    if branch is None:
        return o, changed.union(again)
    return o.withColumn(branch, F.lit(0)), changed.withColumn(branch, F.lit(0)).union(again.withColumn(branch, F.lit(1)))


#: Document files, and their hashes before and after: 1/11 is gone, 1/7 of the rest changed.
OLD_FILES = "SELECT 'docs/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, source, left(sha256(text), 16) AS hash, n_chars AS size, doc_id FROM documents"
NEW_FILES = "SELECT 'docs/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, source, left(sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END), 16) AS hash, n_chars AS size, doc_id FROM documents WHERE doc_id % 11 <> 0"


def _files(docs: DataFrame) -> DataFrame:
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), "source", F.left(F.sha2("text", 256), F.lit(16)).alias("hash"), F.col("n_chars").alias("size"), "doc_id")


def file_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    after = docs.where("doc_id % 11 <> 0").withColumn("text", F.expr("CASE WHEN doc_id % 7 = 0 THEN concat(text, 'x') ELSE text END"))
    return _files(docs), _files(after)


#: Sets of object hashes: held locally, held remotely, and needed.
LOCAL = f"SELECT DISTINCT hash FROM ({OLD_FILES}) WHERE doc_id % 2 = 0"
REMOTE = f"SELECT DISTINCT hash FROM ({OLD_FILES}) WHERE doc_id % 3 = 0"
NEEDED = f"SELECT DISTINCT hash FROM ({OLD_FILES}) WHERE doc_id % 5 = 0"


def hash_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    old, _ = file_snapshots(spark, sf_dir)
    return tuple(old.where(f"doc_id % {n} = 0").select("hash").distinct() for n in (2, 3, 5))


#: A pipeline with a stage for each part: stage k reads what stages k/2 and k/3 make, and makes data/k.csv.
PART_EDGES = """SELECT DISTINCT s, d FROM (
  SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS s, p_partkey AS d FROM part WHERE p_partkey >= 2
  UNION ALL SELECT CAST(floor(p_partkey / 3) AS BIGINT), p_partkey FROM part WHERE p_partkey >= 3)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, d) numbers of the maker and the reader."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("d"))
    by = lambda n: k.where(F.col("d") >= n).select(F.floor(F.col("d") / n).cast("bigint").alias("s"), "d")
    return by(2).union(by(3)).distinct()


def stage_name(k: str) -> F.Column:
    return F.concat(F.lit("stage_"), F.col(k).cast("string"))


def file_name(k: str) -> F.Column:
    return F.concat(F.lit("data/"), F.col(k).cast("string"), F.lit(".csv"))


def part_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's stages: name, deps and outs."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    read = part_edges(spark, sf_dir).groupBy(F.col("d").alias("k")).agg(F.array_sort(F.collect_list(file_name("s"))).alias("deps"))
    out = F.array(F.struct(file_name("k").alias("path"), F.lit("data").alias("kind"), F.lit(True).alias("cached"), F.lit(False).alias("incremental")))
    # A table that is small as a file can have too many keys to broadcast.
    return k.join(read.hint("merge"), "k", "left").select(stage_name("k").alias("name"), F.coalesce("deps", F.array().cast("array<string>")).alias("deps"), out.alias("outs"))


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges of the pipeline."""
    from weftline.operators.graph import build_edges

    return build_edges(part_stages(spark, sf_dir))


def stage_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) stage names of the pipeline."""
    return part_edges(spark, sf_dir).select(stage_name("s").alias("src"), stage_name("d").alias("dst"))


#: Stage states beside their locks, from the parts.
STAGE_STATE = """SELECT 'stage_' || p_partkey AS stage, p_brand AS code, CAST(p_size AS VARCHAR) AS params, p_type AS deps, p_name AS outs, p_partkey AS k FROM part"""
LOCK_STATE = """SELECT 'stage_' || p_partkey AS stage, CASE WHEN p_partkey % 11 = 0 THEN p_brand || 'x' ELSE p_brand END AS code,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) AS params, CASE WHEN p_partkey % 5 = 0 THEN p_type || 'x' ELSE p_type END AS deps,
  CASE WHEN p_partkey % 3 = 0 THEN p_name || 'x' ELSE p_name END AS outs, p_partkey AS k FROM part WHERE p_partkey % 13 <> 0"""


def stage_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("code"), F.col("p_size").alias("n"), F.col("p_type").alias("deps"), F.col("p_name").alias("outs"))
    now = part.select(stage_name("k").alias("stage"), "code", F.col("n").cast("string").alias("params"), "deps", "outs", "k")
    off = lambda c, n: F.when(F.col("k") % n == 0, F.concat(c, F.lit("x"))).otherwise(F.col(c)).alias(c)
    then = part.where("k % 13 <> 0").select(stage_name("k").alias("stage"), off("code", 11), F.expr("CASE WHEN k % 7 = 0 THEN n + 1 ELSE n END").cast("string").alias("params"), off("deps", 5), off("outs", 3), "k")
    return now, then
