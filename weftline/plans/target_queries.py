"""Named queries over targets, lookups and tables that are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import cache, expand, graph, history, staleness, targets, text
from weftline.plans import diff_queries
from weftline.plans import inputs as I
from weftline.functions import scalars as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


MIXED = "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'stage_' || p_partkey WHEN 1 THEN 'data/' || p_partkey || '.csv' WHEN 2 THEN 'none_' || p_partkey ELSE '  ' END AS target FROM part"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('stage_', p_partkey) WHEN 1 THEN concat('data/', p_partkey, '.csv') WHEN 2 THEN concat('none_', p_partkey) ELSE '  ' END")
    return I.table(spark, sf_dir, "part").select(t.alias("target"))


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "part").select(I.stage_name("p_partkey").alias("stage"))


@query(f"""SELECT target, CASE k % 4 WHEN 0 THEN CASE WHEN k % 8 = 0 THEN 'both' ELSE 'stage' END WHEN 1 THEN 'file' ELSE 'neither' END AS kind, k % 4 = 0 AS is_stage FROM ({MIXED}) WHERE trim(target) <> ''""")
def classify_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = I.table(spark, sf_dir, "part")
    files = part.select(I.file_name("p_partkey").alias("path")).union(part.where("p_partkey % 8 = 0").select(I.stage_name("p_partkey")))
    return targets.classify_targets(_mixed(spark, sf_dir), _stages(spark, sf_dir), files)


@query(f"SELECT target, CASE k % 4 WHEN 0 THEN 'stage' WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'tracked' ELSE 'file' END END AS source FROM ({MIXED}) WHERE trim(target) <> ''")
def restore_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = I.table(spark, sf_dir, "part").select(I.file_name("p_partkey").alias("path"), "p_partkey")
    return targets.restore_targets(targets.usable_targets(_mixed(spark, sf_dir)), _stages(spark, sf_dir), files.where("p_partkey % 3 = 0"), files)


def _params(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = I.table(spark, sf_dir, "part")
    nothing = F.create_map().cast("map<string,string>")
    own = part.where("p_partkey % 3 <> 0").select(I.stage_name("p_partkey").alias("stage"), F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("brand"), "p_brand")).otherwise(nothing).alias("params"))
    return targets.collect_params(part.select(I.stage_name("p_partkey").alias("stage")), own)


@query("SELECT 'stage_' || p_partkey AS stage, 'brand' AS key, p_brand AS value FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0")
def collect_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _params(spark, sf_dir)[0]


@query("SELECT 'stage_' || p_partkey AS stage FROM part WHERE p_partkey % 3 = 0")
def unknown_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _params(spark, sf_dir)[1]


KINDS = "SELECT 'stage_' || p_size AS stage, 'data/' || p_partkey || '.csv' AS path, CASE p_partkey % 3 WHEN 0 THEN 'metric' WHEN 1 THEN 'plot' ELSE 'data' END AS kind, p_partkey AS ordinal FROM part"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "part").select(I.stage_name("p_size").alias("stage"), I.file_name("p_partkey").alias("path"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'metric' WHEN 1 THEN 'plot' ELSE 'data' END").alias("kind"), F.col("p_partkey").alias("ordinal"))


@query(f"""WITH t AS (SELECT DISTINCT 'stage_' || p_size AS target FROM part WHERE p_size < 9 UNION SELECT 'data/' || p_partkey || '.csv' FROM part)
  SELECT t.target, o.path FROM t JOIN ({KINDS}) o ON (t.target = o.stage OR t.target = o.path) AND o.kind = 'plot'""")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = I.table(spark, sf_dir, "part")
    wanted = part.where("p_size < 9").select(I.stage_name("p_size").alias("target")).distinct().union(part.select(I.file_name("p_partkey")))
    return targets.output_paths(wanted, _kinds(spark, sf_dir), "plot")


@query(f"SELECT stage, arg_max(path, ordinal) AS path FROM ({KINDS}) WHERE kind = 'data' GROUP BY stage")
def data_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.data_outputs(_kinds(spark, sf_dir))


@query(f"SELECT path, arg_max(stage, ordinal) AS stage FROM (SELECT 'out_' || ordinal % 100 AS path, stage, ordinal FROM ({KINDS})) GROUP BY path")
def output_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    outs = _kinds(spark, sf_dir).withColumn("path", F.concat(F.lit("out_"), (F.col("ordinal") % 100).cast("string")))
    return graph.output_sources(outs)


@query(f"""SELECT o.path, coalesce(CASE WHEN o.doc_id % 2 = 0 THEN o.hash END, CASE WHEN o.doc_id % 3 = 0 THEN 't' || o.hash END) AS hash FROM ({I.OLD_FILES}) o""")
def file_hash_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    outs = old.where("doc_id % 2 = 0").select("path", "hash", F.lit("a").alias("stage")).union(old.where("doc_id % 2 = 0").select("path", F.lit("later"), F.lit("b")))
    return cache.file_hash_lookup(old.select("path"), outs, old.where("doc_id % 3 = 0").select("path", F.concat(F.lit("t"), "hash").alias("hash")))


@query(f"SELECT DISTINCT hash FROM ({I.OLD_FILES}) WHERE source IN ('src1', 'src2') OR (source = 'src3' AND doc_id % 2 = 0) OR (source NOT IN ('src1', 'src2', 'src3') AND doc_id % 3 = 0)")
def target_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    none = F.lit(None).cast("array<struct<relpath:string,hash:string,size:bigint,isexec:boolean>>").alias("manifest")
    outs = old.where("source <> 'src3'").select(F.when(~F.col("source").isin("src1", "src2"), "other").otherwise(F.col("source")).alias("stage"), "path", "hash", F.lit(True).alias("cached"), none)
    tracked = old.where("source = 'src3'").select("path", "hash", none)
    wanted = old.where("source in ('src1', 'src2')").select(F.col("source").alias("target")).distinct()
    wanted = wanted.union(old.where("(source = 'src3' and doc_id % 2 = 0) or (source not in ('src1', 'src2', 'src3') and doc_id % 3 = 0)").select("path"))
    return cache.target_hashes(wanted, outs, tracked)


@query(f"SELECT path, hash FROM ({I.OLD_FILES}) ")
def tracked_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    single = old.where("doc_id % 2 = 0").select("path", "hash", F.lit(None).cast("array<struct<relpath:string,hash:string>>").alias("manifest"))
    inside = F.regexp_replace("path", "^docs/[^/]*/", "")
    folder = old.where("doc_id % 2 = 1").groupBy("source").agg(F.collect_list(F.struct(inside.alias("relpath"), "hash")).alias("manifest")).select(F.concat(F.lit("docs/"), "source", F.lit("/")).alias("path"), F.lit("f").alias("hash"), "manifest")
    return staleness.tracked_hash(old.select("path"), single.union(folder))


@query(f"SELECT source AS path, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files FROM ({I.OLD_FILES}) GROUP BY source")
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    folders = old.groupBy(F.col("source").alias("path")).agg(F.collect_list(F.struct("path", "hash", "size")).alias("manifest")).withColumn("size", F.lit(0).cast("bigint"))
    return cache.folder_sizes(folders).withColumn("n_files", F.col("n_files").cast("bigint"))


@query("SELECT 'data/' || p_size AS path, arg_min('./data//' || p_size || '/x' || p_partkey || '/..', p_partkey) AS target FROM part GROUP BY p_size")
def deduped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.concat(F.lit("./data//"), F.col("p_size").cast("string"), F.lit("/x"), F.col("p_partkey").cast("string"), F.lit("/.."))
    given = I.table(spark, sf_dir, "part").select(target.alias("target"), F.col("p_partkey").alias("position"))
    return cache.deduped_targets(given, S.canonical_path(F.col("target")))


@query("SELECT n_name AS stage, row_number() OVER (ORDER BY n_name) AS index, count(*) OVER () AS total FROM nation")
def stage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.indexed(I.table(spark, sf_dir, "nation").select(F.col("n_name").alias("stage")), "stage").withColumn("index", F.col("index").cast("bigint"))


@query("SELECT event_type AS path, CAST(user_id AS VARCHAR) AS key, printf('%.2f', sum(value)) AS shown FROM events GROUP BY 1, 2")
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = I.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("path"), F.col("user_id").cast("string").alias("key")).agg(F.sum("value").alias("value"))
    return text.metric_table(sums, 2)


@query(f"SELECT path, key, CAST(old AS VARCHAR) AS old, CAST(new AS VARCHAR) AS new, change_type FROM ({diff_queries.SQL['metric_diff']})")
def change_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.change_table(diff_queries.metric_diff(spark, sf_dir), ["path", "key"])


@query(f"SELECT CASE change_type WHEN 'added' THEN '+' WHEN 'removed' THEN '-' ELSE '~' END AS sign, path, old_hash, new_hash, change_type FROM ({diff_queries.HASHES})")
def signed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.signed_changes(diff_queries.diff_hashes(spark, sf_dir))


@query("SELECT count(*) AS n_stages, (SELECT count(*) FROM events WHERE event_type = 'click') AS n_warnings, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors FROM part")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = I.table(spark, sf_dir, "events").select(F.expr("CASE event_type WHEN 'click' THEN 'warning' ELSE event_type END").alias("severity"))
    return history.import_counts(_stages(spark, sf_dir), notes)


@query(f"""SELECT path, arg_min(stage, rank) AS stage, arg_min(pipeline, rank) AS pipeline, CAST(min(tier) AS INTEGER) AS tier FROM (
  SELECT path, 'own_' || doc_id AS stage, 'docs/' || source AS pipeline, 1 AS tier, 0 AS rank FROM ({I.OLD_FILES}) WHERE doc_id % 2 = 0
  UNION ALL SELECT path, 'far_' || doc_id, 'elsewhere', 3, 2 FROM ({I.OLD_FILES}) UNION ALL SELECT path, 'index_' || doc_id, 'index', 2, 1 FROM ({I.OLD_FILES}) WHERE doc_id % 3 = 0) GROUP BY path""")
def external_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    made = lambda rows, name, pipeline, tier: rows.select("path", F.concat(F.lit(name), F.col("doc_id").cast("string")).alias("stage"), pipeline.alias("pipeline"), F.lit(tier).alias("tier"))
    outputs = made(old.where("doc_id % 2 = 0"), "own_", F.concat(F.lit("docs/"), "source"), 3).union(made(old, "far_", F.lit("elsewhere"), 3)).union(made(old.where("doc_id % 3 = 0"), "index_", F.lit("index"), 2))
    return graph.external_producers(old.select("path"), outputs)


@query("""SELECT p_partkey AS name, 'run ' || p_size || CASE WHEN p_size = 1 THEN ' stale stage' ELSE ' stale stages' END AS suggestion FROM part WHERE p_size > 0
  UNION ALL SELECT p_partkey, 'push ' || p_partkey % 3 || CASE WHEN p_partkey % 3 = 1 THEN ' object' ELSE ' objects' END FROM part WHERE p_partkey % 3 > 0""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = S.suggestions(F.col("p_size"), F.lit(0), (F.col("p_partkey") % 3).cast("int"), F.lit(0))
    return I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.explode(given).alias("suggestion"))


@query("SELECT c_mktsegment AS name, c_name AS item, c_mktsegment || '@' || c_name AS stage FROM customer")
def foreach_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_name").alias("item"))
    return expand.foreach_stages(c.select("name").distinct(), c)
