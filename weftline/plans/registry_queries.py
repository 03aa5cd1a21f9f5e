"""Named queries over definitions, neighbours in the graph and records that no other query covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import diff, expand, graph, params, registry
from weftline.plans import inputs as I

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output of each part: a folder for each fifth, a metric for each third."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("/work/out/"), k.cast("string"), F.when(k % 5 == 0, "/").otherwise(""))
    kind = F.when(k % 3 == 0, "metric").otherwise("data")
    return I.table(spark, sf_dir, "part").select(F.concat(F.lit("stage_"), k.cast("string")).alias("stage"), F.col("p_brand").alias("name"), path.alias("path"), kind.alias("kind"), (k % 2 == 0).alias("cached"), k.alias("k"))


OUTS = """SELECT 'stage_' || p_partkey AS stage, p_brand AS name, '/work/out/' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '/' ELSE '' END AS path,
  CASE WHEN p_partkey % 3 = 0 THEN 'metric' ELSE 'data' END AS kind, p_partkey % 2 = 0 AS cached, p_partkey AS k FROM part"""


@query(f"""SELECT stage, name, CASE WHEN k % 7 = 0 THEN 'new/' || k ELSE path END AS path, kind, CASE WHEN k % 14 = 0 THEN false ELSE cached END AS cached,
  CASE WHEN k % 35 = 0 THEN 'a folder output needs a path that ends in /: new/' || k END AS problem FROM ({OUTS})""")
def output_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    outs = _outs(spark, sf_dir)
    new = F.concat(F.lit("new/"), F.col("k").cast("string")).alias("path")
    overrides = outs.where("k % 7 = 0").select("stage", "name", new, F.when(F.col("k") % 14 == 0, F.lit(False)).alias("cached"))
    return registry.overridden_outputs(outs.drop("k"), overrides)


@query(f"""WITH s AS (SELECT stage, CASE WHEN k % 11 = 0 THEN 'nobody' ELSE name END AS name, CASE WHEN k % 2 = 0 THEN 'metrics' ELSE 'outs' END AS section FROM ({OUTS})
  UNION ALL SELECT stage, name, 'outs' FROM ({OUTS}) WHERE k % 13 = 0),
  j AS (SELECT s.*, o.kind, count(*) OVER (PARTITION BY s.stage, s.name) AS times FROM s LEFT JOIN ({OUTS}) o ON s.stage = o.stage AND s.name = o.name)
  SELECT * FROM (SELECT stage, name, section, CASE WHEN kind IS NULL THEN 'unknown output' WHEN section = 'metrics' AND kind <> 'metric' THEN 'output of another kind' WHEN times > 1 THEN 'named in two sections' END AS problem FROM j) WHERE problem IS NOT NULL""")
def section_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    outs = _outs(spark, sf_dir)
    named = outs.select("stage", F.when(F.col("k") % 11 == 0, "nobody").otherwise(F.col("name")).alias("name"), F.when(F.col("k") % 2 == 0, "metrics").otherwise("outs").alias("section"))
    return registry.section_problems(named.union(outs.where("k % 13 = 0").select("stage", "name", F.lit("outs"))), outs)


@query(f"SELECT substr(path, 7) AS path, 'pipe_' || k % 9 AS pipeline FROM ({OUTS}) WHERE k % 4 <> 0")
def output_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    outs = _outs(spark, sf_dir)
    folders = outs.select("stage", F.when(F.col("k") % 4 != 0, F.concat(F.lit("pipe_"), (F.col("k") % 9).cast("string"))).alias("folder"))
    return registry.output_index(outs, folders, "/work")


@query("SELECT source || '/' || doc_id AS stage FROM documents WHERE doc_id % 3 = 0")
def pending_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents")
    suffix = F.when(F.col("doc_id") % 3 == 0, ".lock").otherwise(".txt")
    listing = docs.select(F.concat(F.lit("state/pending/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"))
    return registry.pending_stages(listing, "state/pending")


@query("""SELECT path, mtime_ns, size, inode, qualname, arg_max(hash, turn) AS hash FROM (
  SELECT source AS path, CAST(doc_id AS BIGINT) AS mtime_ns, CAST(n_chars AS BIGINT) AS size, CAST(0 AS BIGINT) AS inode, lang AS qualname, 'old' AS hash, 0 AS turn FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT source, doc_id, n_chars, 0, lang, 'new', 1 FROM documents WHERE doc_id % 3 = 0) GROUP BY path, mtime_ns, size, inode, qualname""")
def saved_syntax_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents")
    entries = lambda rows, name, key: rows.select(key.alias("path"), F.col("doc_id").cast("bigint").alias("mtime_ns"), F.col("n_chars").cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("inode"), F.col("lang").alias("qualname"), F.lit(name).alias("hash"))
    bad = entries(docs, "bad", F.repeat(F.col("source"), F.lit(200)))
    return registry.saved_syntax_hashes(entries(docs.where("doc_id % 2 = 0"), "old", F.col("source")), entries(docs.where("doc_id % 3 = 0"), "new", F.col("source")).union(bad))


@query(f"""SELECT 'stage_' || p_partkey AS name, '{{"name":"stage_' || p_partkey || '","deps":[' || coalesce(d.deps, '') || '],"outs":["data/' || p_partkey || '.csv"],"mutex":["m"]' || CASE WHEN p_partkey % 2 = 0 THEN ',"variant":"v"' ELSE '' END || '}}' AS json
  FROM part LEFT JOIN (SELECT d, string_agg('"data/' || s || '.csv"', ',' ORDER BY 'data/' || s || '.csv') AS deps FROM ({I.PART_EDGES}) GROUP BY d) d ON d.d = p_partkey""")
def stage_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = I.part_stages(spark, sf_dir)
    even = F.substring_index("name", "_", -1).cast("long") % 2 == 0
    return registry.stage_listing(stages.withColumn("mutex", F.array(F.lit("m"))).withColumn("variant", F.when(even, "v").otherwise("")))


@query("""SELECT event_type AS path, CAST(user_id AS VARCHAR) AS key, sum(value) AS value FROM events WHERE user_id % 3 = 1 GROUP BY 1, 2""")
def metrics_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    made = lambda rest, ordinal: e.where(F.col("user_id") % 3 == rest).groupBy(F.col("event_type").alias("path"), F.col("user_id").cast("string").alias("key")).agg(F.sum("value").alias("value")).select(F.lit(f"s{ordinal}").alias("stage"), F.lit(ordinal).alias("ordinal"), "path", "key", "value")
    return registry.metrics_by_path(made(0, 1).union(made(1, 2)))


@query("""SELECT doc_id, kind, valid, CASE WHEN valid THEN full_path END AS path,
    CASE WHEN NOT valid THEN kind || CASE WHEN given LIKE '%..%' THEN ' path contains path traversal (..)' ELSE ' path ''' || given || ''' resolves outside base directory' END END AS error,
    CASE WHEN valid AND NOT inside THEN 'Absolute ' || kind || ' path may break reproducibility: ' || given END AS warning
  FROM (SELECT *, given NOT LIKE '%..%' AND (inside OR kind = 'dependency') AS valid FROM (
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'dependency' ELSE 'output' END AS kind,
      CASE doc_id % 4 WHEN 0 THEN 'a//b/' || doc_id WHEN 1 THEN '/abs/' || doc_id WHEN 2 THEN '/abs/' || doc_id ELSE CASE WHEN doc_id % 3 = 0 THEN '../up' ELSE './x/' || doc_id END END AS given,
      CASE doc_id % 4 WHEN 0 THEN '/work/a/b/' || doc_id WHEN 1 THEN '/abs/' || doc_id WHEN 2 THEN '/abs/' || doc_id ELSE '/work/x/' || doc_id END AS full_path, doc_id % 4 NOT IN (1, 2) AS inside FROM documents))""")
def path_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    rest = F.col("doc_id") % 4
    given = F.when(rest == 0, F.concat(F.lit("a//b/"), n)).when(rest.isin(1, 2), F.concat(F.lit("/abs/"), n)).when(F.col("doc_id") % 3 == 0, "../up").otherwise(F.concat(F.lit("./x/"), n))
    kind = F.when(F.col("doc_id") % 2 == 0, "dependency").otherwise("output")
    docs = I.table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), given.alias("given"))
    return docs.select("doc_id", "kind", S.path_policy(F.col("given"), F.col("kind"), "/work").alias("p")).select("doc_id", "kind", "p.*")


@query("""SELECT name, count(*) AS n, CAST(round(sum(duration_ms), 3) AS DOUBLE) AS total FROM (
  SELECT event_type AS name, CAST(value AS DOUBLE) AS duration_ms FROM events UNION ALL SELECT event_type, 0.0 FROM events) GROUP BY name""")
def merged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    samples = e.select(F.col("event_type").alias("name"), F.col("value").cast("double").alias("duration_ms"))
    merged = registry.with_entries(samples, registry.counted(e.select(F.col("event_type").alias("name"))))
    return merged.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_ms"), 3).alias("total"))


@query(f"SELECT 'stage_' || d AS stage FROM ({I.PART_EDGES}) WHERE s = 3")
def artifact_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.consumers(I.part_graph(spark, sf_dir), "data/3.csv")


@query("SELECT 'stage_3' AS stage")
def artifact_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.producer(I.part_graph(spark, sf_dir), "data/3.csv")


@query(f"SELECT 'stage_' || s AS stage FROM ({I.PART_EDGES}) WHERE d = 60")
def upstream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.upstream_once(I.part_graph(spark, sf_dir), "stage_60")


@query(f"SELECT 'stage_' || p_partkey AS stage, 'lost/' || p_partkey || '.csv' AS path FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 1")
def unresolved_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring_index("name", "_", -1)
    lost = F.when(k.cast("long") % 3 == 0, F.array_append("deps", F.concat(F.lit("lost/"), k, F.lit(".csv")))).otherwise(F.col("deps"))
    stages = I.part_stages(spark, sf_dir).withColumn("deps", lost)
    tracked = I.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("lost/"), F.col("p_partkey").cast("string"), F.lit(".csv")).alias("path"))
    return graph.unresolved_deps(stages, tracked)


@query("""SELECT p_brand AS name, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 2 = 0) THEN 'sub/' || p_brand || '_3' ELSE 'sub/' || p_brand END AS new_name FROM part GROUP BY p_brand""")
def included_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = I.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_brand").alias("name")).distinct()
    taken = own.union(own.select(F.concat(F.lit("sub/"), "name"))).union(own.select(F.concat(F.lit("sub/"), "name", F.lit("_2")))).union(own.select(F.concat(F.lit("sub/"), "name", F.lit("_4"))))
    return graph.include_pipeline(taken, I.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct(), "sub")


@query("""SELECT event_id, 'a' AS key, '{"k":' || user_id || '}' AS value FROM events UNION ALL SELECT event_id, 'b', '{' || event_type FROM events
  UNION ALL SELECT event_id, 'c.d', event_type FROM events UNION ALL SELECT event_id, 'c.e', '[1,2]' FROM events""")
def metric_flatten_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.format_string('{"a": "{\\"k\\":%d}", "b": "{%s", "c": {"d": "%s", "e": [1,2]}}', "user_id", "event_type", "event_type")
    return expand.flattened_json(I.table(spark, sf_dir, "events").select("event_id", quoted.alias("text")))


@query("SELECT c_name AS stage, c_mktsegment AS params FROM customer WHERE c_custkey % 3 = 1")
def params_at_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.table(spark, sf_dir, "customer")
    snapshot = F.when(F.col("c_custkey") % 3 == 2, "other").otherwise("HEAD").alias("snapshot")
    return params.params_at(c.select(snapshot, F.col("c_name").alias("stage"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise("{}").alias("params")), "HEAD")[0]


@query("""SELECT 'stage_' || k AS stage, 'in_' || k AS path, CASE WHEN k % 5 <> 0 THEN 'h' || k END AS old_hash, CASE WHEN k % 7 <> 0 THEN 'h' || k END AS new_hash,
    CASE WHEN k % 5 = 0 THEN 'added' WHEN k % 7 = 0 THEN 'removed' ELSE 'modified' END AS change_type
  FROM (SELECT p_partkey AS k FROM part) WHERE NOT (k % 5 = 0 AND k % 7 = 0) AND (k % 5 = 0 OR k % 7 = 0 OR k % 3 = 0)""")
def dependency_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = I.table(spark, sf_dir, "part")
    name = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    record = lambda rows, mark: rows.select(name("stage_").alias("stage"), name("in_").alias("path"), name("h").alias("hash"), F.when(k % 3 == 0, F.array(F.lit(mark))).alias("manifest"))
    return diff.diff_deps(record(part.where("p_partkey % 5 <> 0"), "old"), record(part.where("p_partkey % 7 <> 0"), "new"))


@query("SELECT 'm' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_type END AS content FROM part")
def metric_values_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = I.table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("path"), F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("hash"), "p_name", "p_type", F.col("p_partkey").alias("k"))
    return diff.metric_values_at(part.select("path", "hash"), part.where("k % 2 = 0").select("hash", F.col("p_name").alias("content")), part.where("k % 3 = 0").select("path", F.col("p_type").alias("content")))


@query("SELECT p_brand AS stage, leaf, n, 'b.' || leaf AS winner FROM (SELECT p_brand, CAST(p_size AS VARCHAR) AS leaf, CAST(2 AS BIGINT) AS n FROM part GROUP BY p_brand, p_size)")
def colliding_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part").select(F.col("p_brand").alias("stage"), F.col("p_size").cast("string").alias("leaf")).distinct()
    keys = lambda prefix, ordinal: p.select("stage", F.concat(F.lit(prefix), "leaf").alias("key"), F.lit(ordinal).alias("ordinal"))
    return expand.colliding_leaves(keys("a.", 0).union(keys("b.", 1)))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS value, CASE WHEN p_partkey % 2 = 0 THEN 'global' ELSE 'default' END AS source FROM part""")
def layered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part")
    layer = lambda rows, value, name, priority: rows.select(F.col("p_partkey").cast("string").alias("key"), F.col(value).alias("value"), F.lit(name).alias("source"), F.lit(priority).alias("priority"))
    return expand.layered_value(layer(p, "p_brand", "default", 0).union(layer(p.where("p_partkey % 2 = 0"), "p_type", "global", 1)))


@query("SELECT p_brand AS stage, p_type AS path FROM part UNION ALL SELECT p_brand, p_name FROM part UNION ALL SELECT p_brand, p_brand FROM part")
def flattened_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.array(F.array("p_type", "p_name"), F.array("p_brand"))
    return expand.flattened_lists(I.table(spark, sf_dir, "part").select(F.col("p_brand").alias("stage"), nested.alias("deps")), "deps")


@query("SELECT bool_or(p_size = 50) AS fallback FROM part")
def needs_full_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.needs_full_definitions(I.table(spark, sf_dir, "part").select(F.col("p_name").alias("stage"), F.lit("mapping").alias("kind"), (F.col("p_size") == 50).alias("has_variants")))


@query("SELECT 'd' || p_partkey AS dimension, 0 AS ordinal, p_brand AS value FROM part UNION ALL SELECT 'd' || p_partkey, 1, p_name FROM part")
def dimension_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.when(F.col("p_partkey") % 2 == 0, F.format_string('["%s", "%s"]', "p_brand", "p_name")).otherwise(F.format_string('{"%s": {"x": 1}, "%s": null}', "p_brand", "p_name"))
    return registry.dimension_keys(I.table(spark, sf_dir, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("dimension"), spec.alias("spec")))
