"""Named queries over the pipeline graph, staleness and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import expand, graph, staleness
from weftline.plans import inputs as I
from weftline.streaming import events as E

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


LINKS = f"SELECT 'stage_' || s AS src, 'stage_' || d AS dst FROM ({I.PART_EDGES})"
CLOSURE = f"""WITH RECURSIVE e AS ({LINKS}), reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)"""
LEVELS = f"""WITH RECURSIVE e AS ({LINKS}), walk AS (
  SELECT 'stage_' || p_partkey AS stage, 0 AS level FROM part
  UNION SELECT e.dst, w.level + 1 FROM walk w JOIN e ON w.stage = e.src), placed AS (SELECT stage, max(level) AS level FROM walk GROUP BY stage)"""


@query(LINKS)
def graph_edges_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stage_edges(I.part_graph(spark, sf_dir))


@query(f"SELECT 'data/' || s || '.csv' AS src, 'data/' || d || '.csv' AS dst FROM ({I.PART_EDGES})")
def graph_edges_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.artifact_edges(I.part_graph(spark, sf_dir))


@query(f"""SELECT 'stage_' || p_partkey AS src, 'stage' AS src_type, 'data/' || p_partkey || '.csv' AS dst, 'artifact' AS dst_type FROM part
  UNION ALL SELECT 'data/' || s || '.csv', 'artifact', 'stage_' || d, 'stage' FROM ({I.PART_EDGES})""")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.part_graph(spark, sf_dir)


@query(f"{CLOSURE} SELECT src, dst FROM reach")
def graph_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.downstream(I.part_graph(spark, sf_dir))


TARGETS = "SELECT 'stage_' || p_partkey AS stage FROM part WHERE p_size = 50"


@query(f"{CLOSURE} SELECT stage FROM ({TARGETS}) UNION SELECT src FROM reach WHERE dst IN ({TARGETS})")
def graph_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = I.table(spark, sf_dir, "part").where("p_size = 50").select(I.stage_name("p_partkey").alias("stage"))
    return graph.upstream_closure(I.part_graph(spark, sf_dir), targets)


PATHS = "SELECT 'data/' || p_partkey || '.csv' AS path FROM part WHERE p_brand = 'Brand#11'"
AFFECTED = f"""{CLOSURE}, direct AS (SELECT p.path, 'stage_' || d AS stage FROM ({PATHS}) p JOIN ({I.PART_EDGES}) x ON p.path = 'data/' || x.s || '.csv')
  SELECT path, stage FROM direct UNION SELECT d.path, r.dst FROM direct d JOIN reach r ON d.stage = r.src"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select(I.file_name("p_partkey").alias("path"))


@query(AFFECTED)
def graph_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.affected_stages(I.part_graph(spark, sf_dir), _paths(spark, sf_dir))


@query(f"SELECT DISTINCT stage FROM ({AFFECTED})")
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staleness.what_if_changed(I.part_graph(spark, sf_dir), _paths(spark, sf_dir))


@query(f"{LEVELS} SELECT stage, level FROM placed")
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(I.part_stages(spark, sf_dir).select(F.col("name").alias("stage")), I.part_graph(spark, sf_dir))


@query(f"{LEVELS} SELECT stage, level, row_number() OVER (ORDER BY level, stage) - 1 AS position FROM placed")
def execution_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.execution_order(I.part_stages(spark, sf_dir).select(F.col("name").alias("stage")), I.part_graph(spark, sf_dir))


@query(f"""{LEVELS}, named AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'base_' || p_size || '@' || p_partkey ELSE stage END AS stage, level FROM placed JOIN part ON stage = 'stage_' || p_partkey),
  split AS (SELECT stage, level, split_part(stage, '@', 1) AS base, CASE WHEN strpos(stage, '@') > 0 THEN substr(stage, strpos(stage, '@') + 1) ELSE '' END AS variant FROM named)
  SELECT *, min(level) OVER (PARTITION BY base) AS base_level FROM split""")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = I.table(spark, sf_dir, "part").select(I.stage_name("p_partkey").alias("stage"), "p_partkey", "p_size")
    name = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('base_', p_size, '@', p_partkey) ELSE stage END")
    return graph.display_order(dag_levels(spark, sf_dir).join(part.hint("merge"), "stage").select(name.alias("stage"), "level"))


BACK = f"SELECT src, dst FROM ({LINKS}) UNION SELECT 'stage_' || max(p_partkey), 'stage_1' FROM part"


@query(f"WITH RECURSIVE e AS ({BACK}), reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src) SELECT src AS stage FROM reach WHERE src = dst")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = I.table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("k"))
    made = top.select(I.file_name("k").alias("src"), F.lit("artifact").alias("src_type"), F.lit("stage_1").alias("dst"), F.lit("stage").alias("dst_type"))
    return graph.cycles(I.part_graph(spark, sf_dir).union(made))


OUTS = f"SELECT 's_' || doc_id AS stage, path FROM ({I.OLD_FILES}) UNION ALL SELECT DISTINCT 'dir_' || source, 'docs/' || source FROM documents UNION ALL SELECT DISTINCT 'copy_' || source, 'docs/' || source FROM documents"


def _outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    folder = lambda name: old.select(F.concat(F.lit(name), "source").alias("stage"), F.concat(F.lit("docs/"), "source").alias("path")).distinct()
    return old.select(F.concat(F.lit("s_"), F.col("doc_id").cast("string")).alias("stage"), "path").union(folder("dir_")).union(folder("copy_"))


@query(f"""SELECT a.stage AS stage_a, a.path AS path_a, b.stage AS stage_b, b.path AS path_b, 'duplicate' AS kind FROM ({OUTS}) a JOIN ({OUTS}) b ON a.path = b.path AND a.stage < b.stage
  UNION ALL SELECT a.stage, a.path, b.stage, b.path, 'parent' FROM ({OUTS}) a JOIN ({OUTS}) b ON starts_with(b.path, a.path || '/')""")
def output_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.output_overlaps(_outs(spark, sf_dir))


@query(f"""WITH o AS (SELECT 's_' || doc_id AS producer, path AS artifact FROM ({I.OLD_FILES})),
  d AS (SELECT DISTINCT 'read_' || source AS stage, 'docs/' || source AS dep FROM documents UNION SELECT 'use_' || doc_id, path || '/part' FROM ({I.OLD_FILES}) UNION SELECT 'one_' || doc_id, path FROM ({I.OLD_FILES}))
  SELECT d.stage, d.dep, o.producer, o.artifact FROM d JOIN o ON o.artifact = d.dep OR starts_with(o.artifact, d.dep || '/') OR starts_with(d.dep, o.artifact || '/')""")
def dep_prefix_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    named = lambda prefix, path: old.select(F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("stage"), path.alias("path"))
    deps = old.select(F.concat(F.lit("read_"), "source").alias("stage"), F.concat(F.lit("docs/"), "source").alias("path")).distinct()
    deps = deps.union(named("use_", F.concat("path", F.lit("/part")))).union(named("one_", F.col("path")))
    return graph.producers_of(deps, named("s_", F.col("path")))


@query(f"SELECT DISTINCT 'docs/' || source || '/' || lang AS path FROM documents WHERE doc_id % 3 = 0 UNION SELECT path FROM ({I.OLD_FILES}) WHERE doc_id % 3 = 0")
def covered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    folders = old.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"))
    return graph.covered_paths(old.select("path").union(folders), old.where("doc_id % 3 = 0"))


def _halved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = I.part_graph(spark, sf_dir)
    return old, old.where(~F.col("src").isin("stage_5", "data/5.csv") & ~F.col("dst").isin("stage_5", "data/5.csv"))


@query("SELECT 'data/5.csv' AS path")
def orphan_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphan_artifacts(*_halved(spark, sf_dir))


@query(f"""SELECT src, src_type, dst, dst_type, 'removed' AS change_type FROM ({SQL['graph_build']}) WHERE src IN ('stage_5', 'data/5.csv') OR dst IN ('stage_5', 'data/5.csv')""")
def edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_changes(*_halved(spark, sf_dir))


@query("SELECT 'data/' || p_partkey || '.csv' AS path FROM part")
def watch_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.watch_paths(I.part_graph(spark, sf_dir))


@query("""SELECT t AS target, CASE WHEN p_partkey % 3 < 2 THEN 'stage_' || p_partkey END AS stage
  FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'stage_' || p_partkey WHEN 1 THEN 'data/' || p_partkey || '.csv' ELSE 'none_' || p_partkey END AS t FROM part)""")
def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part")
    t = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('stage_', p_partkey) WHEN 1 THEN concat('data/', p_partkey, '.csv') ELSE concat('none_', p_partkey) END")
    return graph.resolve_targets(p.select(t.alias("target")), I.part_stages(spark, sf_dir).select(F.col("name").alias("stage")), I.part_graph(spark, sf_dir))


@query(f"SELECT path, 'docs/' || source AS config_dir, CAST(2 AS INTEGER) AS distance FROM ({I.OLD_FILES})")
def nearest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    return graph.nearest_config(old.select("path"), old.select(F.concat(F.lit("docs/"), "source").alias("config_dir")).distinct())


@query(f"SELECT 'stage_' || p_partkey AS stage FROM part WHERE 'stage_' || p_partkey NOT IN (SELECT dst FROM ({LINKS}))")
def ready_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ready_stages(I.part_stages(spark, sf_dir).select(F.col("name").alias("stage")), I.part_graph(spark, sf_dir))


@query(f"SELECT 'flowchart TD' || chr(10) || string_agg('    ' || src || ' --> ' || dst, chr(10) ORDER BY src || ' --> ' || dst) AS text FROM ({LINKS})")
def mermaid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topological_text(I.part_graph(spark, sf_dir))


@query(f"SELECT 'digraph {{' || chr(10) || string_agg('    ' || src || ' -> ' || dst, chr(10) ORDER BY src || ' -> ' || dst) || chr(10) || '}}' AS text FROM ({LINKS})")
def dot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topological_text(I.part_graph(spark, sf_dir), "dot")


STALE = f"""{CLOSURE}, seeds AS (SELECT 'stage_' || p_partkey AS stage FROM part WHERE p_brand = 'Brand#17'),
  touched AS (SELECT stage FROM seeds UNION SELECT dst FROM reach WHERE src IN (SELECT stage FROM seeds)),
  makers AS (SELECT dst AS stage, string_agg(src, ',' ORDER BY src) AS upstream FROM e WHERE src IN (SELECT stage FROM touched) GROUP BY dst)
  SELECT 'stage_' || p_partkey AS stage, 'stage_' || p_partkey IN (SELECT stage FROM touched) AS stale, p_brand = 'Brand#17' AS own, coalesce(m.upstream, '') AS upstream
  FROM part LEFT JOIN makers m ON m.stage = 'stage_' || p_partkey"""


@query(STALE)
def stale_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = I.table(spark, sf_dir, "part").select(I.stage_name("p_partkey").alias("stage"), (F.col("p_brand") == "Brand#17").alias("stale"))
    return staleness.propagate_stale(own, I.stage_links(spark, sf_dir))


@query(f"""SELECT s.stage, s.stale AS would_run, CASE WHEN s.own THEN 'Code changed' WHEN s.stale THEN 'Upstream stale: ' || s.upstream ELSE 'unchanged' END AS reason FROM ({STALE}) s""")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = stale_propagation(spark, sf_dir)
    return staleness.dry_run(status, status.select("stage", F.when(F.col("own"), "Code changed").alias("reason")))


REASONS = f"""SELECT n.stage, CASE WHEN o.stage IS NULL THEN 'No previous run' WHEN n.code <> o.code THEN 'Code changed' WHEN n.params <> o.params THEN 'Params changed'
  WHEN n.deps <> o.deps THEN 'Input dependencies changed' WHEN n.outs <> o.outs THEN 'Output paths changed' END AS reason FROM ({I.STAGE_STATE}) n LEFT JOIN ({I.LOCK_STATE}) o ON n.stage = o.stage"""


@query(REASONS)
def lock_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staleness.lock_reason(*I.stage_states(spark, sf_dir))


@query("""SELECT stage, reason IS NOT NULL AS will_run, coalesce(reason = 'forced', false) AS is_forced, reason FROM (SELECT 'stage_' || k AS stage, CASE WHEN k % 13 = 0 THEN 'No previous run' WHEN k % 11 = 0 THEN 'Invalid params'
  WHEN k % 2 = 0 AND k % 17 <> 0 THEN NULL WHEN k % 9 = 0 THEN 'Missing dependencies' WHEN k % 10 = 5 THEN 'Unreadable dependencies' WHEN k % 7 = 0 THEN 'Code changed'
  WHEN k % 5 = 0 THEN 'Params changed' WHEN k % 3 = 0 THEN 'Input dependencies changed' WHEN k % 17 = 0 THEN 'forced' END AS reason FROM (SELECT p_partkey AS k FROM part))""")
def explain_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    flags = I.table(spark, sf_dir, "part").select(
        I.stage_name("p_partkey").alias("stage"),
        (k % 13 != 0).alias("locked"),
        (k % 11 != 0).alias("params_valid"),
        (k % 2 == 0).alias("generation_same"),
        (k % 9 == 0).cast("int").alias("n_missing"),
        (k % 10 == 5).cast("int").alias("n_unreadable"),
        (k % 7 == 0).alias("code_changed"),
        (k % 5 == 0).alias("params_changed"),
        (k % 3 == 0).alias("deps_changed"),
        (k % 17 == 0).alias("forced"),
    )
    return staleness.explain(flags).withColumn("is_forced", F.coalesce("is_forced", F.lit(False)))


@query(f"""{CLOSURE}, failed AS (SELECT 'stage_' || p_partkey AS stage FROM part WHERE p_brand = 'Brand#8'), below AS (SELECT DISTINCT dst FROM reach WHERE src IN (SELECT stage FROM failed)),
  states AS (SELECT 'stage_' || p_partkey AS stage, CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'ready' ELSE 'completed' END AS state FROM part)
  SELECT stage, CASE WHEN state IN ('pending', 'ready') AND stage IN (SELECT dst FROM below) THEN 'blocked' ELSE state END AS state FROM states""")
def failure_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part")
    states = p.select(I.stage_name("p_partkey").alias("stage"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'ready' ELSE 'completed' END").alias("state"))
    return E.failure_cascade(states, I.stage_links(spark, sf_dir), p.where("p_brand = 'Brand#8'").select(I.stage_name("p_partkey").alias("stage")))


DIMENSIONS = "(SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT role FROM conversations) b"


def _dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {c: I.table(spark, sf_dir, t).select(F.col(c).alias("value")).distinct() for c, t in (("lang", "documents"), ("role", "conversations"))}


@query(f"SELECT lang, role, 'train@' || lang || '_' || role AS stage FROM {DIMENSIONS}")
def matrix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.expand_matrix(_dimensions(spark, sf_dir), "train")


@query(f"SELECT lang, role, 'train@' || role || '-on-' || lang AS stage FROM {DIMENSIONS}")
def matrix_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.expand_matrix(_dimensions(spark, sf_dir), "train", "{role}-on-{lang}")


@query(f"""SELECT stage, key, value FROM (SELECT 'train@' || lang || '_' || role AS stage, lang, role FROM {DIMENSIONS}),
  LATERAL (VALUES ('depth', CASE WHEN role = 'user' THEN '9' WHEN lang = 'en' THEN '3' ELSE '1' END), ('lr', '0.1'), ('vocab', CASE WHEN lang = 'en' THEN 'large' END)) t(key, value) WHERE value IS NOT NULL""")
def matrix_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix_expand(spark, sf_dir)
    as_map = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    merged = expand.with_overrides(as_map(depth="1", lr="0.1"), F.when(F.col("lang") == "en", as_map(depth="3", vocab="large")), F.when(F.col("role") == "user", as_map(depth="9")))
    return m.select("stage", F.explode(merged).alias("key", "value"))


@query("""SELECT p_partkey, 'data/' || p_type || '/' || p_size || '.csv' AS path, false AS unresolved FROM part""")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part")
    path = S.interpolated(F.lit("data/${kind}/${size}.csv"), {"kind": F.col("p_type"), "size": F.col("p_size").cast("string")})
    return p.select("p_partkey", path.alias("path")).withColumn("unresolved", S.unresolved(F.col("path")))


LAYERS = """SELECT p_size AS stage, 'opt.' || (p_partkey % 5) AS key, p_brand AS value, p_partkey AS priority FROM part"""


@query(f"SELECT stage, key, arg_max(value, priority) AS value FROM ({LAYERS}) GROUP BY stage, key")
def deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = I.table(spark, sf_dir, "part").select(F.col("p_size").alias("stage"), F.concat(F.lit("opt."), (F.col("p_partkey") % 5).cast("string")).alias("key"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("priority"))
    return expand.deep_merge(layers, ["stage", "key"])


@query("""SELECT 'train@m' || p_partkey AS stage, 'lr' AS key, CASE WHEN p_partkey % 3 = 0 THEN 'exact' ELSE 'base' END AS value FROM part UNION ALL SELECT 'train@m' || p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part""")
def effective_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part").withColumn("stage", F.concat(F.lit("train@m"), F.col("p_partkey").cast("string")))
    defaults = p.select("stage", F.lit("lr").alias("key"), F.lit("default").alias("value")).union(p.select("stage", F.lit("size"), F.col("p_size").cast("string")))
    overrides = spark.createDataFrame([("train", "lr", "base")], "target string, key string, value string").union(p.where("p_partkey % 3 = 0").select("stage", F.lit("lr"), F.lit("exact")))
    return expand.effective_params(p.select("stage"), defaults, overrides)


@query("""SELECT key, CASE WHEN p_partkey % 3 = 0 THEN 'c' WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'a' END AS value, CASE WHEN p_partkey % 3 = 0 THEN 'local' WHEN p_partkey % 2 = 0 THEN 'global' ELSE 'default' END AS source
  FROM (SELECT p_partkey, 'key_' || p_partkey AS key FROM part)""")
def config_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part")
    layer = lambda rows, value, source, n: rows.select(F.concat(F.lit("key_"), F.col("p_partkey").cast("string")).alias("key"), F.lit(value).alias("value"), F.lit(source).alias("source"), F.lit(n).alias("priority"))
    return expand.layered_value(layer(p, "a", "default", 0).union(layer(p.where("p_partkey % 2 = 0"), "b", "global", 1)).union(layer(p.where("p_partkey % 3 = 0"), "c", "local", 2)))


@query("SELECT p_size AS stage, 'a' AS leaf, count(DISTINCT p_brand) AS n, arg_max(p_brand || '.a', p_partkey) AS winner FROM part GROUP BY p_size HAVING count(DISTINCT p_brand) > 1")
def colliding_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part")
    return expand.colliding_leaves(p.select(F.col("p_size").alias("stage"), F.concat("p_brand", F.lit(".a")).alias("key"), F.col("p_partkey").alias("ordinal")))
