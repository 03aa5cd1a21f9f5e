"""Named queries over caches, sets of objects, incremental state, runs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import cache, history, incremental, patterns, staleness
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


# --- cache and object sets


@query("SELECT left(sha256(text), 16) AS hash, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents")
    return docs.groupBy(cache.content_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("size"))


@query(f"SELECT n.hash FROM (SELECT DISTINCT hash FROM ({I.NEW_FILES})) n WHERE n.hash NOT IN (SELECT hash FROM ({I.OLD_FILES}))")
def new_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = I.file_snapshots(spark, sf_dir)
    return cache.new_objects(new.select("hash"), old.select("hash"))


@query(f"SELECT source, left(sha256(string_agg(path || ':' || hash, chr(10) ORDER BY path)), 16) AS hash, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS size FROM ({I.OLD_FILES}) GROUP BY source")
def tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    return cache.tree_hash(old.withColumnRenamed("path", "relpath"), "source")


@query(f"SELECT left(hash, 2) AS shard, count(*) AS n_objects, min(left(hash, 2) || '/' || substr(hash, 3)) AS first_path FROM (SELECT DISTINCT hash FROM ({I.OLD_FILES})) GROUP BY 1")
def cache_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    return cache.shard_counts(old.select("hash").distinct())


@query(f"SELECT DISTINCT hash FROM ({I.OLD_FILES})")
def cached_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    listing = old.select(F.concat(F.lit("cache/files/"), S.cache_path(F.col("hash"))).alias("path")).union(old.select("path"))
    return cache.cached_hashes(listing)


@query(f"""SELECT o.path, n.hash, CASE WHEN n.path IS NULL THEN 'missing' WHEN n.hash IS NULL THEN 'unreadable' ELSE 'ok' END AS status, o.source AS stage
  FROM ({I.OLD_FILES}) o LEFT JOIN (SELECT path, CASE WHEN doc_id % 13 <> 0 THEN hash END AS hash FROM ({I.NEW_FILES})) n ON o.path = n.path""")
def dependency_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = I.file_snapshots(spark, sf_dir)
    files = new.select("path", F.expr("CASE WHEN doc_id % 13 <> 0 THEN hash END").alias("hash"))
    return cache.dependency_hashes(old.select(F.col("source").alias("stage"), "path"), files)


@query(f"""SELECT o.path, CASE WHEN o.size = n.size AND o.doc_id % 5 <> 0 THEN o.hash ELSE n.hash END AS hash FROM ({I.NEW_FILES}) n JOIN ({I.OLD_FILES}) o ON o.path = n.path""")
def hash_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = I.file_snapshots(spark, sf_dir)
    stat = lambda f, t: f.select("path", "size", t.alias("mtime_ns"), F.col("doc_id").alias("inode"), "hash")
    now = stat(new, F.expr("CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END"))
    return cache.remembered(now.withColumnRenamed("hash", "new_hash"), stat(old, F.lit(1))).select("path", F.coalesce("known_hash", "new_hash").alias("hash"))


def _manifests(old: DataFrame) -> DataFrame:
    """Folder outputs: a record for each source and language, and single files of the fourth part."""
    entry = F.struct(F.col("path").alias("relpath"), "hash", "size", F.lit(False).alias("isexec"))
    folders = old.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("manifest"))
    return folders.select(F.col("source").alias("stage"), F.col("source").alias("path"), F.lit("0123456789abcdef").alias("hash"), "manifest")


@query(f"SELECT source AS stage, source AS path, path AS relpath, hash FROM ({I.OLD_FILES})")
def blob_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.blob_hashes(_manifests(I.file_snapshots(spark, sf_dir)[0]))


@query(f"SELECT hash, CASE WHEN hash IN ({I.REMOTE}) THEN 'common' ELSE 'local_only' END AS state FROM ({I.LOCAL})")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, _ = I.hash_sets(spark, sf_dir)
    half = F.substring("hash", 1, 1) < "8"
    return cache.sync_status(local, remote.where(half), remote.where(~half))


@query(f"SELECT hash FROM ({I.LOCAL}) EXCEPT SELECT hash FROM ({I.REMOTE})")
def push_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, _ = I.hash_sets(spark, sf_dir)
    return cache.push_set(local, remote)


@query(f"SELECT hash FROM ({I.NEEDED}) EXCEPT SELECT hash FROM ({I.LOCAL})")
def pull_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, _, needed = I.hash_sets(spark, sf_dir)
    return cache.pull_set(needed, local)


@query(f"SELECT hash, hash IN ({I.REMOTE}) AS found FROM ({I.NEEDED})")
def bulk_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, remote, needed = I.hash_sets(spark, sf_dir)
    return cache.exists_by_shard(needed, remote)


@query(f"SELECT 'origin' AS remote, hash FROM (SELECT hash FROM ({I.REMOTE}) UNION SELECT hash FROM ({I.LOCAL})) WHERE hash NOT IN ({I.NEEDED})")
def remote_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, needed = I.hash_sets(spark, sf_dir)
    index = cache.index_add(remote.select(F.lit("origin").alias("remote"), "hash"), "origin", local)
    other = cache.index_add(index, "second", needed)
    return cache.index_remove(cache.index_clear(other, "second"), "origin", needed)


PLAN = f"""SELECT o.path, o.hash, CASE WHEN n.path IS NOT NULL THEN 'skipped' WHEN o.hash IN ({I.LOCAL}) THEN 'restored' ELSE 'missing' END AS result FROM ({I.OLD_FILES}) o LEFT JOIN ({I.NEW_FILES}) n ON o.path = n.path"""


@query(PLAN)
def checkout_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = I.file_snapshots(spark, sf_dir)
    return cache.checkout_plan(old.select("path", "hash"), new, I.hash_sets(spark, sf_dir)[0])


@query(f"SELECT result, count(*) AS n FROM ({PLAN}) GROUP BY result")
def checkout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.checkout_counts(checkout_plan(spark, sf_dir))


@query(f"SELECT path, hash, CASE WHEN hash IN ({I.LOCAL}) THEN 'cache' WHEN hash IN ({I.NEEDED}) THEN 'snapshot' WHEN hash IN ({I.REMOTE}) THEN 'remote' END AS source FROM ({I.OLD_FILES})")
def restore_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    local, remote, needed = I.hash_sets(spark, sf_dir)
    return cache.restore_source(old.select("path", "hash"), local, needed, remote)


@query(f"SELECT source AS stage, bool_and(hash IN ({I.LOCAL})) AS restorable FROM ({I.OLD_FILES}) GROUP BY source")
def restorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.restorable(_manifests(I.file_snapshots(spark, sf_dir)[0]), I.hash_sets(spark, sf_dir)[0])


@query(f"SELECT o.path, n.hash IS DISTINCT FROM o.hash AS needs_restore FROM ({I.OLD_FILES}) o LEFT JOIN ({I.NEW_FILES}) n ON o.path = n.path")
def needs_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = I.file_snapshots(spark, sf_dir)
    return cache.needs_restore(old.select("path", "hash"), new)


TRACKED = f"SELECT o.path, CASE WHEN n.hash IS NULL THEN 'missing' WHEN n.hash = o.hash THEN 'clean' ELSE 'modified' END AS state FROM ({I.OLD_FILES}) o LEFT JOIN ({I.NEW_FILES}) n ON o.path = n.path"


@query(TRACKED)
def tracked_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staleness.tracked_status(*I.file_snapshots(spark, sf_dir))


@query(f"SELECT path, state, CASE WHEN state = 'missing' THEN 'error' ELSE 'warning' END AS level FROM ({TRACKED}) WHERE state <> 'clean'")
def tracked_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staleness.tracked_problems(*I.file_snapshots(spark, sf_dir))


MISSING = f"SELECT source AS stage, hash, count(*) AS n_paths, source AS first_path FROM ({I.OLD_FILES}) WHERE hash NOT IN ({I.LOCAL}) AND hash NOT IN ({I.REMOTE}) GROUP BY source, hash"


@query(MISSING)
def verify_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, _ = I.hash_sets(spark, sf_dir)
    return staleness.missing_objects(_manifests(I.file_snapshots(spark, sf_dir)[0]), local, remote)


@query(f"""SELECT s.source AS stage, NOT s.stale AND coalesce(m.n, 0) = 0 AS passed, CASE WHEN s.stale THEN 'stale' WHEN coalesce(m.n, 0) > 0 THEN 'missing' END AS reason, coalesce(m.n, 0) AS n_missing
  FROM (SELECT DISTINCT source, source LIKE '%3' AS stale FROM documents) s LEFT JOIN (SELECT stage, count(*) AS n FROM ({MISSING}) GROUP BY stage) m ON s.source = m.stage""")
def verify_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, _ = I.hash_sets(spark, sf_dir)
    outs = _manifests(I.file_snapshots(spark, sf_dir)[0])
    return staleness.verify(outs.select("stage", F.col("stage").endswith("3").alias("stale")), outs, local, remote)


@query(f"SELECT source AS stage, path FROM ({I.OLD_FILES}) WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 11 <> 0")
def uncached_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = I.file_snapshots(spark, sf_dir)
    outs = old.select(F.col("source").alias("stage"), "path", (F.col("doc_id") % 2 == 0).alias("incremental"))
    locked = old.where("doc_id % 3 = 0").select(F.col("source").alias("stage"), "path", "hash")
    return staleness.uncached_incremental(outs, locked, new)


# --- incremental execution


@query("""SELECT 'stage_' || p_partkey AS stage, left(sha256('{"func":"' || p_brand || '"}' || chr(31) || '{"n":' || p_size || '}' || chr(31) || '[{"path":"a","hash":"' || p_type || '"},{"path":"b","hash":"x"}]' || chr(31) || '[{"path":"out","cached":true}]'), 16) AS input_hash FROM part""")
def input_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda path, h: F.struct(F.lit(path).alias("path"), h.alias("hash"))
    code = incremental.canonical_map(F.create_map(F.lit("func"), F.col("p_brand")))
    params = F.concat(F.lit('{"n":'), F.col("p_size").cast("string"), F.lit("}"))
    deps, outs = F.array(entry("b", F.lit("x")), entry("a", F.col("p_type"))), F.array(F.struct(F.lit("out").alias("path"), F.lit(True).alias("cached")))
    return I.table(spark, sf_dir, "part").select(I.stage_name("p_partkey").alias("stage"), incremental.input_hash(code, params, deps, outs).alias("input_hash"))


@query(f"""WITH d AS (SELECT 'stage_' || d AS stage, 'data/' || s || '.csv' AS path, s AS gen FROM ({I.PART_EDGES})),
  r AS (SELECT stage, path, CASE WHEN gen % 19 = 0 THEN gen + 1 ELSE gen END AS gen FROM d WHERE gen % 23 <> 0),
  f AS (SELECT d.stage, bool_and(coalesce(r.gen = d.gen, false)) AS fresh FROM d LEFT JOIN r ON d.stage = r.stage AND d.path = r.path GROUP BY d.stage)
  SELECT 'stage_' || p_partkey AS stage, p_size <> 7 AND coalesce(f.fresh, true) AS can_skip FROM part LEFT JOIN f ON f.stage = 'stage_' || p_partkey""")
def generation_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.part_edges(spark, sf_dir)
    deps = e.select(I.stage_name("d").alias("stage"), I.file_name("s").alias("path"))
    recorded = e.where("s % 23 <> 0").select(I.stage_name("d").alias("stage"), I.file_name("s").alias("path"), F.expr("CASE WHEN s % 19 = 0 THEN s + 1 ELSE s END").alias("gen"))
    part = I.table(spark, sf_dir, "part")
    return incremental.generation_skip(part.select(I.stage_name("p_partkey").alias("stage"), (F.col("p_size") != 7).alias("same")), deps, recorded, part.select(I.file_name("p_partkey").alias("path"), F.col("p_partkey").alias("gen")))


@query("SELECT event_type || '/' || user_id AS path, count(*) AS gen FROM events GROUP BY 1")
def latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.generations(_writes(spark, sf_dir))


@query("SELECT event_id AS seq, event_type || '/' || user_id AS path, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS gen FROM events")
def running_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.running_generation(_writes(spark, sf_dir))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("path"))


@query("""SELECT stage, path, gen FROM (SELECT user_id AS stage, event_type AS path, event_id AS gen, date_trunc('day', ts) AS c, max(date_trunc('day', ts)) OVER (PARTITION BY user_id) AS m FROM events) WHERE c = m""")
def latest_dep_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    return incremental.latest_dep_generations(e.select(F.col("user_id").alias("stage"), F.col("event_type").alias("path"), F.col("event_id").alias("gen"), F.date_trunc("day", "ts").alias("commit")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.latest(I.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


CACHE_HITS = """SELECT 'stage_' || p_partkey AS stage, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 THEN 'run_' || p_size END AS run_id,
  p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS hit FROM part"""


@query(CACHE_HITS)
def run_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part").withColumn("stage", I.stage_name("p_partkey"))
    stages = p.select("stage", F.col("p_brand").alias("input_hash"), F.array(F.lit("b"), F.lit("a")).alias("out_paths"), (F.col("p_partkey") % 7 == 0).alias("incremental"))
    known = p.where("p_partkey % 3 <> 0").select(
        "stage",
        F.expr("CASE WHEN p_partkey % 5 = 0 THEN concat(p_brand, 'x') ELSE p_brand END").alias("input_hash"),
        F.concat(F.lit("run_"), F.col("p_size").cast("string")).alias("run_id"),
        F.when(F.col("p_partkey") % 11 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("out_paths"),
    )
    return incremental.run_cache_hits(stages, known)


@query(f"""SELECT r.stage, CASE WHEN k % 4 = 0 THEN 'skip_generation' WHEN r.reason IS NULL THEN 'skip_lock' WHEN h.hit THEN 'skip_run_cache' ELSE 'run' END AS action,
  CASE WHEN k % 4 <> 0 AND r.reason IS NOT NULL AND NOT h.hit THEN r.reason ELSE 'unchanged' END AS reason
  FROM (SELECT n.stage, n.k, CASE WHEN o.stage IS NULL THEN 'No previous run' WHEN n.code <> o.code THEN 'Code changed' WHEN n.params <> o.params THEN 'Params changed'
    WHEN n.deps <> o.deps THEN 'Input dependencies changed' WHEN n.outs <> o.outs THEN 'Output paths changed' END AS reason FROM ({I.STAGE_STATE}) n LEFT JOIN ({I.LOCK_STATE}) o ON n.stage = o.stage) r
  JOIN ({CACHE_HITS}) h ON r.stage = h.stage""")
def skip_or_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    generation = I.table(spark, sf_dir, "part").select(I.stage_name("p_partkey").alias("stage"), (F.col("p_partkey") % 4 == 0).alias("can_skip"))
    return incremental.skip_or_run(generation, staleness.lock_reason(*I.stage_states(spark, sf_dir)), run_cache_lookup(spark, sf_dir))


@query(f"SELECT o.source AS stage, bool_and(coalesce(o.size = n.size AND o.doc_id % 17 <> 0, false)) AS hit FROM ({I.OLD_FILES}) o LEFT JOIN ({I.NEW_FILES}) n ON o.path = n.path GROUP BY o.source")
def manifest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = I.file_snapshots(spark, sf_dir)
    stat = lambda f, t: f.select("path", F.col("source").alias("stage"), "size", t.alias("mtime_ns"), F.col("doc_id").alias("inode"))
    return incremental.manifest_cache_hits(stat(old, F.lit(1)), stat(new, F.expr("CASE WHEN doc_id % 17 = 0 THEN 2 ELSE 1 END")))


# --- runs and timings

RUNS = "SELECT strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS run_id, o_custkey, o_orderkey FROM orders"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders")
    return o.select(F.concat_ws("_", F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("run_id"), "o_custkey", "o_orderkey")


@query(f"SELECT run_id FROM ({RUNS}) ORDER BY run_id DESC LIMIT 100")
def runs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest_runs(_runs(spark, sf_dir).select("run_id"))


@query(f"SELECT run_id FROM ({RUNS}) ORDER BY run_id DESC LIMIT 1000 OFFSET 100")
def runs_to_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.runs_to_delete(_runs(spark, sf_dir).select("run_id"))


@query(f"SELECT o_orderkey, run_id FROM ({RUNS}) WHERE o_orderkey % 7 <> 0 AND run_id NOT IN (SELECT run_id FROM ({RUNS}) ORDER BY run_id DESC LIMIT 100)")
def run_cache_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    entries = runs.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN '__committed__' ELSE run_id END").alias("run_id"))
    return history.orphan_cache_entries(entries, history.newest_runs(runs.select("run_id")))


RECORDS = "SELECT o_custkey AS run_id, o_orderkey AS stage, CASE o_orderstatus WHEN 'P' THEN 'ran' WHEN 'F' THEN 'failed' ELSE 'skipped' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'upstream x failed' WHEN o_orderkey % 7 = 0 THEN 'cancelled' ELSE 'unchanged' END AS reason, o_orderkey % 1000 AS duration_ms FROM orders"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("stage"),
        F.expr("CASE o_orderstatus WHEN 'P' THEN 'ran' WHEN 'F' THEN 'failed' ELSE 'skipped' END").alias("status"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'upstream x failed' WHEN o_orderkey % 7 = 0 THEN 'cancelled' ELSE 'unchanged' END").alias("reason"),
        F.expr("o_orderkey % 1000").alias("duration_ms"),
    )


@query(f"SELECT run_id, count(*) FILTER (status = 'ran') AS n_ran, count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status = 'failed') AS n_failed, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM ({RECORDS}) GROUP BY run_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = history.run_records(_records(spark, sf_dir).withColumn("input_hash", F.lit("h")).withColumn("stage", F.col("stage").cast("string")))
    return history.run_summary(history.run_stages(nested))


KINDS = f"SELECT CASE WHEN status = 'ran' THEN 'success' WHEN status = 'failed' THEN 'failed' WHEN starts_with(reason, 'upstream') THEN 'blocked' WHEN reason = 'cancelled' THEN 'cancelled' ELSE 'cached' END AS kind FROM ({RECORDS})"


@query(f"SELECT count(*) FILTER (kind = 'success') AS n_ran, count(*) FILTER (kind IN ('cached', 'cancelled')) AS n_cached, count(*) FILTER (kind = 'blocked') AS n_blocked, count(*) FILTER (kind = 'failed') AS n_failed FROM ({KINDS})")
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.result_counts(_records(spark, sf_dir))


@query(f"SELECT kind, count(*) AS n FROM ({KINDS}) GROUP BY kind")
def display_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy(S.display_category(F.col("status"), F.col("reason")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS n_running, count(*) FILTER (o_orderstatus = 'P') AS n_completed, count(*) FILTER (o_orderstatus = 'F') AS n_failed FROM orders")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.status_counts(I.table(spark, sf_dir, "orders").select(F.expr("CASE o_orderstatus WHEN 'O' THEN 'in_progress' WHEN 'P' THEN 'completed' ELSE 'failed' END").alias("status")))


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 2) AS total_ms, round(avg(value), 4) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms FROM events WHERE event_id % 10 <> 0 AND value IS NOT NULL GROUP BY 1")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.expr("CASE WHEN event_id % 20 = 0 THEN double('NaN') WHEN event_id % 10 = 0 THEN double('Infinity') ELSE value END").alias("duration_ms"))
    out = history.timing_summary(e)
    return out.withColumn("total_ms", F.round("total_ms", 2)).withColumn("avg_ms", F.round("avg_ms", 4))


@query("SELECT name, seq FROM (SELECT event_type AS name, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r > n // 2")
def bounded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.bounded_samples(I.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq")), most=1)


@query("SELECT 'm' || p_size AS base, string_agg('m' || p_size || '@' || p_partkey, ',' ORDER BY 'm' || p_size || '@' || p_partkey) AS stages, count(*) AS n FROM part GROUP BY p_size")
def stage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_size").cast("string"), F.lit("@"), F.col("p_partkey").cast("string")).alias("stage"))
    return history.groups_by_base(p).withColumn("stages", F.array_join("stages", ","))


@query("SELECT mutex, count(*) AS n, min(stage) AS stage FROM (SELECT c_name AS stage, unnest(['m' || c_custkey // 2, 'own' || c_custkey]) AS mutex FROM customer WHERE c_custkey % 5 <> 0) GROUP BY mutex HAVING count(*) = 1")
def lonely_mutexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.expr("CASE WHEN c_custkey % 5 = 0 THEN array('*') ELSE array(concat('m', c_custkey div 2), concat('own', c_custkey)) END")
    return history.lonely_mutexes(I.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), m.alias("mutex")))


# --- events


@query("""SELECT user_id, batch, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch FROM
  (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, batch""")
def debounce_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.debounced(I.table(spark, sf_dir, "events"), ["user_id"], "30 minutes")


@query("""SELECT event_type, bucket_ms, n_events, CAST(sum(n_events) OVER (PARTITION BY event_type ORDER BY bucket_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window,
  round(sum(n_events) OVER (PARTITION BY event_type ORDER BY bucket_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) * 1000 / 3600000.0, 4) AS per_second
  FROM (SELECT event_type, CAST(floor(epoch_us(ts) / 1000.0 / 60000) * 60000 AS BIGINT) AS bucket_ms, count(*) AS n_events FROM events GROUP BY 1, 2)""")
def sliding_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.throughput(I.table(spark, sf_dir, "events"), 3_600_000, 60_000, ["event_type"])


@query("SELECT event_id, user_id, event_type, previous_state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state FROM events) WHERE event_type IS DISTINCT FROM previous_state")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.state_changes(I.table(spark, sf_dir, "events"), "user_id", "event_type").select("event_id", "user_id", "event_type", "previous_state")


@query("""WITH runs AS (SELECT s.user_id, s.ts AS start_ts, min(p.ts) AS end_ts FROM events s JOIN events p ON s.user_id = p.user_id AND p.event_type = 'purchase' AND p.ts > s.ts WHERE s.event_type = 'signup' GROUP BY s.user_id, s.ts, s.event_id)
  SELECT c.event_id, coalesce(max(r.end_ts), c.ts) AS effective_ts, max(r.end_ts) IS NOT NULL AS deferred FROM events c LEFT JOIN runs r ON c.user_id = r.user_id AND c.ts >= r.start_ts AND c.ts < r.end_ts WHERE c.event_type = 'click' GROUP BY c.event_id, c.ts""")
def deferred_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    return E.deferred(e.where("event_type = 'click'"), E.producer_runs(e, "user_id", "signup", "purchase"), "user_id").select("event_id", "effective_ts", "deferred")


@query("SELECT event_id, user_id, epoch_us(n - ts) // 1000000 AS seconds FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NOT NULL")
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.completions(I.table(spark, sf_dir, "events"), "user_id").select("event_id", "user_id", "seconds")


@query("""SELECT user_id, event_id, age, greatest(0, n - 20) AS n_dropped FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE age <= 20""")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ring_buffer(I.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id", "age", "n_dropped")


@query("SELECT event_id FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000) WHERE event_id > (SELECT max(event_id) - 300 FROM events)")
def events_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("version"))
    return E.events_since(e, e.agg(F.max("version")).first()[0] - 300).select("event_id")


@query("SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events) WHERE place <= 64")
def bounded_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bounded_queues(I.table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "place")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def last_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").select("user_id", F.expr("CASE WHEN event_type = 'purchase' THEN 'stage_completed' ELSE event_type END").alias("type"), "event_id", "value", F.col("event_id").alias("seq"))
    return E.last_results(e, "user_id").select("user_id", "event_id", "value")


SINK = "CASE event_type WHEN 'signup' THEN 'stage_start' WHEN 'purchase' THEN 'stage_complete' ELSE event_type END"


@query(f"SELECT event_id, {SINK} AS type FROM events WHERE event_type <> 'view'")
def sink_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'stage_started' WHEN 'purchase' THEN 'stage_completed' WHEN 'view' THEN 'log_line' ELSE event_type END")
    return E.sink_events(I.table(spark, sf_dir, "events").select("event_id", kind.alias("type")))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'affected' WHEN 'error' THEN 'reload' WHEN 'signup' THEN 'run' WHEN 'purchase' THEN 'cancel' ELSE 'ignored' END AS branch FROM events")
def event_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'click' THEN 'data_changed' WHEN 'error' THEN 'code_changed' WHEN 'signup' THEN 'run_requested' WHEN 'purchase' THEN 'cancel_requested' ELSE 'x' END")
    return E.routed(I.table(spark, sf_dir, "events").select("event_id", kind.alias("type"))).select("event_id", "branch")


@query("SELECT page_id, url LIKE '%.py' OR split_part(url, '/', -1) IN ('pipeline.yaml', 'params.yaml') AS is_code FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '/params.yaml' ELSE '' END AS url FROM pages)")
def event_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.expr("CASE page_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '/params.yaml' ELSE '' END")).alias("path"))
    return p.select("page_id", S.is_code(F.col("path")).alias("is_code"))


@query("SELECT conv_id, line_no, line FROM (SELECT conv_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT conv_id, string_split(regexp_replace(string_agg(text || chr(10), '' ORDER BY turn), '\\n$', ''), chr(10)) AS l FROM conversations GROUP BY conv_id))")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\n")).alias("text"))
    return E.split_lines(c, "conv_id", "turn").select("conv_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


STATES = "SELECT c_name AS stage, CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'blocked' ELSE 'completed' END AS state FROM customer"


@query(f"SELECT stage, CASE WHEN state IN ('pending', 'blocked') THEN 'skipped' ELSE state END AS state, CASE WHEN state IN ('pending', 'blocked') THEN 'cancelled' END AS reason FROM ({STATES})")
def cancelled_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.table(spark, sf_dir, "customer")
    return E.cancelled(c.select(F.col("c_name").alias("stage"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'blocked' ELSE 'completed' END").alias("state")))


# --- patterns and logs

LINES = "SELECT user_id AS stage, event_id AS seq, CASE event_id % 4 WHEN 0 THEN '[2024-01-01 10:00:00] ' ELSE '' END || CASE event_type WHEN 'error' THEN 'ERROR: ' WHEN 'click' THEN 'warning - ' ELSE 'note ' END || props AS line FROM events"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.expr("CASE event_id % 4 WHEN 0 THEN '[2024-01-01 10:00:00] ' ELSE '' END"), F.expr("CASE event_type WHEN 'error' THEN 'ERROR: ' WHEN 'click' THEN 'warning - ' ELSE 'note ' END"), "props")
    return I.table(spark, sf_dir, "events").select(F.col("user_id").alias("stage"), F.col("event_id").alias("seq"), line.alias("line"))


@query("SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' END AS level FROM events")
def log_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("seq", S.log_level(F.col("line")).alias("level"))


@query(f"SELECT stage, seq, row_number() OVER (PARTITION BY stage ORDER BY seq) AS match FROM ({LINES}) WHERE contains(lower(line), 'error: ')")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.search_log(_lines(spark, sf_dir), "Error: ").select("stage", "seq", "match")


IGNORE = [("project", "# comment"), ("project", "*.txt"), ("project", "!docs/src1/**"), ("user", "docs/src2/"), ("user", "**/fr/*")]


@query(f"""SELECT path, CASE WHEN line = 3 THEN false ELSE line IS NOT NULL END AND source <> 'src3' AS ignored, CASE line WHEN 2 THEN '*.txt' WHEN 3 THEN '!docs/src1/**' WHEN 4 THEN 'docs/src2/' WHEN 5 THEN '**/fr/*' END AS pattern, line
  FROM (SELECT path, source, CASE WHEN path LIKE '%/fr/%' THEN 5 WHEN source = 'src2' THEN 4 WHEN source = 'src1' THEN 3 ELSE 2 END AS line FROM ({I.OLD_FILES}))""")
def ignore_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = I.file_snapshots(spark, sf_dir)
    return patterns.check_ignored(old.select("path"), patterns.parse_ignore(IGNORE, spark), ("src3",))


@query("SELECT s AS stage, split_part(s, '@', 1) AS base, contains(s, '7') AS visible, bool_or(contains(s, '7')) OVER (PARTITION BY split_part(s, '@', 1)) AS group_visible FROM (SELECT 'g' || p_size || '@' || p_partkey AS s FROM part)")
def stage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part").select(F.concat(F.lit("g"), F.col("p_size").cast("string"), F.lit("@"), F.col("p_partkey").cast("string")).alias("stage"))
    return patterns.filter_stages(p, "7")


@query(f"SELECT path FROM ({I.OLD_FILES}) WHERE source = 'src4' AND regexp_full_match(path, 'docs/src4/../[0-9]*4[.]txt')")
def listed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.listed(I.file_snapshots(spark, sf_dir)[0].select("path"), "docs/src4", "??/*4.txt")
