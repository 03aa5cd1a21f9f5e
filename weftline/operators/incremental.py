"""Skipping work: input hashes, generation counters, the run cache, and state that is written once a stage is done.

State tables are append-only; what holds now is a latest-wins view of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.cache import content_hash
from weftline.schemas import lock_entries


def canonical_map(m: Column) -> Column:
    """A map as JSON text in key order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def canonical_list(entries: Column) -> Column:
    """An array as JSON text in its sorted order."""
    return F.to_json(F.array_sort(entries))


def input_hash(code: Column, params: Column, deps: Column, outs: Column) -> Column:
    """A 16-digit hash of what a run depends on: code and parameters as canonical text, sorted (path, hash) pairs, and sorted (path, cached) pairs."""
    return content_hash(F.concat_ws("\x1f", code, params, canonical_list(deps), canonical_list(outs)))


def generations(writes: DataFrame) -> DataFrame:
    """(path, gen): how often each path has been written."""
    return writes.groupBy("path").agg(F.count(F.lit(1)).alias("gen"))


def running_generation(writes: DataFrame, order: str = "seq") -> DataFrame:
    """Every write with the generation that it made."""
    return writes.withColumn("gen", F.row_number().over(Window.partitionBy("path").orderBy(order)))


def latest_dep_generations(records: DataFrame) -> DataFrame:
    """(stage, path, gen) of each stage's latest record (greatest ``commit``), which replaces those before."""
    last = records.groupBy("stage").agg(F.max("commit").alias("commit"))
    return records.join(last, ["stage", "commit"]).select("stage", "path", "gen")


def generation_skip(stages: DataFrame, deps: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(stage, can_skip): code, parameters and outputs as locked (column ``same``), and every input's generation as recorded.

    Without inputs a stage that is the same can be skipped; without a record it can't.
    """
    each = deps.join(recorded.select("stage", "path", F.col("gen").alias("then")), ["stage", "path"], "left").join(current.select("path", F.col("gen").alias("now")), "path", "left")
    fresh = each.groupBy("stage").agg(F.bool_and(F.coalesce(F.col("now") == F.col("then"), F.lit(False))).alias("fresh"))
    return stages.join(fresh, "stage", "left").select("stage", (F.col("same") & F.coalesce("fresh", F.lit(True))).alias("can_skip"))


def run_cache_hits(stages: DataFrame, run_cache: DataFrame) -> DataFrame:
    """(stage, run_id, hit): a former run with the same input hash and output paths; never for stages with incremental outputs.

    Stages have stage, input_hash, out_paths (array) and incremental; the cache stage,
    input_hash, run_id and out_paths.
    """
    known = run_cache.select("stage", "input_hash", F.col("run_id").alias("known_run"), F.array_sort(F.array_distinct("out_paths")).alias("known_paths"))
    joined = stages.join(known, ["stage", "input_hash"], "left")
    hit = F.coalesce(~F.col("incremental") & (F.array_sort(F.array_distinct("out_paths")) == F.col("known_paths")), F.lit(False))
    return joined.select("stage", F.when(hit, F.col("known_run")).alias("run_id"), hit.alias("hit"))


def skip_or_run(generation: DataFrame, reasons: DataFrame, cache_hits: DataFrame) -> DataFrame:
    """(stage, action, reason): skipped by generation, by lock or by run cache, else run."""
    joined = reasons.join(generation, "stage", "left").join(cache_hits.select("stage", "hit"), "stage", "left")
    action = F.when(F.coalesce("can_skip", F.lit(False)), "skip_generation").when(F.col("reason").isNull(), "skip_lock").when(F.coalesce("hit", F.lit(False)), "skip_run_cache").otherwise("run")
    return joined.select("stage", action.alias("action"), F.when(action == "run", F.col("reason")).otherwise("unchanged").alias("reason"))


def deferred_writes(finished: DataFrame, outs: DataFrame, deps: DataFrame, current: DataFrame, commit: str) -> dict[str, DataFrame]:
    """What a finished run appends: dependency generations, a write of each output, and its run-cache entry with cached outputs only."""
    done = finished.select("stage")
    dep_gens = deps.join(done, "stage", "left_semi").join(current, "path").select("stage", "path", "gen", F.lit(commit).alias("commit"))
    writes = outs.join(done, "stage", "left_semi").select("path", F.lit(commit).alias("seq"))
    kept = outs.where("cached").join(finished, "stage").groupBy("stage", "input_hash", "run_id").agg(F.array_sort(F.collect_list(F.struct("path", "hash"))).alias("output_hashes"))
    return {"dep_generations": dep_gens, "writes": writes, "run_cache": kept}


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    rest = F.struct(*[c for c in log.columns if c not in keys])
    return log.groupBy(*keys).agg(F.max_by(rest, order).alias("row")).select(*keys, "row.*")


def commit_snapshot(locks: DataFrame, current: DataFrame) -> DataFrame:
    """Locks with the current state of the stages that have one, others as they were; output generations don't move."""
    return current.unionByName(locks.join(current.select("stage"), "stage", "left_anti"))


def fold_incremental(previous: DataFrame | None, new_rows: DataFrame, fold) -> DataFrame:
    """The next snapshot of an incremental output: ``fold(previous, new_rows)``, with an empty previous one on the first run."""
    before = new_rows.limit(0) if previous is None else previous
    return fold(before, new_rows)


def manifest_cache_hits(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(stage, hit): a remembered code manifest holds while every source file has the same time, size and inode."""
    now = files.select("path", "mtime_ns", "size", "inode", F.lit(True).alias("there"))
    each = sources.join(now, ["path", "mtime_ns", "size", "inode"], "left")
    return each.groupBy("stage").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("hit"))


def ast_hash_lookup(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Remembered hashes of functions by file, its time, size and inode, name, interpreter and schema version."""
    return wanted.join(known, ["path", "mtime_ns", "size", "inode", "qualname", "py_version", "schema_version"], "left")


def storage_form(locks: DataFrame, root: str) -> DataFrame:
    """Locks with paths below ``root`` relative and lists in path order, as they are stored."""
    from weftline.functions.scalars import relative_path

    def stored(column: str) -> Column:
        return F.array_sort(F.transform(column, lambda e: F.struct(relative_path(e["path"], root).alias("path"), e["hash"].alias("hash"), e["manifest"].alias("manifest")))).alias(column)

    return locks.withColumns({c: stored(c) for c in ("deps", "outs")})


def lock_maps(locks: DataFrame) -> DataFrame:
    """(stage, deps, outs) with path -> hash maps."""
    return locks.select("stage", *[F.map_from_entries(F.transform(c, lambda e: F.struct(e["path"], e["hash"]))).alias(c) for c in ("deps", "outs")])


def dep_generation_map(deps: DataFrame, current: DataFrame) -> DataFrame:
    """(stage, path, gen) of inputs that have a generation."""
    return deps.join(current, "path").select("stage", "path", "gen")


def locked_outputs(locks: DataFrame) -> DataFrame:
    """(stage, path, hash, manifest) of all locked outputs."""
    return lock_entries(locks, "outs")
