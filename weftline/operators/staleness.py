"""Which stages would run and why; what is missing; what a change would touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.cache import blob_hashes
from weftline.operators.graph import touched_stages
from weftline.plans.closure import reached

# Reasons, in the order in which they are given.
NO_RUN, CODE, PARAMS, DEPS, OUTS = "No previous run", "Code changed", "Params changed", "Input dependencies changed", "Output paths changed"


def lock_reason(current: DataFrame, locks: DataFrame) -> DataFrame:
    """(stage, reason): why a stage's state isn't that of its lock, null if it is.

    Both tables have stage, code, params, deps and outs in comparable form (canonical text,
    or sorted arrays); a stage without a lock has never run.
    """
    old = locks.select("stage", *[F.col(c).alias(f"old_{c}") for c in ("code", "params", "deps", "outs")], F.lit(True).alias("locked"))
    joined = current.join(old, "stage", "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    reason = F.when(F.col("locked").isNull(), NO_RUN).when(differs("code"), CODE).when(differs("params"), PARAMS).when(differs("deps"), DEPS).when(differs("outs"), OUTS)
    return joined.select("stage", reason.alias("reason"))


def explain(stages: DataFrame) -> DataFrame:
    """(stage, will_run, is_forced, reason) by the precedence of reasons.

    Input columns: locked, params_valid, generation_same, n_missing, n_unreadable,
    code_changed, params_changed, deps_changed, forced (booleans and counts).
    """
    reason = (
        F.when(~F.col("locked"), NO_RUN)
        .when(~F.col("params_valid"), "Invalid params")
        .when(F.col("generation_same") & ~F.col("forced"), F.lit(None))
        .when(F.col("n_missing") > 0, "Missing dependencies")
        .when(F.col("n_unreadable") > 0, "Unreadable dependencies")
        .when(F.col("code_changed"), CODE)
        .when(F.col("params_changed"), PARAMS)
        .when(F.col("deps_changed"), DEPS)
        .when(F.col("forced"), "forced")
    )
    found = stages.select("stage", "forced", reason.alias("reason"))
    return found.select("stage", F.col("reason").isNotNull().alias("will_run"), (F.col("forced") & (F.col("reason") == "forced")).alias("is_forced"), "reason")


def propagate_stale(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """(stage, stale, own, upstream): stale by itself (column ``stale``) or because a stage it depends on is; upstream names its stale makers.

    ``edges`` has src (maker) and dst.
    """
    seeds = stages.where("stale").select(F.col("stage").alias("src"))
    touched = reached(edges, seeds).select(F.col("dst").alias("stage")).union(seeds.select(F.col("src").alias("stage"))).distinct().withColumn("touched", F.lit(True))
    makers = edges.select("src", "dst").distinct().join(touched.select(F.col("stage").alias("src")), "src", "left_semi")
    named = makers.groupBy(F.col("dst").alias("stage")).agg(F.array_join(F.array_sort(F.collect_list(F.col("src").cast("string"))), ",").alias("upstream"))
    return stages.join(touched, "stage", "left").join(named, "stage", "left").select("stage", F.coalesce("touched", F.lit(False)).alias("stale"), F.col("stale").alias("own"), F.coalesce("upstream", F.lit("")).alias("upstream"))


def dry_run(status: DataFrame, reasons: DataFrame) -> DataFrame:
    """(stage, would_run, reason): the own reason, else the stale makers, else unchanged."""
    joined = status.join(reasons, "stage", "left")
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("stale"), F.concat(F.lit("Upstream stale: "), "upstream")).otherwise("unchanged")
    return joined.select("stage", F.col("stale").alias("would_run"), reason.alias("reason"))


def tracked_status(tracked: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state): clean, modified or missing."""
    joined = tracked.select("path", F.col("hash").alias("recorded")).join(files.select("path", "hash"), "path", "left")
    state = F.when(F.col("hash").isNull(), "missing").when(F.col("hash") == F.col("recorded"), "clean").otherwise("modified")
    return joined.select("path", state.alias("state"))


def what_if_changed(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct stages that a change of these paths would touch."""
    return touched_stages(edges, paths)


def missing_objects(outs: DataFrame, local: DataFrame, remote: DataFrame | None = None) -> DataFrame:
    """(stage, hash, n_paths, first_path) of recorded objects that are not held locally, nor remotely where that is allowed."""
    gone = blob_hashes(outs).join(local.select("hash"), "hash", "left_anti")
    if remote is not None:
        gone = gone.join(remote.select("hash"), "hash", "left_anti")
    return gone.groupBy("stage", "hash").agg(F.count(F.lit(1)).alias("n_paths"), F.min("path").alias("first_path"))


def verify(status: DataFrame, outs: DataFrame, local: DataFrame, remote: DataFrame | None = None) -> DataFrame:
    """(stage, passed, reason, n_missing): a stage passes if it isn't stale and nothing of it is missing."""
    gone = missing_objects(outs, local, remote).groupBy("stage").agg(F.count(F.lit(1)).alias("n_missing"))
    joined = status.select("stage", "stale").join(gone, "stage", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    reason = F.when(F.col("stale"), "stale").when(F.col("n_missing") > 0, "missing")
    return joined.select("stage", reason.isNull().alias("passed"), reason.alias("reason"), "n_missing")


def tracked_problems(tracked: DataFrame, files: DataFrame) -> DataFrame:
    """Tracked files that are missing (an error) or modified (a warning)."""
    level = F.when(F.col("state") == "missing", "error").otherwise("warning")
    return tracked_status(tracked, files).where("state <> 'clean'").select("path", "state", level.alias("level"))


def uncached_incremental(outs: DataFrame, locked: DataFrame, files: DataFrame) -> DataFrame:
    """(stage, path) of incremental outputs that are there but were never recorded."""
    own = outs.where("incremental").select("stage", "path")
    recorded = locked.where(F.col("hash").isNotNull()).select("stage", "path")
    return own.join(files.select("path"), "path", "left_semi").select("stage", "path").join(recorded, ["stage", "path"], "left_anti")


def tracked_hash(deps: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, hash) of dependencies that are tracked, or lie in a tracked folder whose manifest has them."""
    exact = deps.select("path").distinct().join(tracked.select("path", "hash"), "path")
    entries = tracked.where(F.col("manifest").isNotNull()).select(F.rtrim(F.col("path"), F.lit("/")).alias("root"), F.explode("manifest").alias("m"))
    inside = entries.select(F.concat_ws("/", "root", "m.relpath").alias("path"), F.col("m.hash").alias("hash"))
    nested = deps.select("path").distinct().join(exact.select("path"), "path", "left_anti").join(inside, "path")
    return exact.union(nested)
