"""Runs, their retention and summaries, timings and counts of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import display_category, stage_base

RETENTION, EXAMINED = 100, 1000
MAX_SAMPLES = 100_000


def newest_runs(runs: DataFrame, limit: int = RETENTION) -> DataFrame:
    """The newest runs; run ids begin with their time."""
    return runs.orderBy(F.desc("run_id")).limit(limit)


def runs_to_delete(runs: DataFrame, retention: int = RETENTION) -> DataFrame:
    """Runs beyond the newest ``retention``, of the newest that are looked at."""
    looked = newest_runs(runs, retention + EXAMINED)
    return looked.join(newest_runs(runs, retention).select("run_id"), "run_id", "left_anti")


def orphan_cache_entries(run_cache: DataFrame, runs: DataFrame) -> DataFrame:
    """Run-cache entries of runs that are gone; ids that begin with ``__`` are never orphans."""
    return run_cache.where(~F.col("run_id").startswith("__")).join(runs.select("run_id"), "run_id", "left_anti")


def run_stages(runs: DataFrame) -> DataFrame:
    """One row for each stage of each run."""
    return runs.select("run_id", F.explode("stages").alias("stage", "record")).select("run_id", "stage", "record.*")


def run_summary(records: DataFrame) -> DataFrame:
    """Stages ran, skipped and failed, and the sum of their durations, of each run."""
    return records.groupBy("run_id").agg(
        F.count_if(F.col("status") == "ran").alias("n_ran"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
    )


def result_counts(results: DataFrame) -> DataFrame:
    """Results ran, cached (cancelled ones too), blocked and failed."""
    kind = results.select(display_category(F.col("status"), F.col("reason")).alias("kind"))
    return kind.agg(
        F.count_if(F.col("kind") == "success").alias("n_ran"),
        F.count_if(F.col("kind").isin("cached", "cancelled")).alias("n_cached"),
        F.count_if(F.col("kind") == "blocked").alias("n_blocked"),
        F.count_if(F.col("kind") == "failed").alias("n_failed"),
    )


def status_counts(stages: DataFrame) -> DataFrame:
    """Stages running, completed and failed; other states aren't counted."""
    return stages.agg(
        F.count_if(F.col("status") == "in_progress").alias("n_running"),
        F.count_if(F.col("status").isin("completed", "ran")).alias("n_completed"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
    )


def timing_summary(samples: DataFrame) -> DataFrame:
    """Count, total, mean, least and greatest duration by name; not-a-number and infinite ones are left out."""
    d = F.col("duration_ms")
    finite = samples.where(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))))
    return finite.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("total_ms"), F.avg(d).alias("avg_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"))


def bounded_samples(samples: DataFrame, order: str = "seq", most: int = MAX_SAMPLES) -> DataFrame:
    """The samples with the older half of each name dropped once there are ``most``."""
    if samples.count() < most:
        return samples
    ranked = samples.withColumn("_rank", F.row_number().over(Window.partitionBy("name").orderBy(order)))
    sizes = samples.groupBy("name").agg(F.count(F.lit(1)).alias("_of_name"))
    return ranked.join(sizes, "name").where(F.col("_rank") > F.floor(F.col("_of_name") / 2)).select(samples.columns)


def groups_by_base(stages: DataFrame) -> DataFrame:
    """Stage names by the part before ``@``."""
    return stages.groupBy(stage_base(F.col("stage")).alias("base")).agg(F.array_sort(F.collect_list("stage")).alias("stages"), F.count(F.lit(1)).alias("n"))


def lonely_mutexes(stages: DataFrame) -> DataFrame:
    """Mutex groups of one stage; the exclusive group ``*`` aside."""
    return stages.select(F.col("name").alias("stage"), F.explode("mutex").alias("mutex")).where("mutex <> '*'").groupBy("mutex").agg(F.count(F.lit(1)).alias("n"), F.min("stage").alias("stage")).where("n = 1")


def run_records(results: DataFrame) -> DataFrame:
    """Runs with a map of stage records, from (run_id, stage, input_hash, status, reason, duration_ms) rows; durations are whole and 0 if unknown."""
    record = F.struct("input_hash", "status", "reason", F.coalesce(F.floor("duration_ms"), F.lit(0)).cast("bigint").alias("duration_ms"))
    return results.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", record.alias("record"))))).alias("stages"))


def with_skipped(results: DataFrame, skipped: DataFrame, reason: str) -> DataFrame:
    """Results and a record of no duration for each stage that was skipped."""
    rows = skipped.select("run_id", "stage", F.lit(None).cast("string").alias("input_hash"), F.lit("skipped").alias("status"), F.lit(reason).alias("reason"), F.lit(0.0).alias("duration_ms"))
    return results.unionByName(rows)


def import_counts(stages: DataFrame, notes: DataFrame) -> DataFrame:
    """Stages converted and notes by severity; warnings are counted, not the stages that have some."""
    return stages.agg(F.count(F.lit(1)).alias("n_stages")).join(
        notes.agg(F.count_if(F.col("severity") == "warning").alias("n_warnings"), F.count_if(F.col("severity") == "error").alias("n_errors")), F.lit(True)
    )
