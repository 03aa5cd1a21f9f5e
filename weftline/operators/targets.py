"""What names and paths given by a user stand for, and stage records collected by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_targets(targets: DataFrame) -> DataFrame:
    """Targets that aren't blank."""
    return targets.where(F.trim("target") != "")


def classify_targets(targets: DataFrame, stages: DataFrame, files: DataFrame) -> DataFrame:
    """(target, kind): stage, file, both or neither; a target that is both counts as a stage (``is_stage``)."""
    joined = usable_targets(targets).join(stages.select(F.col("stage").alias("target"), F.lit(True).alias("s")), "target", "left").join(files.select(F.col("path").alias("target"), F.lit(True).alias("f")), "target", "left")
    is_stage, is_file = F.coalesce("s", F.lit(False)), F.coalesce("f", F.lit(False))
    kind = F.when(is_stage & is_file, "both").when(is_stage, "stage").when(is_file, "file").otherwise("neither")
    return joined.select("target", kind.alias("kind"), is_stage.alias("is_stage"))


def collect_params(requested: DataFrame, stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stage, key, value) of the requested stages with parameters, and the names that no stage has."""
    known = requested.join(stages.select("stage", "params"), "stage")
    rows = known.where(F.size("params") > 0).select("stage", F.explode("params").alias("key", "value"))
    return rows, requested.join(stages.select("stage"), "stage", "left_anti")


def output_paths(targets: DataFrame, outs: DataFrame, kind: str) -> DataFrame:
    """(target, path) of outputs of a kind: those of a stage, or the path itself."""
    own = outs.where(F.col("kind") == kind)
    by_stage = targets.join(own, targets.target == own.stage).select("target", "path")
    by_path = targets.join(own.select("path").distinct(), targets.target == F.col("path")).join(by_stage.select("target"), "target", "left_anti").select("target", "path")
    return by_stage.union(by_path)


def restore_targets(targets: DataFrame, stages: DataFrame, tracked: DataFrame, files: DataFrame) -> DataFrame:
    """(target, source): stage, tracked or file, the first that knows it; null for none."""
    named = lambda df, column, name: df.select(F.col(column).alias("target"), F.lit(name).alias(name)).distinct()
    joined = targets.join(named(stages, "stage", "stage"), "target", "left").join(named(tracked, "path", "tracked"), "target", "left").join(named(files, "path", "file"), "target", "left")
    return joined.select("target", F.coalesce("stage", "tracked", "file").alias("source"))


def data_outputs(outs: DataFrame) -> DataFrame:
    """(stage, path): the last data output of each stage."""
    return outs.where("kind = 'data'").groupBy("stage").agg(F.max_by("path", "ordinal").alias("path"))
