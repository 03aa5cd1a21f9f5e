"""Tables about what is registered: overrides, indexes, listings and checks of definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that the key of a stored syntax-tree hash may have.
LONGEST_KEY = 511


def overridden_outputs(outs: DataFrame, overrides: DataFrame) -> DataFrame:
    """(stage, name, path, kind, cached, problem): outputs with the path and cache flag of their override, where these are given; a folder must stay one."""
    given = overrides.select("stage", "name", F.col("path").alias("new_path"), F.col("cached").alias("new_cached"))
    joined = outs.join(given, ["stage", "name"], "left")
    problem = F.when(F.col("path").endswith("/") & ~F.col("new_path").endswith("/"), F.concat(F.lit("a folder output needs a path that ends in /: "), "new_path"))
    return joined.select("stage", "name", F.coalesce("new_path", "path").alias("path"), "kind", F.coalesce("new_cached", "cached").alias("cached"), problem.alias("problem"))


def section_problems(sections: DataFrame, outs: DataFrame) -> DataFrame:
    """(stage, name, section, problem) of the outputs named in sections for a kind (outs, metrics, plots): not there, of another kind, or named in two."""
    kinds = F.when(F.col("section") == "metrics", "metric").when(F.col("section") == "plots", "plot")
    twice = sections.groupBy("stage", "name").agg(F.count(F.lit(1)).alias("times"))
    joined = sections.join(outs.select("stage", "name", "kind"), ["stage", "name"], "left").join(twice, ["stage", "name"])
    problem = F.when(F.col("kind").isNull(), "unknown output").when(kinds.isNotNull() & (F.col("kind") != kinds), "output of another kind").when(F.col("times") > 1, "named in two sections")
    return joined.select("stage", "name", "section", problem.alias("problem")).where("problem is not null")


def output_index(outs: DataFrame, folders: DataFrame, root: str) -> DataFrame:
    """(path, pipeline): for each output below the root, by its path from there, the folder of the pipeline that makes it."""
    inside = root.rstrip("/") + "/"
    known = outs.where(F.col("path").startswith(inside)).join(folders.where("folder is not null"), "stage")
    return known.select(F.substring("path", len(inside) + 1, 1 << 30).alias("path"), F.col("folder").alias("pipeline")).distinct()


def pending_stages(listing: DataFrame, folder: str) -> DataFrame:
    """Names of stages with a lock record that isn't committed, from the paths below the folder of such records, in order."""
    inside = folder.rstrip("/") + "/"
    locks = listing.where(F.col("path").startswith(inside) & F.col("path").endswith(".lock"))
    return locks.select(F.regexp_replace(F.substring("path", len(inside) + 1, 1 << 30), r"\.lock$", "").alias("stage")).distinct().orderBy("stage")


def syntax_key(path: Column, qualname: Column) -> Column:
    """Where the hash of a function's syntax tree is stored; null if it can't be a key."""
    key = F.concat_ws("\x1f", path, qualname)
    good = (F.octet_length(key) <= LONGEST_KEY) & ~key.contains("\x00") & (path != "") & (qualname != "")
    return F.when(good, key)


def saved_syntax_hashes(known: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, mtime_ns, size, inode, qualname, hash) with the new entries over the known ones; entries that can't be stored are left out."""
    names = ["path", "mtime_ns", "size", "inode", "qualname"]
    good = entries.where(syntax_key(F.col("path"), F.col("qualname")).isNotNull())
    both = known.select(*names, "hash", F.lit(0).alias("turn")).union(good.select(*names, "hash", F.lit(1).alias("turn")))
    return both.groupBy(*names).agg(F.max_by("hash", F.struct("turn", "hash")).alias("hash"))


def stage_listing(stages: DataFrame) -> DataFrame:
    """(name, json): each stage as JSON text with its deps, outs, mutexes and variant, as a listing has it."""
    paths = F.transform("outs", lambda o: o["path"]).alias("outs")
    return stages.select("name", F.to_json(F.struct("name", "deps", paths, "mutex", F.when(F.col("variant") != "", F.col("variant")).alias("variant"))).alias("json"))


def metrics_by_path(metrics: DataFrame) -> DataFrame:
    """(path, key, value) of all stages' metric files (stage, ordinal, path, key, value); of a path that two stages write, what the later one says."""
    last = metrics.groupBy("path").agg(F.max("ordinal").alias("ordinal"))
    return metrics.join(last, ["path", "ordinal"], "left_semi").select("path", "key", "value")


def stage_metrics(outs: DataFrame, contents: DataFrame) -> DataFrame:
    """(stage, path, content) of the metric outputs whose file is there."""
    return outs.where("kind = 'metric'").join(contents.select("path", "content"), "path").select("stage", "path", "content")


def needs_full_definitions(config: DataFrame) -> DataFrame:
    """One row: whether any entry (stage, kind, has_variants) of a definition has variants, or the entries aren't mappings at all."""
    return config.agg(F.coalesce(F.bool_or(F.col("has_variants") | (F.col("kind") == "malformed")), F.lit(False)).alias("fallback"))


def dimension_keys(config: DataFrame) -> DataFrame:
    """(dimension, ordinal, value) of dimensions given as JSON lists or mappings; of mappings the keys."""
    values = F.when(F.ltrim("spec").startswith("{"), F.json_object_keys("spec")).otherwise(F.from_json("spec", "array<string>"))
    return config.select("dimension", F.posexplode(values).alias("ordinal", "value"))


def with_entries(samples: DataFrame, entries: DataFrame) -> DataFrame:
    """Timing samples (name, duration_ms) with those that a worker sent."""
    return samples.unionByName(entries.select("name", "duration_ms"))


def counted(names: DataFrame) -> DataFrame:
    """Samples that only count: a duration of 0 for each row."""
    return names.select("name", F.lit(0.0).alias("duration_ms"))
