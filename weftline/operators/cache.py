"""Content hashes, the content-addressed cache, and set operations between local, cached and remote objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import cache_path, valid_hash


def content_hash(content: Column) -> Column:
    """A 16-digit hash of the content; equal content, equal hash."""
    return F.left(F.sha2(content, 256), F.lit(16))


def with_content_hash(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path and hash of (path, content, size, mtime_ns, inode) rows; a remembered hash is used while size, time and inode are the same."""
    hashed = F.when(F.col("content").isNotNull(), content_hash(F.col("content")))
    if known is None:
        return files.select("path", hashed.alias("hash"))
    return remembered(files, known).select("path", F.coalesce("known_hash", hashed).alias("hash"))


def remembered(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files with ``known_hash``, null if nothing is remembered or a file's size, time or inode changed."""
    k = known.select("path", "size", "mtime_ns", "inode", F.col("hash").alias("known_hash"))
    return files.join(k, ["path", "size", "mtime_ns", "inode"], "left")


def tree_hash(files: DataFrame, group: str) -> DataFrame:
    """group, hash, n_files and size of each folder: the hash of its files' (relpath, hash) in path order."""
    line = F.concat_ws(":", "relpath", "hash")
    return files.groupBy(group).agg(
        F.left(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relpath", line.alias("line")))), lambda e: e["line"]), "\n"), 256), F.lit(16)).alias("hash"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("size").alias("size"),
    )


def dependency_hashes(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(stage, path, hash, status): ok, missing without a file, unreadable for a file without a hash."""
    joined = deps.join(files.select("path", "hash", F.lit(True).alias("there")), "path", "left")
    status = F.when(F.col("there").isNull(), "missing").when(F.col("hash").isNull(), "unreadable").otherwise("ok")
    return joined.select("stage", "path", "hash", status.alias("status"))


def blob_hashes(records: DataFrame) -> DataFrame:
    """Hashes of the objects of (.., hash, manifest) records: of a folder those of its files."""
    entries = F.when(F.col("manifest").isNotNull(), F.transform("manifest", lambda m: F.struct(m["relpath"].alias("relpath"), m["hash"].alias("blob")))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("relpath"), F.col("hash").alias("blob"))))
    return records.withColumn("entry", F.explode(entries)).select(*[c for c in records.columns if c not in ("hash", "manifest")], "entry.relpath", F.col("entry.blob").alias("hash")).where(F.col("hash").isNotNull())


def new_objects(candidates: DataFrame, cached: DataFrame) -> DataFrame:
    """One row for each hash that the cache doesn't hold yet."""
    return candidates.join(cached.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def cached_hashes(listing: DataFrame) -> DataFrame:
    """Hashes that a listing of cache files (path ending in XX/rest) stands for."""
    parts = F.split("path", "/")
    joined = F.concat(F.element_at(parts, -2), F.element_at(parts, -1))
    return listing.where(F.size(parts) >= 2).select(joined.alias("hash")).where(valid_hash(F.col("hash"))).distinct()


def shard_counts(hashes: DataFrame) -> DataFrame:
    """Objects by the two digits of their cache folder."""
    return hashes.where(valid_hash(F.col("hash"))).groupBy(F.left("hash", F.lit(2)).alias("shard")).agg(F.count(F.lit(1)).alias("n_objects"), F.min(cache_path(F.col("hash"))).alias("first_path"))


def sync_status(local: DataFrame, index: DataFrame, remote: DataFrame) -> DataFrame:
    """Local hashes as common (in the remote's index, or found there) or local_only."""
    known = index.select("hash").union(remote.select("hash")).distinct().withColumn("there", F.lit(True))
    return local.select("hash").distinct().join(known, "hash", "left").select("hash", F.when(F.col("there"), "common").otherwise("local_only").alias("state"))


def push_set(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.select("hash").distinct().join(remote.select("hash"), "hash", "left_anti")


def pull_set(needed: DataFrame, local: DataFrame) -> DataFrame:
    return needed.select("hash").distinct().join(local.select("hash"), "hash", "left_anti")


def exists_by_shard(wanted: DataFrame, remote: DataFrame) -> DataFrame:
    """hash and whether the remote has it, looked up shard by shard."""
    w = wanted.select("hash").distinct().withColumn("shard", F.left("hash", F.lit(2)))
    r = remote.select("hash").distinct().withColumn("shard", F.left("hash", F.lit(2))).withColumn("found", F.lit(True))
    return w.join(r, ["shard", "hash"], "left").select("hash", F.coalesce("found", F.lit(False)).alias("found"))


def index_add(index: DataFrame, remote: str, hashes: DataFrame) -> DataFrame:
    return index.union(hashes.select(F.lit(remote).alias("remote"), "hash")).distinct()


def index_remove(index: DataFrame, remote: str, hashes: DataFrame) -> DataFrame:
    return index.join(hashes.select(F.lit(remote).alias("remote"), "hash"), ["remote", "hash"], "left_anti")


def index_clear(index: DataFrame, remote: str) -> DataFrame:
    return index.where(F.col("remote") != remote)


def target_hashes(targets: DataFrame, outs: DataFrame, tracked: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """Hashes that the targets stand for: a stage's cached outputs (and inputs if given), else a tracked path, else one output path."""
    wanted = targets.select("target").distinct()
    by_stage = wanted.join(outs.where("cached"), wanted.target == outs.stage).select("target", "hash", "manifest")
    if deps is not None:
        by_stage = by_stage.union(wanted.join(deps, wanted.target == deps.stage).select("target", "hash", "manifest"))
    rest = wanted.join(by_stage.select("target"), "target", "left_anti")
    by_track = rest.join(tracked, rest.target == tracked.path).select("target", "hash", "manifest")
    rest = rest.join(by_track.select("target"), "target", "left_anti")
    by_path = rest.join(outs, rest.target == outs.path).select("target", "hash", "manifest")
    return blob_hashes(by_stage.union(by_track).union(by_path)).select("hash").distinct()


def deduped_targets(targets: DataFrame, normal: Column, position: str = "position") -> DataFrame:
    """The first target of each normal path."""
    return targets.groupBy(normal.alias("path")).agg(F.min_by("target", position).alias("target"))


def checkout_plan(wanted: DataFrame, files: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """path and result: skipped if the file is right, or there and not to be overwritten; restored from the cache, or missing."""
    joined = wanted.join(files.select("path", F.col("hash").alias("now"), F.lit(True).alias("there")), "path", "left").join(cached.select("hash", F.lit(True).alias("in_cache")), "hash", "left")
    right = F.coalesce(F.col("now") == F.col("hash"), F.lit(False))
    result = F.when(right, "skipped").when(F.col("there") & ~F.lit(force), "skipped").when(F.col("in_cache"), "restored").otherwise("missing")
    return joined.select("path", "hash", result.alias("result"))


def checkout_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


def restore_source(wanted: DataFrame, cached: DataFrame, snapshot: DataFrame, remote: DataFrame) -> DataFrame:
    """path and where its content comes from: cache, snapshot or remote; null from nowhere."""
    joined = wanted.join(cached.select("hash", F.lit("cache").alias("c")), "hash", "left").join(snapshot.select("hash", F.lit("snapshot").alias("s")), "hash", "left").join(remote.select("hash", F.lit("remote").alias("r")), "hash", "left")
    return joined.select("path", "hash", F.coalesce("c", "s", "r").alias("source"))


def restorable(outs: DataFrame, cached: DataFrame) -> DataFrame:
    """stage and whether every object of its outputs is in the cache: restoring is all or nothing."""
    blobs = blob_hashes(outs).join(cached.select("hash", F.lit(True).alias("there")), "hash", "left")
    return blobs.groupBy("stage").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("restorable"))


def needs_restore(outs: DataFrame, files: DataFrame) -> DataFrame:
    """path and whether its file is gone or another than the recorded one."""
    joined = outs.join(files.select("path", F.col("hash").alias("now")), "path", "left")
    return joined.select("path", (~F.coalesce(F.col("now") == F.col("hash"), F.lit(False))).alias("needs_restore"))


def file_hash_lookup(paths: DataFrame, outs: DataFrame, tracked: DataFrame) -> DataFrame:
    """path and hash: of the first stage that has it as an output, else as tracked."""
    first = outs.groupBy("path").agg(F.min_by("hash", "stage").alias("stage_hash"))
    return paths.join(first, "path", "left").join(tracked.select("path", F.col("hash").alias("tracked_hash")), "path", "left").select("path", F.coalesce("stage_hash", "tracked_hash").alias("hash"))


def folder_sizes(tracked: DataFrame) -> DataFrame:
    """path, size and number of files of tracked paths, from the manifest where there is one."""
    size = F.coalesce(F.aggregate("manifest", F.lit(0).cast("bigint"), lambda a, m: a + m["size"]), F.col("size"))
    return tracked.select("path", size.alias("size"), F.coalesce(F.size("manifest"), F.lit(1)).alias("n_files"))
