"""Objects of the content store: listing, and copying by hash with a result row for each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import cache_path, valid_hash
from weftline.operators.cache import cached_hashes, pull_set, push_set
from weftline.plans.workers import ensure_importable


def list_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of the objects in a store's folder; contents aren't read."""
    return cached_hashes(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path"))


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def copy_objects(hashes: DataFrame, source: str, target: str) -> DataFrame:
    """(hash, success, error) of copying each object between two stores; one that is there already isn't copied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (from_fs, from_root), (to_fs, to_root) = _place(source), _place(target)
        for batch in batches:
            errors: list[str | None] = []
            for path in batch.column(1).to_pylist():
                try:
                    if to_fs.get_file_info(f"{to_root}/{path}").type == pafs.FileType.NotFound:
                        to_fs.create_dir(f"{to_root}/{path[:2]}", recursive=True)
                        pafs.copy_files(f"{from_root}/{path}", f"{to_root}/{path}.part", source_filesystem=from_fs, destination_filesystem=to_fs)
                        to_fs.move(f"{to_root}/{path}.part", f"{to_root}/{path}")
                    errors.append(None)
                except OSError as error:
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e is None for e in errors]), pa.array(errors, pa.string())], ["hash", "success", "error"])

    ensure_importable(hashes.sparkSession)
    named = hashes.where(valid_hash(F.col("hash"))).select("hash", cache_path(F.col("hash")).alias("path")).distinct()
    return named.mapInArrow(run, "hash string, success boolean, error string")


def push(spark: SparkSession, local: str, remote: str) -> DataFrame:
    """Copy what the remote store lacks."""
    return copy_objects(push_set(list_objects(spark, local), list_objects(spark, remote)), local, remote)


def pull(spark: SparkSession, needed: DataFrame, local: str, remote: str) -> DataFrame:
    """Copy what is needed and isn't held locally."""
    return copy_objects(pull_set(needed, list_objects(spark, local)), remote, local)


def transfer_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("success").alias("n_copied"), F.count_if(~F.col("success")).alias("n_failed"))
