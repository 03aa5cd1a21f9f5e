"""Schemas of the catalogue tables that describe stages, their inputs and outputs, runs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "array<struct<relpath: string, hash: string, size: bigint, isexec: boolean>>"
HASHED = f"array<struct<path: string, hash: string, manifest: {MANIFEST}>>"

SCHEMAS: dict[str, str] = {
    "stages": "name string, variant string, mutex array<string>, deps array<string>, outs array<struct<path: string, kind: string, cached: boolean, incremental: boolean>>, fingerprint map<string, string>, params string",
    "edges": "src string, src_type string, dst string, dst_type string",
    "locks": f"stage string, schema_version int, code_manifest map<string, string>, params string, deps {HASHED}, outs {HASHED}",
    "tracked": f"path string, hash string, size bigint, num_files int, manifest {MANIFEST}",
    "files": f"path string, hash string, size bigint, mtime_ns bigint, inode bigint, manifest {MANIFEST}",
    "generations": "path string, gen bigint",
    "dep_generations": "stage string, path string, gen bigint",
    "run_cache": f"stage string, input_hash string, run_id string, output_hashes {HASHED}",
    "runs": "run_id string, started_at string, ended_at string, targeted array<string>, execution_order array<string>, stages map<string, struct<input_hash: string, status: string, reason: string, duration_ms: bigint>>",
    "remote_index": "remote string, hash string",
    "events": "type string, seq bigint, ts timestamp, stage string, path string, status string, reason string, state string, line string, duration_ms double",
}

#: Columns without which a lock record counts as missing.
REQUIRED_IN_LOCK = ("code_manifest", "params", "deps", "outs")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty catalogue table, as a first run finds it."""
    return spark.createDataFrame([], SCHEMAS[name])


def valid_locks(locks: DataFrame) -> DataFrame:
    """Locks with all that is required; a damaged one counts as missing, further columns don't matter."""
    whole = F.col("stage").isNotNull()
    for column in REQUIRED_IN_LOCK:
        whole = whole & F.col(column).isNotNull()
    return locks.where(whole)


def parse_locks(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Lock records from JSON text; text that doesn't parse, or lacks something required, gives no row."""
    return valid_locks(rows.select(F.from_json(text_col, SCHEMAS["locks"]).alias("lock")).select("lock.*"))


def lock_entries(locks: DataFrame, column: str) -> DataFrame:
    """(stage, path, hash, manifest) of the locks' ``deps`` or ``outs``."""
    return locks.select("stage", F.explode(column).alias("e")).select("stage", "e.path", "e.hash", "e.manifest")
