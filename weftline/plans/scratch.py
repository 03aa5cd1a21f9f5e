"""Scratch tables in the folder that every executor shares.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` and reading it back, so
a lost executor costs a re-read, never a recomputation of what came before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_created: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one in local mode only."""
    conf = spark.sparkContext.getConf()
    root = conf.get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return f"{root.rstrip('/')}/weftline/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses; removed when the session ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _created:
        _created[app] = []
        atexit.register(_release_all, spark, app)
    _created[app].append(path)
    return path


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_weftline_path", None)
        if path:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _release_all(spark: SparkSession, app: str) -> None:
    for path in _created.pop(app, []):
        try:
            _delete(spark, path)
        except Exception:  # the gateway may be gone when the interpreter exits
            return
