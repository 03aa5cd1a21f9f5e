"""Writers of outputs: all are checked before the first is written, and each is written beside its place and then moved there, so it is whole or as it was."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.readers import FormatError, detect_format


def save_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV, JSON lines, or Parquet for other names; separators are kept."""
    kind = detect_format(path)
    if kind == "csv":
        _put(df, path, lambda to: df.write.option("header", True).option("sep", sep).csv(to))
    elif kind in ("json", "jsonl"):
        _put(df, path, df.write.json)
    else:
        _put(df, path, df.write.parquet)


def _put(df: DataFrame, path: str, write: Callable[[str], None]) -> None:
    """Write beside the path, then take away what is there and move the new table in its place."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    target, made = (jvm.org.apache.hadoop.fs.Path(p) for p in (path.rstrip("/"), beside))
    files = target.getFileSystem(conf)
    try:
        write(beside)
        files.delete(target, True)
        if not files.rename(made, target):
            raise OSError(f"{beside} can't be moved to {path}")
    except BaseException:
        files.delete(made, True)
        raise


def save_outputs(outputs: dict[str, DataFrame], paths: dict[str, str]) -> list[str]:
    """Write every named output; returns names that are given but not declared. A missing one raises KeyError before anything is written."""
    if missing := sorted(set(paths) - set(outputs)):
        raise KeyError(f"outputs {missing} are missing")
    for name, path in paths.items():
        save_table(outputs[name], path)
    return sorted(set(outputs) - set(paths))


def checked_keys(keys: Sequence[str]) -> list[str]:
    """Normal forms of the file names of a folder output. Raises FormatError for none, unsafe or clashing ones."""
    if not keys:
        raise FormatError("a folder output needs files")
    out, seen = [], set()
    for key in keys:
        name = unicodedata.normalize("NFC", key).replace("\\", "/")
        parts = name.split("/")
        if name.startswith("/") or ".." in parts or "" in parts:
            raise FormatError(f"bad file name {key!r}")
        if "." not in parts[-1].lstrip("."):
            raise FormatError(f"file name {key!r} has no suffix")
        if name.lower() in seen:
            raise FormatError(f"file name {key!r} clashes with another")
        seen.add(name.lower())
        out.append(name)
    return out


def clashing_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of a folder output that differ in case only."""
    return df.select(key).distinct().groupBy(F.lower(key).alias("lower_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def save_folder(df: DataFrame, path: str, key: str) -> None:
    """A folder output: one partition a key."""
    if not clashing_keys(df, key).isEmpty():
        raise FormatError(f"keys of {key!r} clash")
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def save_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines under the names of the sink."""
    from weftline.streaming.events import sink_events

    sink_events(events).write.mode("append").json(path)
