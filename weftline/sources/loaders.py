"""Extension points of sources and sinks: readers, writers and loaders of a stage's inputs and outputs.

A loader is a frozen dataclass, so its settings are its fields; both these and the code of
its methods are part of the fingerprint of a stage that uses it.
"""

from __future__ import annotations

import abc
import dataclasses

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.readers import read_object, read_table, read_text
from weftline.sources.writers import save_table


class LoadError(RuntimeError):
    """An input that can't be read."""


@dataclasses.dataclass(frozen=True)
class Reader(abc.ABC):
    """Reads a path."""

    @abc.abstractmethod
    def load(self, spark: SparkSession, path: str):
        """What the path holds."""


@dataclasses.dataclass(frozen=True)
class Writer(abc.ABC):
    """Writes a path."""

    @abc.abstractmethod
    def save(self, data, path: str) -> None:
        """Put the data at the path, as a whole or not at all."""


@dataclasses.dataclass(frozen=True)
class Loader(Writer, Reader):
    """Reads and writes; ``empty`` is what an incremental output holds before its first run."""

    def empty(self, spark: SparkSession):
        raise LoadError(f"{type(self).__name__} has no empty value")


@dataclasses.dataclass(frozen=True)
class Table(Loader):
    """CSV, JSON, JSON lines or Parquet by the suffix; an empty one needs a schema."""

    schema: str | None = None
    sep: str = ","

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        if path.rstrip("/").endswith(".parquet"):
            return spark.read.parquet(path)
        return read_table(spark, path, self.schema, self.sep)

    def save(self, data: DataFrame, path: str) -> None:
        save_table(data, path, self.sep)

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema) if self.schema else super().empty(spark)


@dataclasses.dataclass(frozen=True)
class Document(Reader):
    """The value of a JSON or YAML document."""

    def load(self, spark: SparkSession, path: str):
        return read_object(spark, path)


@dataclasses.dataclass(frozen=True)
class Text(Reader):
    def load(self, spark: SparkSession, path: str) -> str:
        return read_text(spark, path)


@dataclasses.dataclass(frozen=True)
class Path(Reader):
    """The path itself, for code that reads it in a way of its own."""

    def load(self, spark: SparkSession, path: str) -> str:
        return path


@dataclasses.dataclass(frozen=True)
class Dep:
    """An input: where it is, how it is read, and whether it is the stage's own output of the run before."""

    path: str | tuple[str, ...]
    reader: Reader = Table()
    incremental: bool = False


def load_dependency(spark: SparkSession, name: str, dep: Dep):
    """What an input holds; several paths give a list. An incremental one that isn't there yet is empty."""

    def one(path: str):
        if dep.incremental and not exists(spark, path):
            if not isinstance(dep.reader, Loader):
                raise LoadError(f"input {name!r} is incremental, but {type(dep.reader).__name__} isn't a loader")
            return dep.reader.empty(spark)
        try:
            return dep.reader.load(spark, path)
        except Exception as error:
            raise LoadError(f"input {name!r} can't be read from {path!r}: {error}") from error

    return one(dep.path) if isinstance(dep.path, str) else [one(p) for p in dep.path]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at the path, on whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def loader_fingerprint(loader: Reader | Writer) -> dict[str, str]:
    """Hashes of the methods that the loader's class has, and of its settings; ``empty`` counts if a class of the user's has one."""
    from weftline.operators.runtime import code_hash, value_hash

    kind, out = type(loader).__name__, {}
    if isinstance(loader, Writer):
        out[f"loader:{kind}:save"] = code_hash(type(loader).save)
    if isinstance(loader, Reader):
        out[f"loader:{kind}:load"] = code_hash(type(loader).load)
    if isinstance(loader, Loader) and type(loader).empty is not Loader.empty:
        out[f"loader:{kind}:empty"] = code_hash(type(loader).empty)
    if settings := [(f.name, getattr(loader, f.name)) for f in dataclasses.fields(loader)]:
        out[f"loader:{kind}:config"] = value_hash(settings)
    return out
