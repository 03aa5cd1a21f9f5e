"""Differences of two snapshots: rows, schemas, hashes, metrics, parameters and records.

All are configurations of one builder, ``outer_diff``: a null-safe full outer join with
presence flags, so that a value that is null is told from a row that isn't there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import NUMERIC, delta, key_json, nan_to_null, same_value
from weftline.plans.scratch import materialize

ADDED, REMOVED, MODIFIED = "added", "removed", "modified"
MAX_ROWS = 10_000

Equal = Callable[[Column, Column], Column]


class DuplicateKeyError(ValueError):
    """A key occurs more than once on one side."""


def outer_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], same: Column, keep_unchanged: bool = False) -> DataFrame:
    """Keys, ``old`` and ``new`` (structs of the other columns, null if absent) and ``change_type``.

    ``same`` is over columns of the structs, as ``F.col("old.x")``. Null keys equal each other.
    """
    left = old.select(*[F.col(k).alias(f"old_{k}") for k in keys], F.struct(F.lit(1).alias("there"), *[c for c in old.columns if c not in keys]).alias("old"))
    right = new.select(*[F.col(k).alias(f"new_{k}") for k in keys], F.struct(F.lit(1).alias("there"), *[c for c in new.columns if c not in keys]).alias("new"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}"))
    joined = left.join(right, match, "full_outer")
    kind = F.when(F.col("old").isNull(), ADDED).when(F.col("new").isNull(), REMOVED).when(~same, MODIFIED)
    out = joined.select(*[F.when(F.col("new").isNotNull(), F.col(f"new_{k}")).otherwise(F.col(f"old_{k}")).alias(k) for k in keys], "old", "new", kind.alias("change_type"))
    return out if keep_unchanged else out.where(F.col("change_type").isNotNull())


def common_columns(old: DataFrame, new: DataFrame) -> list[str]:
    """Columns of both, in the order of the old."""
    return [c for c in old.columns if c in new.columns]


def _rows_same(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & same_value(F.col(f"old.{c}"), old.schema[c].dataType, F.col(f"new.{c}"), new.schema[c].dataType)
    return same


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def diff_rows_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Rows added, removed or modified by key: keys, ``key`` (JSON text), change_type, old and new values of the common columns.

    Only common columns are compared, so a new column modifies no row. With ``check``, a key
    that occurs twice on one side raises DuplicateKeyError; without, each of its rows is
    compared with each row of the key on the other side.
    """
    if check:
        for side, df in (("old", old), ("new", new)):
            if found := duplicate_keys(df, keys).first():
                raise DuplicateKeyError(f"duplicate key {[found[k] for k in keys]} in {side} rows")
    common = [c for c in common_columns(old, new) if c not in keys]
    found = outer_diff(old.select(*keys, *common), new.select(*keys, *common), keys, _rows_same(old, new, common))
    return found.select(*keys, key_json(*[F.col(k) for k in keys]).alias("key"), "change_type", *_values(common))


def _values(columns: Sequence[str]) -> list[Column]:
    return [F.when(F.col(side).isNotNull(), F.struct(*[F.col(f"{side}.{c}") for c in columns])).alias(f"{side}_values") for side in ("old", "new") if columns]


def _row_hash(df: DataFrame) -> Column:
    hashed = [f.name for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in hashed])


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """The 0-based place of every row in the given order, numbered range by range of the order; equal ones by a hash of the row, so that they can be split too."""
    order = [*order, _row_hash(df)]
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = materialize(ranged, "positions")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))  # a row a partition
    within = Window.partitionBy("_part").orderBy(*order)
    return placed.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.row_number().over(within) - 1).drop("_part", "_base")


def diff_rows_positional(old: DataFrame, new: DataFrame, order: Sequence[str | Column], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows compared by their place in ``order``, which rows of a table don't have by themselves; ``order`` can name columns beside the compared ones (all common ones by default)."""
    common = common_columns(old, new) if columns is None else list(columns)
    left, right = (with_position(df, order).select("position", *common) for df in (old, new))
    found = outer_diff(left, right, ["position"], _rows_same(old, new, common))
    return found.select("position", "change_type", *_values(common))


def truncated(changes: DataFrame, rows: int = MAX_ROWS, order: str = "key") -> DataFrame:
    """The first changes by key text, those of one key by a hash of the row."""
    return changes.orderBy(order, _row_hash(changes)).limit(rows)


def is_truncated(old: DataFrame, new: DataFrame, changes: DataFrame, keys: Sequence[str], rows: int = MAX_ROWS) -> bool:
    """Whether any key, changed or not, comes after the last change that is shown."""
    shown = truncated(changes, rows).agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last")).first()
    if shown["n"] < rows:
        return False
    every = old.select(*keys).union(new.select(*keys)).select(key_json(*[F.col(k) for k in keys]).alias("key"))
    return not every.where(F.col("key") > shown["last"]).isEmpty()


def diff_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or of another type, by name."""
    spark = old.sparkSession
    kind = "column string, dtype string"
    sides = [spark.createDataFrame(df.dtypes, kind) for df in (old, new)]
    found = outer_diff(*sides, ["column"], F.col("old.dtype") == F.col("new.dtype"))
    return found.select("column", F.col("old.dtype").alias("old_dtype"), F.col("new.dtype").alias("new_dtype"), "change_type").orderBy("column")


def reorder_only(old: DataFrame, new: DataFrame) -> bool:
    """Whether both hold the same rows, as often, under the same columns and types in the same order."""
    if old.dtypes != new.dtypes:
        return False
    return old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()


def diff_tables(old: DataFrame | None, new: DataFrame | None, keys: Sequence[str] | None = None, order: Sequence[str] | None = None, rows: int = MAX_ROWS, summary_only: bool = False) -> dict:
    """The whole comparison of two tables: which of them are there, schema changes, whether only the order differs, and row changes."""
    if old is None or new is None:
        kind = ADDED if old is None else REMOVED
        return {"change_type": kind, "summary_only": True, "schema": None, "reorder_only": False, "rows": None, "truncated": False}
    missing = [k for k in keys or [] if k not in old.columns or k not in new.columns]
    if missing:
        raise ValueError(f"key columns {missing} aren't in both tables")
    out = {"change_type": MODIFIED, "summary_only": summary_only, "schema": diff_schema(old, new), "reorder_only": False, "rows": None, "truncated": False}
    if summary_only:
        return out
    if not keys and reorder_only(old, new):
        return out | {"reorder_only": True}
    if keys:
        changes = materialize(diff_rows_by_key(old, new, keys), "changes")
        return out | {"rows": truncated(changes, rows), "truncated": is_truncated(old, new, changes, keys, rows)}
    if not order:
        raise ValueError("rows have no order of their own: name key columns or an order")
    changes = materialize(diff_rows_positional(old, new, order), "changes")
    return out | {"rows": truncated(changes, rows, "position"), "truncated": changes.count() > rows}


def summarise(changes: DataFrame) -> DataFrame:
    """Numbers of rows added, removed and modified."""
    return changes.agg(*[F.count_if(F.col("change_type") == kind).alias(f"n_{kind}") for kind in (ADDED, REMOVED, MODIFIED)])


def diff_hashes(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """Changes of path hashes; a null hash means that there is no file."""
    sides = [df.where(F.col(value).isNotNull()).select(key, value) for df in (old, new)]
    found = outer_diff(*sides, [key], F.col(f"old.{value}") == F.col(f"new.{value}"))
    return found.select(key, F.col(f"old.{value}").alias("old_hash"), F.col(f"new.{value}").alias("new_hash"), "change_type")


def diff_two_level(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str, same: Equal | None = None) -> DataFrame:
    """Changes of a value by two keys; a key with a null value is there."""
    kinds = old.schema[value].dataType, new.schema[value].dataType
    equal = same(F.col(f"old.{value}"), F.col(f"new.{value}")) if same else same_value(F.col(f"old.{value}"), kinds[0], F.col(f"new.{value}"), kinds[1])
    found = outer_diff(old.select(*keys, value), new.select(*keys, value), keys, equal)
    return found.select(*keys, F.col(f"old.{value}").alias("old"), F.col(f"new.{value}").alias("new"), "change_type")


def diff_metrics(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("path", "key"), value: str = "value") -> DataFrame:
    """Metric changes with their delta where both are numbers."""
    found = diff_two_level(old, new, keys, value)
    numeric = all(isinstance(df.schema[value].dataType, NUMERIC) for df in (old, new))
    return found.withColumn("delta", delta(F.col("old"), F.col("new")) if numeric else F.lit(None).cast("double"))


def diff_params(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("stage", "key"), value: str = "value_json") -> DataFrame:
    """Parameter changes; values are equal if their JSON texts are, so 1 and 1.0 differ."""
    return diff_two_level(old, new, keys, value, same=lambda a, b: a.eqNullSafe(b))


def diff_maps(old: Column, new: Column) -> Column:
    """Changes between two string maps, as an array of (key, old, new, change_type) by key."""
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))

    def change(k: Column) -> Column:
        kind = F.when(~F.map_contains_key(old, k), ADDED).when(~F.map_contains_key(new, k), REMOVED).when(~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)), MODIFIED)
        return F.struct(k.alias("key"), F.try_element_at(old, k).alias("old"), F.try_element_at(new, k).alias("new"), kind.alias("change_type"))

    return F.filter(F.transform(keys, change), lambda c: c["change_type"].isNotNull())


def diff_code(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of code manifests: (stage, key, old, new, change_type) of (stage, code_manifest) rows."""
    sides = [df.select("stage", F.explode("code_manifest").alias("key", "hash")) for df in (old, new)]
    return diff_two_level(*sides, ["stage", "key"], "hash")


def diff_deps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of dependency records (stage, path, hash, manifest); a manifest that differs is a change though the hashes are equal."""
    sides = [df.select("stage", "path", F.struct("hash", "manifest").alias("record")) for df in (old, new)]
    found = outer_diff(*sides, ["stage", "path"], F.to_json("old.record") == F.to_json("new.record"))
    return found.select("stage", "path", F.col("old.record.hash").alias("old_hash"), F.col("new.record.hash").alias("new_hash"), "change_type")


def output_changes(declared: DataFrame, locked: DataFrame, current: DataFrame) -> DataFrame:
    """Every declared output (stage, path, kind) with its locked and current hash, and the change, null if there is none."""
    joined = declared.join(locked.select("stage", "path", F.col("hash").alias("old_hash")), ["stage", "path"], "left").join(current.select("path", F.col("hash").alias("new_hash")), "path", "left")
    kind = (
        F.when(F.col("old_hash").isNull() & F.col("new_hash").isNotNull(), ADDED)
        .when(F.col("old_hash").isNotNull() & F.col("new_hash").isNull(), REMOVED)
        .when(F.col("old_hash") != F.col("new_hash"), MODIFIED)
    )
    return joined.select("stage", "path", "kind", "old_hash", "new_hash", kind.alias("change_type"))


def diff_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stages added, removed or modified between (stage, fingerprint) tables; a fingerprint that couldn't be made (null) counts as modified."""
    found = outer_diff(old.select("stage", "fingerprint"), new.select("stage", "fingerprint"), ["stage"], F.coalesce(F.col("old.fingerprint") == F.col("new.fingerprint"), F.lit(False)))
    return found.select("stage", "change_type")


def hashes_at(snapshots: DataFrame, declared: DataFrame, at: str) -> DataFrame:
    """(path, hash) of declared outputs in the snapshot ``at``; null where it has none."""
    there = snapshots.where(F.col("snapshot") == at).select("path", "hash")
    return declared.select("path").distinct().join(there, "path", "left")


def conflicting_hashes(rows: DataFrame) -> DataFrame:
    """Paths with more than one hash in one snapshot, which is an error."""
    return rows.where(F.col("hash").isNotNull()).groupBy("path").agg(F.countDistinct("hash").alias("n_hashes")).where("n_hashes > 1")


def metric_values_at(paths: DataFrame, cached: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, content) from the cache by hash, else from the snapshot by path."""
    by_hash = paths.join(cached.select("hash", F.col("content").alias("cached")), "hash", "left")
    return by_hash.join(snapshot.select("path", F.col("content").alias("stored")), "path", "left").select("path", F.coalesce("cached", "stored").alias("content"))


def changed_files(old: DataFrame, new: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The files worth comparing row by row: declared or targeted ones whose hash differs."""
    found = diff_hashes(old, new)
    return found if targets is None else found.join(targets.select("path").distinct(), "path", "left_semi")


def clean_rows(df: DataFrame) -> DataFrame:
    """The table with NaN as null."""
    return df.select(*[nan_to_null(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])
