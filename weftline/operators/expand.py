"""Stage matrices, placeholders and layered parameters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import stage_base
from weftline.plans.scratch import materialize


def expand_matrix(dimensions: dict[str, DataFrame], base: str, template: str | None = None) -> DataFrame | None:
    """One row for each combination of the dimensions' ``value``: a column a dimension, and ``stage``.

    The name is ``base@a_b`` in the order of the dimensions, or follows the template
    (``{dimension}``); for a template that names something else the result is None, and names
    have to come from the full definitions. No dimension, or an empty one, gives no rows.
    """
    if not dimensions:
        return SparkSession.active().createDataFrame([], "stage string")
    if template is not None and set(named_in(template)) - set(dimensions):
        return None
    combined = reduce(lambda a, b: a.crossJoin(b), [df.select(F.col("value").cast("string").alias(name)) for name, df in dimensions.items()])
    if template is None:
        variant = F.concat_ws("_", *dimensions)
    else:
        variant = reduce(lambda text, name: F.replace(text, F.lit("{" + name + "}"), F.col(name)), dimensions, F.lit(template))
    return combined.withColumn("stage", F.concat(F.lit(base + "@"), variant))


def named_in(template: str) -> list[str]:
    """Names in braces."""
    return re.findall(r"\{(\w*)\}", template)


def split_template(name: str) -> tuple[str, str | None]:
    """Base name and template of a stage name; no template without ``@``."""
    base, at, template = name.partition("@")
    return base, template if at else None


def check_template(template: str, dimensions: Sequence[str], every: bool = True) -> None:
    """Raise ValueError if the template names an unknown dimension, or leaves one out where every one is needed."""
    named = set(named_in(template))
    if extra := named - set(dimensions):
        raise ValueError(f"unknown dimensions {sorted(extra)}")
    if every and (left := set(dimensions) - named):
        raise ValueError(f"dimensions {sorted(left)} aren't in the name")


def dimension_values(spark: SparkSession, spec: dict[str, list | dict]) -> DataFrame:
    """(dimension, ordinal, value, type, overrides) of dimensions given as lists or as mappings of value to overrides."""
    rows = []
    for name, values in spec.items():
        for k, value in enumerate(values):
            overrides = values[value] if isinstance(values, dict) else None
            rows.append((name, k, str(value).lower() if isinstance(value, bool) else str(value), type(value).__name__, {str(a): str(b) for a, b in (overrides or {}).items()}))
    return spark.createDataFrame(rows, "dimension string, ordinal int, value string, type string, overrides map<string, string>")


def merged_maps(*maps: Column) -> Column:
    """One map in which later maps win."""
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), maps)


def with_overrides(base: Column, *overrides: Column) -> Column:
    """Maps of the base with the overrides of each dimension in turn, null ones aside."""
    nothing = F.create_map().cast("map<string,string>")
    return merged_maps(F.coalesce(base, nothing), *[F.coalesce(o, nothing) for o in overrides])


def deep_merge(layers: DataFrame, keys: Sequence[str] = ("key",), priority: str = "priority") -> DataFrame:
    """The value of the highest layer for each dotted key of (.., key, value, priority) rows.

    A key that a higher layer holds as a whole (``a``) hides lower keys inside it (``a.b``),
    and a key inside hides a lower whole.
    """
    best = layers.groupBy(*keys).agg(F.max_by("value", priority).alias("value"), F.max(priority).alias("priority"))
    own = [k for k in keys if k != "key"]
    parts = F.split("key", r"\.")
    around = best.select(*own, "key", "priority", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ".")), lambda p: p != F.col("key"))).alias("whole"))
    wholes = best.select(*own, F.col("key").alias("whole"), F.col("priority").alias("whole_priority"))
    pairs = around.join(wholes, [*own, "whole"])
    hidden_inside = pairs.where("whole_priority > priority").select(*own, "key").distinct()
    hidden_whole = pairs.where("whole_priority < priority").select(*own, F.col("whole").alias("key")).distinct()
    return best.join(hidden_inside.union(hidden_whole), list(keys), "left_anti").select(*keys, "value")


def effective_params(stages: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(stage, key, value): defaults of a stage, overridden by those for its base name, then for the exact variant."""
    layers = defaults.select("stage", "key", "value", F.lit(0).alias("priority"))
    named = stages.select("stage", stage_base(F.col("stage")).alias("base"))
    for_base = named.where("stage <> base").join(overrides, named.base == overrides.target).select("stage", "key", "value", F.lit(1).alias("priority"))
    exact = named.join(overrides, named.stage == overrides.target).select("stage", "key", "value", F.lit(2).alias("priority"))
    return deep_merge(layers.union(for_base).union(exact), ["stage", "key"])


def flattened(df: DataFrame, sep: str = ".") -> DataFrame:
    """A column for each leaf of nested structs, named by its path; arrays are leaves."""
    from pyspark.sql import types as T

    def leaves(kind: T.StructType, prefix: list[str]) -> list[Column]:
        out = []
        for f in kind:
            path = [*prefix, f.name]
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, path)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)))
        return out

    return df.select(*leaves(df.schema, []))


def flattened_json(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(.., key, value) of the leaves of JSON objects, with dotted keys; arrays are leaves, as JSON text; values keep their JSON text but for strings.

    Levels are opened in rounds, as deep as the objects go; a round's rows are the objects
    that are still closed. Objects are told from strings that look like one by their type.
    An object that repeats a key isn't parted by it: it gives its last value.
    """
    own = [c for c in rows.columns if c != text_col]
    level = rows.select(*own, F.lit("").alias("prefix"), F.col(text_col).alias("node"))
    done = None
    while True:
        texts = level.select(*own, "prefix", F.from_json("node", "map<string,string>").alias("texts"), F.from_json("node", "map<string,variant>").alias("typed"))
        entries = texts.select(*own, "prefix", "typed", F.explode("texts").alias("k", "value"))
        kind = F.schema_of_variant(F.try_element_at("typed", F.col("k")))
        named = entries.select(*own, F.concat("prefix", "k").alias("key"), "value", F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("closed"))
        opened = materialize(named, "json-level")
        leaves = opened.where(~F.col("closed")).drop("closed")
        done = leaves if done is None else done.union(leaves)
        level = opened.where("closed").select(*own, F.concat("key", F.lit(".")).alias("prefix"), F.col("value").alias("node"))
        if level.isEmpty():
            return done


def layered_value(layers: DataFrame) -> DataFrame:
    """(key, value, source) from (key, value, source, priority) rows: the highest source that has the key."""
    best = layers.groupBy("key").agg(F.max_by(F.struct("value", "source"), "priority").alias("b"))
    return best.select("key", "b.*")


def flattened_lists(stages: DataFrame, column: str) -> DataFrame:
    """(stage, path) of array-of-array columns."""
    return stages.select("stage", F.explode(F.flatten(column)).alias("path"))


def colliding_leaves(keys: DataFrame) -> DataFrame:
    """Last parts of dotted keys that several keys of a stage share; the last key given would win."""
    leaf = F.element_at(F.split("key", r"\."), -1)
    return keys.groupBy("stage", leaf.alias("leaf")).agg(F.countDistinct("key").alias("n"), F.max_by("key", "ordinal").alias("winner")).where("n > 1")


def foreach_stages(names: DataFrame, items: DataFrame) -> DataFrame:
    """(name, item, stage) of stages that are declared for each item of a list."""
    return names.join(items, "name").select("name", "item", F.concat("name", F.lit("@"), "item").alias("stage"))
