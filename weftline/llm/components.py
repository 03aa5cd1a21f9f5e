"""Connected components of an edge table by alternating small-star and large-star steps.

A round replaces edges by edges to smaller nodes of the same component, until every node
points at its component's smallest. The small-star step is a window over a node's smaller
neighbours; the large-star step is a join of two written tables, so that Spark knows the
sizes of both and can split the rows of a hub. Only a flag comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.scratch import materialize, release


def _round(edges: DataFrame) -> DataFrame:
    """u, v and whether the edge is new: each edge's ends (u > v) pointed at the smallest neighbours known, first of u, then of v."""
    moved = F.col("v") != F.col("low")
    small = edges.select("u", "v").distinct().select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("low"))
    small = materialize(small.select(F.when(moved, F.col("v")).otherwise(F.col("u")).alias("u"), F.col("low").alias("v"), moved.alias("new")), "small-star")
    low = materialize(small.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("v"), "low"), "lowest")
    out = materialize(small.join(low, "v", "left").select("u", F.coalesce("low", "v").alias("v"), (F.col("new") | F.col("low").isNotNull()).alias("new")), "edges")
    release(small, low)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) of every node with an edge, but for the roots themselves."""
    state = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    while True:
        before, state = state, _round(state)
        release(before)
        if not state.agg(F.max("new")).first()[0]:
            out = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._weftline_path = state._weftline_path  # the caller may release it
            return out
