"""Near-duplicate vectors by collision counting over one-dimensional projections.

Vectors are compared by cosine in double precision; pairs at ``COSINE`` or more are links.

1. Equal vectors form a class, compared once, with the number of its copies.
2. Unit vectors are projected on random directions. Along a direction, a link's two
   projections differ by about ``SPREAD / sqrt(dimension)``; other pairs by several times that.
3. Counting needs pairs that have a chance: ``tables`` times, the sorted ranges of ``depth``
   projections, of ``RANGE`` such differences each, together make cells, and only vectors of
   one cell are counted. ``depth`` follows from all vectors' distribution over the ranges, so
   that a cell holds about ``CELL`` of them, and ``tables`` from the recall wanted of pairs at
   the threshold itself.
4. In a cell, each vector opens a window of ``WINDOW`` differences around itself in each of
   ``COUNTED`` further sorted projections. Pairs that collide in at least the number of
   windows that all but one in a thousand links reach are verified by their exact cosine.
5. A pair is counted in the first table in which it shares a cell, so link counts add up
   without a list of pairs; for the groups, a cell emits a spanning forest of its links.

Cells over ``BLOCK`` classes are cut into blocks, and every two blocks are compared as a cell.

Rules: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, equal or not; vectors of different dimension don't link; a null id doesn't name a
group; repeated rows link with each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.caches import bounded
from weftline.llm.components import connected_components
from weftline.plans.scratch import materialize

COSINE = 0.95
#: Distance of unit vectors at the threshold.
SPREAD = math.sqrt(2 * (1 - COSINE))
#: Widths in standard differences of a link: of a cell's ranges and, on either side, of the counting windows.
RANGE, WINDOW = 5.0, 1.5
#: Projections counted, and the share of links at the threshold that must reach the count.
COUNTED, COUNT_RECALL = 32, 0.999
#: Share of links at the threshold that must share a cell in some table; classes that a cell should hold; most of one.
CELL_RECALL, CELL, BLOCK = 0.995, 32, 1024
MOST_DEPTH, SEED = 24, 20240229


@lru_cache(1)
def least_count() -> int:
    """The largest count that COUNT_RECALL of links at the threshold reach."""
    p = math.erf(WINDOW / math.sqrt(2))
    tail, count = 0.0, COUNTED + 1
    while tail < COUNT_RECALL:
        count -= 1
        tail += math.comb(COUNTED, count) * p**count * (1 - p) ** (COUNTED - count)
    return count


@lru_cache(512)
def _directions(dimension: int, table: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dimension, table + 1])
    directions = rng.standard_normal((dimension, size))
    return directions / np.linalg.norm(directions, axis=0), rng.random(size)


@dataclass(frozen=True)
class Plan:
    """Tables of cells and projections of each."""

    tables: int
    depth: int

    def directions(self, dimension: int, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit directions and range offsets of a table; table -1 has the counted projections."""
        return _directions(dimension, table, COUNTED if table < 0 else self.depth)

    def cells(self, vectors: np.ndarray, tables: int) -> np.ndarray:
        """64-bit cell of each unit vector in each of the first tables."""
        dimension = vectors.shape[1]
        width = RANGE * SPREAD / math.sqrt(dimension)
        out = np.empty((len(vectors), tables), np.int64)
        for table in range(tables):
            directions, offsets = self.directions(dimension, table)
            ranges = np.floor(vectors @ directions / width + offsets).astype(np.int64).view(np.uint64)
            cell = np.full(len(vectors), (dimension << 32) + table + 1, np.uint64)
            for k in range(self.depth):
                cell = (cell ^ (cell >> np.uint64(31)) ^ ranges[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                cell ^= cell >> np.uint64(29)
            out[:, table] = cell.view(np.int64)
        return out


def plan_for(classes: int, collision: float) -> Plan:
    """Depth at which a cell holds about CELL classes, and tables that reach CELL_RECALL there; ``collision``: chance that two vectors share a range."""
    share = 1 - math.sqrt(2 / math.pi) / RANGE  # of links at the threshold that share a range
    depth = 1
    if classes > CELL and 0 < collision < 1:
        depth = min(MOST_DEPTH, max(1, math.ceil(math.log(classes / CELL) / -math.log(collision))))
    return Plan(max(1, math.ceil(math.log(1 - CELL_RECALL) / math.log(1 - share**depth))), depth)


def unit_vectors(values: list[list[float] | None]) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for value in values:
        x = None if not value or any(v is None for v in value) else np.array(value, np.float64)
        if x is not None:
            largest = np.abs(x).max()
            x = x / largest if np.isfinite(largest) and largest > 0 else None
        out.append(None if x is None else x / np.linalg.norm(x))
    return out


def _vectors(df: DataFrame) -> DataFrame:
    """vec_id, key of the vector's values and its unit vector; nulls in both if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            units = unit_vectors(values)
            keys = [None if u is None else hashlib.blake2b((np.array(v, np.float64) + 0.0).tobytes(), digest_size=16).digest() for u, v in zip(units, values, strict=True)]
            vectors = [None if u is None else u.tobytes() for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "key", "vector"])

    kind = df.schema["vec_id"].dataType.simpleString()
    return df.mapInArrow(run, f"vec_id {kind}, key binary, vector binary")


def _by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each dimension."""
    raw = column.to_pylist()
    sizes = np.array([len(x) for x in raw])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(raw[k] for k in at), np.float64).reshape(len(at), -1)


def _collision(classes: DataFrame) -> float:
    """Chance that two classes share a range, in the middle of COUNTED projections, over all classes; a few rows a projection come to the driver."""
    plan = Plan(0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, vectors in _by_dimension(batch.column(0)):
                directions, offsets = plan.directions(vectors.shape[1], -1)
                ranges = np.floor(vectors @ directions * math.sqrt(vectors.shape[1]) / (RANGE * SPREAD) + offsets).astype(np.int64)
                for k in range(COUNTED):
                    found, n = np.unique(ranges[:, k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(n), pa.int32()), pa.array(found), pa.array(n, pa.int64())], ["projection", "range", "n"])

    counts = classes.select("vector").mapInArrow(run, "projection int, range long, n long").groupBy("projection", "range").agg(F.sum("n").alias("n"))
    shares = counts.groupBy("projection").agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("share"))
    return shares.agg(F.median("share")).first()[0] or 0.0


def _cell_rows(classes: DataFrame, plan: Plan) -> DataFrame:
    """spot (table), cell and key of every class in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in _by_dimension(batch.column(1)):
                keys = batch.column(0).take(pa.array(at))
                cells = plan.cells(vectors, plan.tables)
                for table in range(plan.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), table, np.int32)), pa.array(np.ascontiguousarray(cells[:, table])), keys], ["spot", "cell", "key"])

    return classes.select("key", "vector").mapInArrow(run, "spot int, cell long, key binary")


def _tasks(rows: DataFrame) -> DataFrame:
    """spot, cell, first and second block, and key: the members of every cell, or of every two blocks of a large one."""
    sizes = materialize(rows.groupBy("spot", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cell-sizes")  # written, so that Spark can split the rows of a large cell
    blocks = F.ceil(F.col("n") / BLOCK)
    placed = rows.join(sizes, ["spot", "cell"]).withColumn("block", F.pmod(F.xxhash64("key"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return placed.select("spot", "cell", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "key", "block")


def collisions(projected: np.ndarray, part: np.ndarray, window: float) -> np.ndarray:
    """For the vectors of ``part`` and all vectors, the number of projections in which the second lies in the window around the first."""
    n = len(projected)
    if n <= 64:
        return (np.abs(projected[part, None] - projected[None]) <= window).sum(2)
    count, rows = np.zeros((len(part), n), np.int16), np.arange(len(part))
    for k in range(projected.shape[1]):
        order = np.argsort(projected[:, k], kind="stable")
        line = projected[order, k]
        inside = np.zeros((len(part), n + 1), np.int16)
        inside[rows, np.searchsorted(line, projected[part, k] - window, "left")] += 1
        inside[rows, np.searchsorted(line, projected[part, k] + window, "right")] -= 1
        count[:, order] += np.cumsum(inside, axis=1, dtype=np.int16)[:, :n]
    return count


def links_of(vectors: np.ndarray, spot: int, side: np.ndarray, crossing: bool, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of the links of a cell that no earlier table has, between sides only if ``crossing``."""
    projected = vectors @ plan.directions(vectors.shape[1], -1)[0]
    window, least = WINDOW * SPREAD / math.sqrt(vectors.shape[1]), least_count()
    n, found = len(vectors), []
    for begin in range(0, n, 128):
        part = np.arange(begin, min(begin + 128, n))
        i, j = np.nonzero(collisions(projected, part, window) >= least)
        i = part[i]
        keep = (i < j) & (side[i] != side[j]) if crossing else i < j
        i, j = i[keep], j[keep]
        good = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= COSINE
        if good.any():
            found.append((i[good], j[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    members, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    cells = plan.cells(vectors[members], spot)
    new = ~np.any([cells[at[: len(i)], t] == cells[at[len(i) :], t] for t in range(spot)], axis=0) if spot else np.ones(len(i), bool)
    return i[new], j[new]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _links(classes: DataFrame, plan: Plan) -> DataFrame:
    """key and n (copies linked in one cell), or key, other and n = 0 (an edge of a cell's forest)."""
    tasks = _tasks(materialize(_cell_rows(classes, plan), "cells"))
    members = tasks.join(classes.select("key", "vector", "copies"), "key")
    whole = members.groupBy("spot", "cell", "first", "second").agg(F.collect_list(F.struct("key", "vector", "copies", "block")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, others, counts = [], [], []
            lists = batch.column(3)
            for spot, first, second, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), lists, strict=True):
                rows = cell.values
                names = rows.field("key").to_pylist()
                vectors = np.frombuffer(b"".join(rows.field("vector").to_pylist()), np.float64).reshape(len(names), -1)
                copies = rows.field("copies").to_numpy(zero_copy_only=False)
                side = rows.field("block").to_numpy(zero_copy_only=False)
                i, j = links_of(vectors, spot, side, first != second, plan)
                if not len(i):
                    continue
                linked = np.bincount(i, copies[j], len(names)) + np.bincount(j, copies[i], len(names))
                at = np.flatnonzero(linked)
                edges = _forest(len(names), i, j)
                keys += [names[k] for k in at] + [names[a] for a, _ in edges]
                others += [None] * len(at) + [names[b] for _, b in edges]
                counts += linked[at].astype(np.int64).tolist() + [0] * len(edges)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(others, pa.binary()), pa.array(counts, pa.int64())], ["key", "other", "n"])

    return whole.select("spot", "first", "second", "members").mapInArrow(run, "key binary, other binary, n long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest id of its group) and kept (whether that is its own)."""
    rows = materialize(_vectors(bounded(df).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))), "vectors")
    classes = materialize(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector")), "vector-classes")
    plan = plan_for(classes.count(), _collision(classes))
    found = materialize(_links(classes, plan), "vector-links")
    counts = found.where("other is null").groupBy("key").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    members = roots.union(roots.select(F.col("root"), F.col("root")).distinct()).select(F.col("node").alias("key"), "root")
    named = members.join(classes.select("key", "rep"), "key")
    names = named.groupBy("root").agg(F.min("rep").alias("name"))
    of_class = (
        classes.select("key", "rep", "copies")
        .join(counts, "key", "left")
        .join(named.join(names, "root").select("key", "name"), "key", "left")
        .where("copies > 1 or n is not null")
        .select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("name", "rep").alias("name"))
    )
    component = F.coalesce("name", "vec_id")
    return rows.select("vec_id", "key").join(of_class, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
