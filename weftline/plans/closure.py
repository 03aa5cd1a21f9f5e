"""Reachability over edge tables in rounds: level by level where there are no cycles, else by frontiers; each round's rows are written to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.scratch import materialize, new_path, release

#: Rounds after which the pairs known are written together.
COMPACT = 8
#: Sources of one array; a node with more has them in several. Sources, and edges, that come to one task of a level.
ARRAY, A_TASK = 65_536, 4_000_000
#: Edges of a node that are written in one row.
FAN = 1024


def reachable(edges: DataFrame, seeds: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct (src, dst) with a path of one or more edges; from the seeds (column ``src``) if given."""
    step = materialize(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), "closure-edges")
    return _pairs(step, step if seeds is None else step.join(seeds.select("src").distinct(), "src", "left_semi"))


def reachable_after(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst): the starts (src, dst), and each src with all that a path of ``edges`` leads to from its dst."""
    return _pairs(materialize(edges.select("src", "dst").distinct(), "closure-edges"), starts.select("src", "dst").distinct())


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct nodes (column ``dst``) to which a path of one or more edges leads from a seed (column ``src``); no pairs are made."""
    step = materialize(edges.select("src", "dst").distinct(), "closure-edges")
    newest = materialize(step.join(seeds.select("src").distinct(), "src", "left_semi").select("dst").distinct(), "reached")
    known, parts = newest, 1
    while True:
        ahead = step.join(newest.select(F.col("dst").alias("src")), "src").select("dst").distinct()
        fresh = materialize(ahead.join(known, "dst", "left_anti"), "reached")
        if fresh.isEmpty():
            release(fresh)
            return known
        newest, known, parts = fresh, known.union(fresh), parts + 1
        if parts >= COMPACT:
            known, parts = materialize(known, "reached-known"), 1


def _pairs(step: DataFrame, starts: DataFrame) -> DataFrame:
    levels = _levels(step)
    return _by_frontiers(step, starts) if levels is None else _by_levels(step, starts, *levels)


def _by_frontiers(step: DataFrame, starts: DataFrame) -> DataFrame:
    """The pairs known and the newest pairs are kept apart, so a round joins only the newest;
    what is known is written together every COMPACT rounds. Cycles end it, as no pair is new.
    """
    newest = materialize(starts.select("src", "dst"), "closure")
    known, parts = newest, 1
    while True:
        ahead = newest.select("src", F.col("dst").alias("via")).join(step.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        fresh = materialize(ahead.join(known, ["src", "dst"], "left_anti"), "closure")
        if fresh.isEmpty():
            release(fresh)
            return known
        newest, known, parts = fresh, known.union(fresh), parts + 1
        if parts >= COMPACT:
            known, parts = materialize(known, "closure-known"), 1


def _by_levels(step: DataFrame, starts: DataFrame, levels: DataFrame, top: int) -> DataFrame:
    """Each node gets the sources of all its makers in one round, that of its level, so pairs are made distinct once and never held against those known.

    A node's sources are an array, several by hash if there are many; with it are the node's
    edges, FAN a row, from which the levels after it read. Which levels read from which is
    known on the driver.
    """
    spark = step.sparkSession
    kind = starts.schema["src"].dataType
    at = levels.select(F.col("node").alias("dst"), F.col("level").alias("to"))
    first = new_path(spark, "closure-starts")
    starts.join(at, "dst", "left").select("src", "dst", F.coalesce("to", F.lit(0)).alias("to")).write.partitionBy("to").parquet(first)
    begun = spark.read.schema(T.StructType([T.StructField("src", kind), T.StructField("dst", step.schema["dst"].dataType), T.StructField("to", T.IntegerType())])).parquet(first)
    placed = step.join(at, "dst").join(levels.select(F.col("node").alias("src"), "level"), "src")
    row = F.row_number().over(Window.partitionBy("src").orderBy("to", "dst")) - 1
    ahead = placed.withColumn("chunk", F.floor(row / FAN).cast("int")).groupBy("src", "level", "chunk").agg(F.collect_list(F.struct("dst", "to")).alias("next"))
    fans = new_path(spark, "closure-fans")
    ahead.write.partitionBy("level").parquet(fans)
    fan = spark.read.schema(T.StructType([f for f in ahead.schema if f.name != "level"] + [T.StructField("level", T.IntegerType())])).parquet(fans)
    reads: dict[int, list[int]] = {}
    for r in fan.select("level", F.explode("next.to").alias("to")).distinct().collect():  # a row a pair of levels
        reads.setdefault(r["to"], []).append(r["level"])
    done: dict[int, DataFrame] = {}
    for level in range(top + 1):
        inbox = begun.where(F.col("to") == level).select("dst", F.array("src").alias("part"), F.lit(1).alias("n"))
        for k in reads.get(level, []):
            if k in done:
                inbox = inbox.union(done[k].select(F.explode("next").alias("e"), "part", "n").where(F.col("e.to") == level).select("e.dst", "part", "n"))
        total, widest = inbox.groupBy("dst").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.max("n")).first()
        if not total:
            continue
        tasks = -(-total // A_TASK)
        if widest <= ARRAY:
            sets = inbox.repartition(tasks, "dst").groupBy("dst").agg(F.array_distinct(F.flatten(F.collect_list("part"))).alias("part"))
        else:
            cells = inbox.groupBy("dst").agg(F.ceil(F.sum("n") / ARRAY).alias("cells"))
            single = inbox.select("dst", F.explode("part").alias("a")).join(cells, "dst").select("dst", "a", F.pmod(F.xxhash64("a"), "cells").alias("cell"))
            sets = single.repartition(tasks, "dst", "cell").distinct().groupBy("dst", "cell").agg(F.collect_list("a").alias("part")).select("dst", "part")
        own = fan.where(F.col("level") == level).select(F.col("src").alias("dst"), "chunk", "next")
        done[level] = materialize(sets.join(own.repartition(tasks, "dst"), "dst", "left").select("dst", "part", F.size("part").alias("n"), F.coalesce("chunk", F.lit(0)).alias("chunk"), "next"), "closure-level")
    out = step.select("src", "dst").limit(0) if not done else None
    for table in done.values():
        pairs = table.where("chunk = 0").select(F.explode("part").alias("src"), "dst")
        out = pairs if out is None else out.union(pairs)
    return out


def _levels(step: DataFrame) -> tuple[DataFrame, int] | None:
    """(node, level) of all nodes of distinct edges, and the highest level; None if there is a cycle.

    A round goes on from the nodes that it was the last to reach: whose edges in, which it
    counts, have all been met. Nodes met by some of their edges are carried on with their count.
    """
    need = step.groupBy("dst").agg(F.count(F.lit(1)).alias("need"))
    counted = materialize(step.join(need, "dst").select("src", "dst", "need"), "level-edges")
    waiting = counted.select("dst").distinct().count()
    free = counted.select(F.col("src").alias("node")).distinct().join(counted.select(F.col("dst").alias("node")), "node", "left_anti")
    rounds = new_path(step.sparkSession, "levels")
    kind = T.StructType([T.StructField("node", step.schema["dst"].dataType), T.StructField("got", T.LongType()), T.StructField("need", T.LongType())])
    none = F.lit(0).cast("bigint")
    current, level = free.select("node", none.alias("got"), none.alias("need")), 0
    while True:
        current.write.parquet(f"{rounds}/level={level}")
        current = step.sparkSession.read.schema(kind).parquet(f"{rounds}/level={level}")
        met = current.where("got = need")
        found = met.count()
        if level:
            waiting -= found
        if not waiting:
            break
        if not found:
            return None
        arrived = counted.join(met.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"), F.lit(1).cast("bigint").alias("got"), "need")
        current = arrived.union(current.where("got < need")).groupBy("node").agg(F.sum("got").alias("got"), F.max("need").alias("need"))
        level += 1
    every = step.sparkSession.read.schema(T.StructType([*kind, T.StructField("level", T.IntegerType())])).parquet(rounds)
    return every.where("got = need").select("node", "level"), level


def cyclic_part(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) that are left when nodes without incoming, then without outgoing edges are taken away until there are none."""
    left = materialize(edges.select("src", "dst").distinct(), "cyclic")
    for near, far in (("src", "dst"), ("dst", "src")):
        size = left.count()
        while size:
            ends = left.select(near).distinct().join(left.select(F.col(far).alias(near)).distinct(), near, "left_anti")
            after = materialize(left.join(ends, near, "left_anti").select("src", "dst"), "cyclic")
            remaining = after.count()
            release(left)
            left = after
            if remaining == size:
                break
            size = remaining
    return left


def longest_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 without incoming edges, else one more than the highest level of a source. Raises ValueError on a cycle."""
    levels = _levels(materialize(edges.select("src", "dst").distinct(), "level-edges"))
    if levels is None:
        raise ValueError("the graph has a cycle")
    return nodes.select("node").distinct().join(levels[0], "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))
