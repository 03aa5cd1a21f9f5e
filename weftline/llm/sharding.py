"""Minimax contiguous partition of ordered atomic groups into shards, in DataFrame operations.

Rows with equal text form an atomic group. Groups stand in the order of the SHA-256 of
their text; a shard is a contiguous run of that order. The largest shard is made as small
as possible: a binary search over the shard capacity asks, for each capacity, whether a
greedy walk over the ordered sizes needs at most the given number of shards, and the cuts
are made at the smallest capacity that does.

The driver never holds the groups. It holds *atoms*, the total sizes of hash-prefix
ranges. The walk runs over atoms; only the ranges that can hold a cut at the capacity
found so far are split further, until each range there is one group, when the result is
the exact optimum over groups. A group larger than the mean of what remains would force
empty shards behind it, so such groups (fewer than the shards) get a shard of their own
and the rest is divided over the other shards.

Rules: a null text counts as the empty text (size 8); repeated rows stay separate rows of
one group; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.scratch import materialize

ROW_OVERHEAD = 8
#: Hex digits of the first atoms, at most 16**4 rows on the driver, and digits added when one is split.
FIRST_DIGITS, MORE_DIGITS = 4, 2
#: Slot numbers are counted in this many parts of each shard, by the hash of the id.
SLOT_PARTS = 1024


@dataclass
class Atoms:
    """Ordered hash-prefix ranges: prefix, total size, and number of groups of each."""

    prefixes: list[str]
    sizes: list[int]
    groups: list[int]

    def ends(self) -> list[int]:
        out, total = [], 0
        for size in self.sizes:
            total += size
            out.append(total)
        return out


def greedy_cuts(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Exclusive end index of each shard when shards are filled up to ``capacity`` in order; None if more than ``shards`` are needed."""
    cuts, at, base = [], 0, 0
    while at < len(ends):
        to = bisect.bisect_right(ends, base + capacity, at)
        if to == at or len(cuts) == shards:
            return None
        cuts.append(to)
        at, base = to, ends[to - 1]
    return cuts


def smallest_capacity(ends: list[int], shards: int) -> int:
    """Binary search of the smallest capacity that the greedy walk can serve with ``shards`` shards."""
    total = ends[-1] if ends else 0
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def cut_windows(ends: list[int], capacity: int, shards: int) -> list[tuple[int, int]]:
    """For each cut, the first and last boundary index that any solution within ``capacity`` can use."""
    latest = greedy_cuts(ends, capacity, shards) or []
    latest += [len(ends)] * (shards - len(latest))
    total = ends[-1] if ends else 0
    starts = [0, *ends]
    earliest, right = [], total
    for _ in range(shards - 1):  # from the right: what must stand left of the cut
        at = bisect.bisect_left(starts, right - capacity)
        earliest.append(at)
        right = starts[at]
    return list(zip(earliest[::-1], latest[: shards - 1], strict=True))


def balanced_cuts(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts within ``capacity`` that also share what remains evenly, so the slack isn't left to the last shard."""
    starts, cuts, at = [0, *ends], [], 0
    total = starts[-1]
    for k, (first, last) in enumerate(cut_windows(ends, capacity, shards)):
        base = starts[at]
        ideal = base + (total - base) / (shards - k)
        last = min(last, bisect.bisect_right(starts, base + capacity) - 1)
        to = bisect.bisect_left(starts, ideal)
        if to > 0 and (to == len(starts) or starts[to] - ideal > ideal - starts[to - 1]):
            to -= 1
        at = max(at, first, min(to, last))
        cuts.append(at)
    return cuts


def _atoms(groups: DataFrame, digits: int, within: list[str] | None = None, parent: int = 0) -> Atoms:
    """Sizes of the hash-prefix ranges of ``digits`` digits, inside the ranges named if any."""
    if within is not None:
        groups = groups.where(F.substring("group_key", 1, parent).isin(within))
    rows = (
        groups.groupBy(F.substring("group_key", 1, digits).alias("prefix"))
        .agg(F.sum("group_size").alias("size"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    rows.sort(key=lambda r: r["prefix"])
    return Atoms([r["prefix"] for r in rows], [r["size"] for r in rows], [r["n"] for r in rows])


def _exact_cuts(groups: DataFrame, shards: int) -> list[str]:
    """Hash prefixes at which shards 1.. begin; a key belongs to the last shard whose prefix is not above it."""
    atoms, digits = _atoms(groups, FIRST_DIGITS), FIRST_DIGITS
    while True:
        ends = atoms.ends()
        capacity = smallest_capacity(ends, shards)
        at_cut = sorted({i for first, last in cut_windows(ends, capacity, shards) for i in range(max(0, first - 1), min(last + 1, len(ends)))})
        coarse = [atoms.prefixes[i] for i in at_cut if atoms.groups[i] > 1 and len(atoms.prefixes[i]) == digits]
        if not coarse or digits >= 64:
            break
        finer = _atoms(groups, min(64, digits + MORE_DIGITS), coarse, digits)
        split = set(coarse)
        merged = [x for x in zip(atoms.prefixes, atoms.sizes, atoms.groups, strict=True) if x[0] not in split]
        merged += zip(finer.prefixes, finer.sizes, finer.groups, strict=True)
        merged.sort()
        atoms, digits = Atoms(*map(list, zip(*merged, strict=True))), min(64, digits + MORE_DIGITS)
    if not atoms.prefixes:
        return ["g"] * (shards - 1)
    return [atoms.prefixes[c] if c < len(atoms.prefixes) else "g" for c in balanced_cuts(ends, capacity, shards)]


def _own_shards(groups: DataFrame, total: int, shards: int) -> list[str]:
    """Keys of groups larger than an even share of what the larger groups leave; fewer than ``shards``."""
    own, left = [], total
    for row in groups.orderBy(F.desc("group_size"), "group_key").limit(shards - 1).collect():
        if row["group_size"] * (shards - len(own)) <= left:
            break
        own.append(row["group_key"])
        left -= row["group_size"]
    return own


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard and slot.

    ``size`` is the text's UTF-8 bytes plus ``ROW_OVERHEAD``; equal texts share a shard; the
    largest shard is the smallest possible over contiguous runs of the hash order. ``slot``
    counts from 0 without gaps inside a shard, by hash part and id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(text, 256).alias("group_key"),
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("group_key").agg(F.sum("size").alias("group_size")), "shard-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    own = _own_shards(groups, total, shards) if total else []
    rest = groups.where(~F.col("group_key").isin(own)) if own else groups
    starts = _exact_cuts(rest, shards - len(own)) if shards > len(own) + 1 else []
    shard = _shard_of(F.col("group_key"), own, starts).alias("shard")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_PARTS)).cast("int").alias("part")
    placed = rows.select("doc_id", "size", "text_crc32", shard, part)
    # At most shards * SLOT_PARTS rows of three integers: small enough to broadcast at any input size.
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    in_part = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    return (
        placed.withColumn("at", F.row_number().over(in_part) - 1)
        .join(F.broadcast(offsets), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"))
    )


def _shard_of(key: Column, own: list[str], starts: list[str]) -> Column:
    shard = F.lit(len(own))
    for start in starts:
        shard = shard + (key >= start).cast("int")
    for k, value in enumerate(own):
        shard = F.when(key == value, k).otherwise(shard)
    return shard.cast("int")
