"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

A document's set is its distinct 5-word shingles. Two documents are linked if their sets'
Jaccard similarity is at least 0.75; components of links are the groups.

1. Documents with the same word sequence form a class; classes are compared, not copies.
2. A class has 64 minwise tokens: the smallest shingle hash in each of 64 equal parts of
   the hash range. A byte of each makes a sketch from which a pair's similarity is estimated;
   for branching, an empty part borrows from another one.
3. Each of ``TREES`` independent trees branches its nodes by chosen tokens: in every node
   each of the 64 places is chosen with a fixed chance, and classes with the same token at a
   chosen place form a child. A node of at most ``HELD`` classes comes to one task, which
   branches it on to leaves of at most ``LEAF`` classes. A larger one is branched by all
   tasks: one that a bounded sample of all classes shows to be large as its rows are made, so
   that they never meet, any other in a further round. A node of which a sample shows most
   classes to be alike, which branching would not part, is joined as a whole.
4. In a leaf all pairs' estimates are compared. Pairs that cannot be links are dropped. Of
   the others a leaf emits a spanning forest, not all pairs. Components of these edges are
   clusters: no link found leaves one.
5. A cluster of at most ``CLUSTER`` classes and ``CLUSTER_BYTES`` of sets is brought together
   with its full sets. Pairs that can be links are tested there, block by block, likeliest
   first, unless links found have joined them.
6. A larger cluster is cut into parts. Each part is tested like a small cluster, together
   with a few classes that all parts get. Then every class outside the cluster's largest
   group is tested, in blocks, with all parts: each pair of different groups is tested, and
   no task holds more than a part and a block.

Rules: null texts are empty; documents without words are linked with nothing, equal or not;
documents of fewer than five words have one shingle; repeated rows are documents of their
own; null ids join groups but don't name them, and only a group without any id keeps rows
without one; a group of rows that have no id has a null component; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.caches import bounded, keep
from weftline.llm.components import connected_components
from weftline.plans.scratch import materialize, release

WORDS, PERCENT = 5, 75
PLACES, TREES, LEAF, DEPTH = 64, 10, 512, 4
#: Chosen places that a link's two classes share on average, in a node below the root.
DEEPER = 2.0
#: Classes of a node that a task holds, and classes sampled on the driver to tell larger nodes.
HELD, DRAWN = 8192, 16384
SKETCH, CLUSTER, CLUSTER_BYTES, PART, SHARED = 256, 8192, 128 << 20, 512, 16
#: Pairs of a block that are tested one by one at most, and shingles of a matrix that tests more at once.
ONE_BY_ONE, CHUNK = 2048, 8192
#: Classes sampled in a large node, and the share of them with a like one that makes it alike.
SAMPLE, ALIKE = 32, 0.5
#: Standard deviations of an estimate below the threshold at which a pair is dropped.
DEVIATIONS = 4.0
#: Bits of the filter that spares most texts without a candidate the way to the full sets.
FILTER_BITS, BITMAP_BITS = 1 << 25, 1 << 15
_WORD_CACHE = 100_000
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))
_STEPS = np.array([int.from_bytes(hashlib.blake2b(b"step%d" % k, digest_size=8).digest(), "little") | 1 for k in range(WORDS)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> _MIX[2])) * _MIX[0]
    x = (x ^ (x >> _MIX[2])) * _MIX[1]
    return x ^ (x >> _MIX[2])


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        out = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 with A-Z lowered; bytes.split() parts at just the six ASCII spaces."""
    return (text or "").encode().lower().split()


def key_of(words: list[bytes]) -> bytes | None:
    """What names a class: a hash of the word sequence, None without words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of the whole sequence if it has fewer words than a shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(keep("word-hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return mixed((h * _STEPS[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    total = h[:n] * _STEPS[0]
    for k in range(1, WORDS):
        total += h[k : k + n] * _STEPS[k]
    return np.unique(mixed(total))


def minwise_tokens(hashes: np.ndarray, parts: int = SKETCH) -> np.ndarray:
    """32 bits of the smallest hash in each of so many equal parts of the range; 0 for an empty part."""
    shift, order = np.uint64(64 - (parts - 1).bit_length()), np.arange(parts, dtype=np.uint64)
    at = np.searchsorted(hashes, order << shift)
    value = hashes[np.minimum(at, len(hashes) - 1)]
    there = (at < len(hashes)) & (value >> shift == order)
    return np.where(there, (mixed(value) >> np.uint64(32)) | np.uint64(1), np.uint64(0)).astype(np.uint32)


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """A byte of each token, 0 for an empty part."""
    return np.where(tokens > 0, (tokens >> np.uint32(8)) % np.uint32(255) + np.uint32(1), np.uint32(0)).astype(np.uint8)


def densified(tokens: np.ndarray) -> np.ndarray:
    """Tokens with each empty place filled from the first full one of its own fixed series of places."""
    out, turn, order = tokens.copy(), 0, np.arange(PLACES, dtype=np.uint64)
    rows = np.flatnonzero((tokens == 0).any(1) & (tokens > 0).any(1))
    while len(rows):
        turn += 1
        other = (mixed(order * np.uint64(977) + np.uint64(turn)) % np.uint64(PLACES)).astype(int)
        part = out[rows]
        out[rows] = part = np.where(part == 0, tokens[rows][:, other], part)
        rows = rows[(part == 0).any(1)]
    return out


def _documents(df: DataFrame) -> DataFrame:
    """The columns but ``text``, n_shingles, and key and tokens of the word sequence, null in documents without words."""
    rest = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, tokens = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hashes = shingle_set(words)
                sizes.append(len(hashes))
                keys.append(key_of(words))
                tokens.append(minwise_tokens(hashes, PLACES).tobytes() if words else None)
            columns = [*(batch.column(c) for c in rest), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (keys, tokens))]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "n_shingles", "key", "tokens"])

    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("tokens", T.BinaryType())])
    return df.mapInArrow(run, schema)


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


# --- trees


def root_places(tree: int) -> np.ndarray:
    """Places chosen at the root of a tree, at least one."""
    salt = 0
    while True:
        draw = mixed(np.arange(PLACES, dtype=np.uint64) + np.uint64((tree << 32) + (salt << 16) + (1 << 60)))
        chosen = np.flatnonzero(draw < np.uint64(int(2**64 / (PERCENT / 100 * PLACES))))
        if len(chosen):
            return chosen
        salt += 1


def root_nodes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and node of every child that the trees' roots make of filled-up tokens."""
    chosen = [(tree, int(p)) for tree in range(TREES) for p in root_places(tree)]
    nodes = [mixed(tokens[:, p].astype(np.uint64) + mixed(np.array([(tree + 1 << 8) + p], np.uint64))) for tree, p in chosen]
    return np.tile(np.arange(len(tokens)), len(chosen)), np.concatenate(nodes)


def child_nodes(parents: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and node of every child below the root; a row has its node and its filled-up tokens."""
    places = np.arange(PLACES, dtype=np.uint64)
    limit = np.uint64(int(DEEPER * 2**64 / (PERCENT / 100 * PLACES)))
    at, place = np.nonzero(mixed(parents[:, None] + mixed(places + np.uint64(1 << 40))[None, :]) < limit)
    return at, mixed(mixed(parents[at] + np.uint64(7)) + mixed(tokens[at, place].astype(np.uint64) + (places[place] << np.uint64(40))))


def similarities(sketches: np.ndarray, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of all pairs of rows (of the first and of the others), and below which a pair is dropped."""
    others = sketches if others is None else others
    full, full_too = sketches > 0, others > 0
    equal = np.empty((len(sketches), len(others)), np.float32)
    for k in range(0, len(sketches), 64):
        part = slice(k, k + 64)
        equal[part] = ((sketches[part, None] == others[None]) & full[part, None]).sum(2)
    either = full.sum(1, dtype=np.float32)[:, None] + full_too.sum(1, dtype=np.float32)[None] - full.astype(np.float32) @ full_too.astype(np.float32).T
    either = np.maximum(either, 1)
    share = PERCENT / 100
    return equal / either, share - DEVIATIONS * np.sqrt(share * (1 - share) / either)


def alike(sketches: np.ndarray) -> bool:
    """Whether at least the share ALIKE of some of these rows has another that may be a link."""
    some = sketches[np.linspace(0, len(sketches) - 1, min(SAMPLE, len(sketches))).astype(int)]
    estimate, least = similarities(some)
    np.fill_diagonal(estimate, -1)
    return bool((estimate >= least).any(1).mean() >= ALIKE)


def hot_nodes(keys: list[bytes], tokens: np.ndarray, rate: float) -> dict[int, bytes | None]:
    """The nodes that hold over HELD classes, by a sample of one in ``rate``: the class that all are joined with where most are alike, else None."""
    dense, sketches = densified(tokens), sketch_of(tokens)
    at, nodes = root_nodes(dense)
    hot: dict[int, bytes | None] = {}
    for depth in range(1, DEPTH + 1):
        order = np.argsort(nodes, kind="stable")
        at, nodes = at[order], nodes[order]
        found, first, counts = np.unique(nodes, return_index=True, return_counts=True)
        heavy = np.flatnonzero((counts * rate > HELD) & (counts >= 8))
        parted = []
        for k in heavy:
            members = at[first[k] : first[k] + counts[k]]
            whole = depth == DEPTH or alike(sketches[members])
            hot[int(found[k])] = min(keys[m] for m in members) if whole else None
            if not whole:
                parted.append(np.arange(first[k], first[k] + counts[k]))
        if not parted:
            break
        rows = np.concatenate(parted)
        below, nodes = child_nodes(nodes[rows], dense[at[rows]])
        at = at[rows][below]
    return hot


def _drawn(classes: DataFrame) -> tuple[list[bytes], np.ndarray, float]:
    """Keys and tokens of about DRAWN classes by their hash, and of how many each is one."""
    rate = max(1, -(-classes.count() // DRAWN))
    rows = classes.where(F.pmod(F.xxhash64("key"), F.lit(rate)) == 0).select("key", "tokens").collect()
    rows.sort(key=lambda r: r["key"])
    return [bytes(r["key"]) for r in rows], np.frombuffer(b"".join(r["tokens"] for r in rows), np.uint32).reshape(-1, PLACES), rate


_LEVEL = "node long, key binary, sketch binary, other binary"


def _spread(classes: DataFrame, hot: dict[int, bytes | None]) -> DataFrame:
    """node, key and sketch of every class in every node that a task may hold; key and other for classes of a node that is joined as a whole."""
    hot_ids = np.array(sorted(hot), np.uint64)

    def rows(node: np.ndarray, at: np.ndarray, keys: pa.Array, sketches: pa.Array, other: pa.Array) -> pa.RecordBatch:
        places = pa.array(at)
        return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), keys.take(places), sketches.take(places), other], ["node", "key", "sketch", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _matrix(batch.column("tokens"), np.uint32, PLACES)
            dense, keys, sketches = densified(tokens), batch.column("key"), pa.array(map(bytes, sketch_of(tokens)), pa.binary())
            nothing = pa.nulls(len(keys), pa.binary())
            at, node = root_nodes(dense)
            while len(at):
                where = np.minimum(np.searchsorted(hot_ids, node), max(0, len(hot_ids) - 1))
                large = hot_ids[where] == node if len(hot_ids) else np.zeros(len(node), bool)
                own, own_node = at[~large], node[~large]
                for k in range(0, len(own), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield rows(own_node[part], own[part], keys, sketches, pa.nulls(len(own[part]), pa.binary()))
                at, node = at[large], node[large]
                first = [hot[int(x)] for x in node]
                whole = np.array([x is not None for x in first], bool)
                if whole.any():  # dealt by the class, as they need not meet
                    spread = np.frombuffer(b"".join(k[:8] for k in keys.take(pa.array(at[whole])).to_pylist()), np.uint64)
                    yield rows(spread, at[whole], keys, nothing, pa.array([x for x in first if x is not None], pa.binary()))
                at, node = at[~whole], node[~whole]
                below, node = child_nodes(node, dense[at])
                at = at[below]

    return classes.select("key", "tokens").mapInArrow(run, _LEVEL)


def _branched(rows: DataFrame) -> DataFrame:
    """Children of the rows of nodes that were too large for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parents = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at, node = child_nodes(parents, densified(_matrix(batch.column("sketch"), np.uint8, PLACES)))
            places = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("a").take(places), batch.column("sketch").take(places), pa.nulls(len(at), pa.binary())], ["node", "key", "sketch", "other"])

    return rows.select("node", "a", "sketch").mapInArrow(run, _LEVEL)


def components_of(joined: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component in a symmetric matrix of what is joined."""
    n = len(joined)
    label = np.arange(n)
    joined = joined | np.eye(n, dtype=bool)
    while True:
        low = np.where(joined, label[None], n).min(1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def joined_in(sketches: np.ndarray, node: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of a node, each with a smaller one of its group by the estimates of all leaves below the node."""
    n = len(sketches)
    if n <= LEAF:
        estimate, least = similarities(sketches)
        label = components_of(estimate >= least)
    elif depth >= DEPTH or alike(sketches):
        label = np.zeros(n, int)
    else:
        a, b = [], []
        at, below = child_nodes(np.full(n, node, np.uint64), densified(sketches))
        order = np.argsort(below, kind="stable")
        at, below = at[order], below[order]
        edges = np.flatnonzero(np.r_[True, below[1:] != below[:-1], True]) if len(at) else np.zeros(1, int)
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if y - x > 1:
                members = at[x:y]
                i, j = joined_in(sketches[members], int(below[x]), depth + 1)
                a.append(members[i])
                b.append(members[j])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int),) * 2
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


class _Gathered:
    """Complete groups of a stream of rows sorted by group, each as the rows of a table; a group of over ``most`` rows comes in pieces."""

    def __init__(self, by: str, most: int):
        self.by, self.most = by, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
        """Tables of whole groups with the places at which these begin and end, and False; pieces of a group that is too large, and True."""
        rest: pa.Table | None = None
        excess = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table, rest = pa.concat_tables([rest, table]), None
            group = self._groups(table)
            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            if excess is not None and group[0] == excess:
                yield table.slice(0, edges[1]), edges[:2], True
                table, edges = table.slice(edges[1]), edges[1:] - edges[1]
                if len(edges) < 2:
                    continue
            excess = None
            if edges[-2]:
                yield table.slice(0, edges[-2]), edges[:-1], False
            rest = table.slice(edges[-2])
            if rest.num_rows > self.most:
                excess = group[-1]
                yield rest, np.array([0, rest.num_rows]), True
                rest = None
        if rest is not None:
            yield rest, np.array([0, rest.num_rows]), False

    def _groups(self, table: pa.Table) -> np.ndarray:
        column = table.column(self.by)
        if pa.types.is_integer(column.type):
            return column.to_numpy()
        return np.array(column.to_pylist(), object)


def _forests(level: DataFrame, last: bool) -> DataFrame:
    """a and b: edges that join each node's classes that may be links, from each class to the smallest it is joined with; a, node and sketch: the rows of nodes too large for a task.

    In the last round all classes of such a node are joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def fresh(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            if len(seen) > 1_000_000:
                seen.clear()
            pairs = [p for p in dict.fromkeys(x + y for x, y in zip(a, b, strict=True)) if p not in seen]
            seen.update(pairs)
            return output([p[:16] for p in pairs], [p[16:] for p in pairs])

        def output(a: list, b: list, node: pa.Array | None = None, sketch: pa.Array | None = None) -> pa.RecordBatch:
            n = len(a)
            columns = [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.nulls(n, pa.int64()) if node is None else node, pa.nulls(n, pa.binary()) if sketch is None else sketch]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "node", "sketch"])

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = batch.column("other").is_valid()
                edges.append(batch.filter(made))
                yield batch.filter(pc.invert(made))

        edges: list[pa.RecordBatch] = []
        first, of_node = None, None
        for table, bounds, excess in _Gathered("node", HELD)(passed(batches)):
            for batch in edges:
                yield fresh(batch.column("key").to_pylist(), batch.column("other").to_pylist())
            edges.clear()
            if excess and not last:
                whole = table.combine_chunks()
                yield output(whole.column("key").to_pylist(), [None] * len(whole), whole.column("node").chunk(0), whole.column("sketch").chunk(0))
                continue
            keys = table.column("key").to_pylist()
            if excess:
                if of_node != table.column("node")[0].as_py():
                    first, of_node = keys[0], table.column("node")[0].as_py()
                yield fresh([k for k in keys if k != first], [first] * sum(k != first for k in keys))
                continue
            sizes = np.diff(bounds)
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, PLACES)
            node = table.column("node").to_numpy().astype(np.int64).view(np.uint64)
            two = bounds[:-1][sizes == 2]
            x, y = sketches[two], sketches[two + 1]
            either = np.maximum(((x > 0) | (y > 0)).sum(1), 1)
            share = PERCENT / 100
            near = ((x == y) & (x > 0)).sum(1) / either >= share - DEVIATIONS * np.sqrt(share * (1 - share) / either)
            a, b = [two[near] + 1], [two[near]]
            for k in np.flatnonzero(sizes > 2):
                i, j = joined_in(sketches[bounds[k] : bounds[k + 1]], int(node[bounds[k]]), 1)
                a.append(bounds[k] + i)
                b.append(bounds[k] + j)
            a, b = np.concatenate(a).tolist(), np.concatenate(b).tolist()
            yield fresh([keys[k] for k in a], [keys[k] for k in b])
        for batch in edges:
            yield fresh(batch.column("key").to_pylist(), batch.column("other").to_pylist())

    dealt = level.repartition("node").sortWithinPartitions("node", "key")
    return dealt.mapInArrow(run, "a binary, b binary, node long, sketch binary")


def _clusters(classes: DataFrame) -> DataFrame:
    """node and root of every class that the trees join with a smaller one: components of the edges of all forests."""
    hot = hot_nodes(*_drawn(classes))
    found = materialize(_forests(_spread(classes, hot), DEPTH == 1), "forests")
    edges, depth, tables = found, 1, [found]
    while not (large := found.where("node is not null")).isEmpty():
        depth += 1
        found = materialize(_forests(_branched(large), depth >= DEPTH), "forests")
        edges = edges.union(found)
        tables.append(found)
    joined = connected_components(edges.where("b is not null").select("a", "b"))
    release(*tables)
    return joined


# --- exact tests


def set_of(raw: pa.Buffer | bytes) -> np.ndarray:
    """The sorted hashes of a full set."""
    return np.frombuffer(raw, np.uint64)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 * common >= 75 * together holds for two sorted sets, neither empty."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < PERCENT * len(y):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def common_sizes(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all of the first sets with all of the others, by products of 0-1 matrices of CHUNK shingles."""
    values = np.intersect1d(np.concatenate(sets), np.concatenate(others))
    places = []
    for side in (sets, others):
        row, all_values = np.repeat(np.arange(len(side)), [len(s) for s in side]), np.concatenate(side)
        at = np.minimum(np.searchsorted(values, all_values), max(0, len(values) - 1))
        shared = values[at] == all_values if len(values) else np.zeros(len(at), bool)
        places.append((row[shared], at[shared]))
    out = np.zeros((len(sets), len(others)), np.float32)
    for begin in range(0, len(values), CHUNK):
        ones = []
        for side, (row, at) in zip((sets, others), places, strict=True):
            matrix, here = np.zeros((len(side), CHUNK), np.float32), (at >= begin) & (at < begin + CHUNK)
            matrix[row[here], at[here] - begin] = 1
            ones.append(matrix)
        out += ones[0] @ ones[1].T
    return out.astype(np.int64)


def spanning(sketches: np.ndarray, sets: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    """Groups of the rows after all links between them, from groups (numbers of rows) known to be joined.

    Every pair of rows of different groups that its estimate doesn't rule out is tested on its full sets: one by one,
    and if many are left in a block, all at once.
    """
    label, blocks = group.copy(), range(0, len(sketches), PART)
    sizes = np.array([len(s) for s in sets])

    def join(a: int, b: int) -> None:
        low, high = sorted((label[a], label[b]))
        label[label == high] = low

    for first in blocks:
        for second in blocks[first // PART :]:
            mine, theirs = slice(first, first + PART), slice(second, second + PART)
            if label[mine].min() == label[mine].max() == label[theirs].min() == label[theirs].max():
                continue
            estimate, least = similarities(sketches[mine], sketches[theirs])
            near = (estimate >= least) & (label[mine, None] != label[None, theirs])
            x, y = np.nonzero(np.triu(near, 1) if first == second else near)
            order = np.argsort(-estimate[x, y], kind="stable")
            x, y = x[order] + first, y[order] + second
            tested = False
            while len(x):
                for a, b in zip(x[:64].tolist(), y[:64].tolist(), strict=True):
                    if label[a] != label[b] and (tested or linked(sets[a], sets[b])):
                        join(a, b)
                x, y = x[64:], y[64:]
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                if not tested and len(x) > ONE_BY_ONE:
                    common = common_sizes(sets[mine], sets[theirs])[x - first, y - second]
                    link = 100 * common >= PERCENT * (sizes[x] + sizes[y] - common)
                    x, y, tested = x[link], y[link], True
    return label


def _with_sets(rows: DataFrame) -> DataFrame:
    """Rows of a text, a key (null: that of the text) and more: those whose text has that key, with ``hashes`` (sorted shingle hashes) and sketch instead of the text."""
    rest = [c for c in rows.columns if c not in ("text", "key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, sets, sketches = [], [], [], []
            for k, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("key").to_pylist(), strict=True)):
                words = words_of(text.as_py())
                key = key_of(words)
                if key is not None and wanted in (None, key):  # else another row of that id
                    at.append(k)
                    keys.append(key)
                    hashes = shingle_set(words)
                    sets.append(hashes.tobytes())
                    sketches.append(sketch_of(minwise_tokens(hashes)).tobytes())
            columns = [*(batch.column(c).take(pa.array(at, pa.int64())) for c in rest), *(pa.array(c, pa.binary()) for c in (keys, sets, sketches))]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "key", "hashes", "sketch"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in rest), *(T.StructField(c, T.BinaryType()) for c in ("key", "hashes", "sketch"))]))


def _full_sets(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The members with hashes and sketch. A class comes once for each row of its ``rep`` that has its words."""
    named = members.where("rep is not null")
    likely = _perhaps_in(texts, named.select(F.col("rep").alias("doc_id")))
    sets = _with_sets(likely.join(named, F.col("doc_id") == F.col("rep")).select("text", *members.columns))
    nameless = members.where("rep is null")
    if nameless.isEmpty():
        return sets
    found = _with_sets(texts.where("doc_id is null").select("text", F.lit(None).cast("binary").alias("key"))).dropDuplicates(["key"])
    return sets.unionByName(nameless.join(found, "key"))


def _perhaps_in(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id is wanted, and some others: a bitmap of FILTER_BITS bits of the ids' hashes, broadcast, drops most of the rest."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bucket, bit = F.floor(place / BITMAP_BITS).alias("bucket"), F.pmod(place, F.lit(BITMAP_BITS)).cast("int")
    maps = wanted.select(bucket, bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = texts.withColumn("bucket", bucket).join(F.broadcast(maps), "bucket")
    return marked.where(F.call_function("shiftright", byte, F.pmod(bit, F.lit(8))).bitwiseAND(1) == 1).select(*texts.columns)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without repeated keys."""
    last = None
    for batch in batches:
        if batch.num_rows:
            keys = batch.column("key").to_pylist()
            new = [k != before for k, before in zip(keys, [last, *keys], strict=False)]
            last = keys[-1]
            yield batch.filter(pa.array(new))


def _tested(rows: DataFrame, names: T.DataType) -> DataFrame:
    """key, root (smallest key of its group) and component_id (smallest rep) of every class that links join with another of its task.

    The rows have task, key, rep, hashes, sketch and group (a key, or null: what is known to be joined).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds, _ in _Gathered("task", 1 << 62)(_once(batches)):
            found, roots, low = [], [], []
            keys, reps, groups = (table.column(c).to_pylist() for c in ("key", "rep", "group"))
            hashes, sketches = table.column("hashes").combine_chunks(), table.column("sketch").to_pylist()
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if end - begin < 2:
                    continue
                first: dict[bytes, int] = {}
                known = np.array([k if g is None else first.setdefault(g, k) for k, g in enumerate(groups[begin:end])])
                sets = [set_of(hashes[k].as_buffer()) for k in range(begin, end)]
                label = spanning(np.frombuffer(b"".join(sketches[begin:end]), np.uint8).reshape(-1, SKETCH), sets, known)
                best: dict[int, object] = {}
                for k, top in enumerate(label.tolist()):
                    if reps[begin + k] is not None:
                        best[top] = reps[begin + k] if top not in best else min(best[top], reps[begin + k])
                size = np.bincount(label, minlength=end - begin)
                for k, top in enumerate(label.tolist()):
                    if size[top] > 1:
                        found.append(keys[begin + k])
                        roots.append(keys[begin + top])
                        low.append(best.get(top))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(roots, pa.binary()), pa.array(low, table.schema.field("rep").type)], ["key", "root", "component_id"])

    dealt = rows.select("task", "key", "rep", "hashes", "sketch", "group").repartition("task").sortWithinPartitions("task", "key")
    return dealt.mapInArrow(run, T.StructType([T.StructField("key", T.BinaryType()), T.StructField("root", T.BinaryType()), T.StructField("component_id", names)]))


def _part_of(size: int, salt: int) -> Column:
    """A part by the key's hash, of about ``size`` of the n rows."""
    return F.pmod(F.xxhash64(F.lit(salt), "key"), F.ceil(F.col("n") / size))


def _large_clusters(sets: DataFrame, names: T.DataType) -> DataFrame:
    """key and root of the classes that links join in clusters too large for one task; sets has cluster, n, key, rep, hashes and sketch."""
    members = sets.select("cluster", "n", "key")
    full = sets.select("key", "rep", "hashes", "sketch")

    def tested(rows: DataFrame, label: str) -> DataFrame:
        return materialize(_tested(rows.join(full, "key"), names).select(F.col("key").alias("a"), F.col("root").alias("b")), label)

    parts = members.select("cluster", "key", _part_of(PART, 1).alias("part"))
    shared = members.where(_part_of(SHARED, 2) == 0).select("cluster", "key", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PART) - 1)).alias("part"))
    within = parts.union(shared).distinct().select(F.xxhash64("cluster", "part").alias("task"), "key", F.lit(None).cast("binary").alias("group"))
    links = tested(within, "part-links")
    groups = connected_components(links)
    named = materialize(parts.join(groups.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("group", F.coalesce("root", "key")).drop("root"), "grouped")
    sizes = named.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max_by("group", F.struct("n", "group")).alias("group"))
    outside = materialize(named.join(largest, ["cluster", "group"], "left_anti"), "outside")
    if outside.isEmpty():
        return groups
    counted = outside.join(outside.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster").select("cluster", "key", "group", _part_of(PART, 3).alias("block"))
    blocks = counted.select("cluster", "block").distinct()
    tasks = named.select("cluster", "part").distinct().join(blocks, "cluster")
    task = F.xxhash64("cluster", "part", "block").alias("task")
    rows = named.join(blocks, "cluster").select(task, "key", "group").union(tasks.join(counted, ["cluster", "block"]).select(task, "key", "group")).distinct()
    return connected_components(links.union(tested(rows, "block-links")))


def _linked_classes(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """key, root (smallest key of the group) and component_id (smallest rep) of every class that has a link."""
    names = classes.schema["rep"].dataType
    state = _clusters(classes)
    clusters = state.select(F.col("node").alias("key"), F.col("root").alias("cluster")).union(state.select("root", "root").distinct())
    found = clusters.join(classes.select("key", "rep", "n_shingles"), "key")
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("together"))
    members = materialize(found.drop("n_shingles").join(sizes, "cluster").select("cluster", "key", "rep", "n", (F.col("together") * 8).alias("size")), "clusters")
    release(state)
    sets = materialize(_full_sets(texts, members), "sets")
    fits = (F.col("n") <= CLUSTER) & (F.col("size") <= CLUSTER_BYTES)
    small = sets.where(fits).select(F.xxhash64("cluster").alias("task"), "key", "rep", "hashes", "sketch", F.lit(None).cast("binary").alias("group"))
    groups = materialize(_tested(small, names), "groups")
    if members.where(~fits).isEmpty():
        release(sets, members)
        return groups
    found = materialize(_large_clusters(sets.where(~fits).dropDuplicates(["key"]), names), "large-groups")
    release(sets, members)
    of_root = found.select(F.col("node").alias("key"), "root").union(found.select("root", "root").distinct()).join(classes.select("key", "rep"), "key")
    return groups.union(of_root.join(of_root.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("key", "root", "component_id"))


def _classified(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their n_shingles and key, without text; and key, root and component_id of every class that has more than one row or a link."""
    rows = materialize(_documents(texts), "near-dup-rows")
    classes = materialize(
        rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("tokens").alias("tokens")),
        "near-dup-classes",
    )
    of_class = classes.select("key", "rep", "copies").join(_linked_classes(texts.select("doc_id", "text"), classes), "key", "left").where("copies > 1 or root is not null")
    root = F.col("root").isNull()
    groups = of_class.select("key", F.coalesce("root", "key").alias("root"), F.when(root, F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.drop("tokens"), materialize(groups, "near-dup-groups")  # written, so that Spark can split the rows of a class with many copies


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id of its group) and kept (whether that is its own)."""
    texts = bounded(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, groups = _classified(texts)
    out = rows.join(groups, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, one of each near-duplicate group; all that have no words.

    Rows are told apart by what they hold, not by their ids: of a group stays the row of the smallest id (rows without
    one come last), among equal ids that of the smallest class and row hash, and of wholly equal rows any one.
    """
    hashed = [c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString() and "variant" not in df.schema[c].dataType.simpleString()]
    taken = set(df.columns)
    key, row = (next(n for n in (f"{base}_{k}" for k in range(len(taken) + 1)) if n not in taken) for base in ("key", "row"))
    rows, groups = _classified(bounded(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(*hashed).alias("row")))
    rooted = rows.where("key is not null").join(groups.select("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key", "row")
    first = rooted.groupBy("root", order.alias("at")).agg(F.count(F.lit(1)).alias("copies")).groupBy("root").agg(F.min_by(F.struct("at", "copies"), "at").alias("first"))
    first = first.select(F.col("first.at.doc_id").alias("first_id"), F.col("first.at.key").alias("first_key"), F.col("first.at.row").alias("first_row"), "first.copies")
    names, text = df.columns, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(words_of(t.as_py())) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*names, row, key])

    keyed = df.withColumn(row, F.xxhash64(*hashed)).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(row, T.LongType()), T.StructField(key, T.BinaryType())]))
    same = (F.col(key) == F.col("first_key")) & (F.col(row) == F.col("first_row")) & F.col(id_col).eqNullSafe(F.col("first_id"))
    once = keyed.join(first.where("copies = 1"), same, "left_semi")
    repeated = keyed.join(first.where("copies > 1"), same, "left_semi").dropDuplicates([key, row])
    return once.union(repeated).union(keyed.where(F.col(key).isNull())).select(*names)
