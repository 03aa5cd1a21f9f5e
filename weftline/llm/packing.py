"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Terms are token ids, so term statistics have at most a row a vocabulary entry. Documents go
to index shards by what they are about: the weights of a document's terms are projected on
``PROJECTIONS`` fixed random directions, and a tree of splits, learned from a bounded sample
of these vectors, sends lexically close documents to one shard. Each shard builds an inverted
index of its documents, weighted by document frequencies over the whole corpus: postings of
each term, and for the terms that most documents of a shard share a matrix, which is the
cheaper form of the same sums. Taking documents in order, a seed fills windows of
``WINDOW`` ids; the room left after its end goes to its best unused neighbours, and a
neighbour that is cut goes on as the seed of the next window. The last, partial window of a
shard is written as sequences whose lengths are powers of two, which need no padding.

All terms of a seed count, and neighbours are ranked until the window is full or none is
left that shares a term. A neighbour is looked for in the seed's own shard.

Rules: a null text is empty; a document's ids end with ``end_id``, so none is without ids;
each id lies in exactly one piece; repeated rows are packed separately; an empty table gives
no pieces; extra columns are ignored. A leaf of the tree that is too large for one shard, as
copies make it, is dealt over several by row.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import vocab
from weftline.llm.caches import bounded
from weftline.plans.scratch import new_path

WINDOW = 1024
#: Documents of one index shard, which a task holds in memory; a document counts as one for each DOCUMENT_TOKENS tokens or part of them.
SHARD_DOCUMENTS, DOCUMENT_TOKENS = 4096, 1024
#: Directions that term weights are projected on, and documents of the sample that the tree of splits is learned from, in all and least in a leaf.
PROJECTIONS, DRAWN, LEAST_DRAWN = 64, 32768, 16
#: Share of a shard's documents from which a term is held in a matrix.
DENSE_SHARE = 0.13
#: BM25's constants.
K1, B = 1.2, 0.75
#: Neighbours that are sorted first; the next ones are sorted when these are used up.
FIRST_RANKED = 8


@dataclass
class TermStatistics:
    """Over the whole corpus: documents, mean tokens of one, and documents of each term."""

    documents: int
    mean_tokens: float
    frequency: np.ndarray

    def idf(self) -> np.ndarray:
        """BM25's inverse document frequency, above 0 for every term."""
        return np.log1p((self.documents - self.frequency + 0.5) / (self.frequency + 0.5)).astype(np.float32)


class InvertedIndex:
    """BM25 index of the documents of one shard."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, statistics: TermStatistics):
        idf = statistics.idf()
        n = self.size = len(ends)
        lengths = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(n, dtype=np.int64), lengths)
        keys, counts = np.unique(ids.astype(np.int64) * n + doc, return_counts=True)
        terms, docs = keys // n, keys % n
        shrink = K1 * (1 - B + B * lengths / max(1.0, statistics.mean_tokens))
        weights = idf[terms].astype(np.float64) * counts * (K1 + 1) / (counts + shrink[docs])
        edges = np.flatnonzero(np.diff(terms, prepend=-1, append=-1))
        sizes = np.diff(edges)
        place = np.repeat(np.arange(len(sizes)), sizes)
        dense = sizes >= max(2, DENSE_SHARE * n)
        column = np.cumsum(dense) - 1
        held = dense[place]
        matrix = np.zeros((n, int(dense.sum())), np.float32)
        matrix[docs[held], column[place[held]]] = weights[held]
        #: Scores by the terms held in the matrix: of all documents (columns) for each seed (rows).
        self.common = (matrix > 0).astype(np.float32) @ matrix.T
        self.docs, self.weights = docs, weights
        # Postings of each document's other terms; a term of one document finds no neighbour.
        entry = np.flatnonzero(~held & (sizes > 1)[place])
        entry = entry[np.argsort(docs[entry], kind="stable")]
        self.first, self.last = edges[:-1][place[entry]].tolist(), edges[1:][place[entry]].tolist()
        self.of_doc = np.searchsorted(docs[entry], np.arange(n + 1)).tolist()

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document for all terms of the seed."""
        mine = slice(self.of_doc[seed], self.of_doc[seed + 1])
        lists = list(map(slice, self.first[mine], self.last[mine]))
        if not lists:
            return self.common[seed].astype(np.float64)
        docs, weights = (np.concatenate([x[part] for part in lists]) for x in (self.docs, self.weights))
        return np.bincount(docs, weights, self.size) + self.common[seed]

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, by falling score, then by place."""
        scores, most = self.scores(seed) * unused, FIRST_RANKED
        while True:
            least = np.partition(scores, self.size - most)[self.size - most] if most < self.size else 0.0
            found = np.flatnonzero(scores >= least) if least > 0 else np.flatnonzero(scores)
            yield from found[np.argsort(-scores[found], kind="stable")].tolist()
            if least <= 0:
                return
            scores[found] = 0
            most *= 8


@dataclass
class Pieces:
    """Runs of document ids in the order of their sequences."""

    doc: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)

    def add(self, doc: int, start: int, length: int, sequence: int, offset: int) -> None:
        self.doc.append(doc)
        self.start.append(start)
        self.length.append(length)
        self.sequence.append(sequence)
        self.offset.append(offset)


def pack_order(lengths: list[int], index: InvertedIndex) -> Iterator[int]:
    """Documents in the order in which they fill windows: a seed, its neighbours while its window has room, and so on."""
    unused = np.ones(len(lengths), np.float32)
    filled, cursor, seed = 0, 0, -1
    ranked: Iterator[int] = iter(())
    for _ in range(len(lengths)):
        if filled == 0:
            ranked = iter(())
        elif seed >= 0:
            ranked, seed = index.neighbours(seed, unused), -1
        doc = next(ranked, -1)
        if doc < 0:
            while not unused[cursor]:
                cursor += 1
            doc = cursor
        unused[doc] = 0
        yield doc
        if filled == 0 or filled + lengths[doc] >= WINDOW:
            seed = doc  # it opens the window that is now being filled
        filled = (filled + lengths[doc]) % WINDOW


def pack_shard(lengths: list[int], index: InvertedIndex) -> Pieces:
    """Cut documents into windows in packing order; the tail becomes sequences of power-of-two lengths."""
    total = sum(lengths)
    full = total // WINDOW
    rooms = [WINDOW] * full + [1 << k for k in reversed(range(WINDOW.bit_length())) if (total - full * WINDOW) >> k & 1]
    pieces, sequence, offset = Pieces(), 0, 0
    for doc in pack_order(lengths, index):
        start = 0
        while start < lengths[doc]:
            take = min(lengths[doc] - start, rooms[sequence] - offset)
            pieces.add(doc, start, take, sequence, offset)
            start, offset = start + take, offset + take
            if offset == rooms[sequence]:
                sequence, offset = sequence + 1, 0
    return pieces


@lru_cache(1)
def _directions(size: int) -> np.ndarray:
    """A row a term: its random signs, times how rare terms of its rank are taken to be (merges come in order of falling frequency)."""
    signs = np.random.default_rng(11).integers(0, 2, (size, PROJECTIONS)).astype(np.float32) * 2 - 1
    return signs * np.log1p(np.arange(size, dtype=np.float32))[:, None]


def _tokens_with_vectors(df: DataFrame, vocab_path: str, end_id: int) -> DataFrame:
    """Scratch table by ``kind``: documents (ids and projected term weights), and for each task one row of document frequencies."""
    kind = df.schema["doc_id"].dataType.simpleString()
    size = max(vocab.encoder(vocab_path).vocab_size, end_id + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, directions = vocab.encoder(vocab_path), _directions(size)
        end = np.array([end_id], enc.dtype).tobytes()
        frequency, seen = np.zeros(size, np.int64), np.zeros(size, bool)
        names = ["doc_id", "n_tokens", "vector", "ids", "kind"]
        for batch in batches:
            ids, vectors = [], np.zeros((batch.num_rows, PROJECTIONS), np.float32)
            for k, text in enumerate(batch.column(1)):
                ids.append(enc.encode(text.as_py() or "") + end)
                own = np.frombuffer(ids[-1], enc.dtype)
                seen[own] = True
                distinct = np.flatnonzero(seen)
                seen[own] = False
                frequency[distinct] += 1
                vectors[k] = directions[distinct].sum(0)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            counts = pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(map(bytes, vectors.astype(np.float16)), pa.binary()), pa.array(ids, pa.binary()), pa.array(["doc"] * len(ids), pa.string())], names)
        if frequency.any():
            nothing = pa.nulls(1, batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([nothing, pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([frequency.tobytes()], pa.binary()), pa.array(["frequency"])], names)

    rows = bounded(df).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, vector binary, ids binary, kind string")
    path = new_path(df.sparkSession, "packing-tokens")
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _statistics(tokens: DataFrame, size: int) -> TermStatistics:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])

    rows = tokens.where("kind = 'frequency'").select("ids").mapInArrow(add, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(size, np.int64)
    for row in rows:  # a row a vocabulary entry at most
        frequency[row["term"]] = row["n"]
    docs, total = tokens.where("kind = 'doc'").agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    return TermStatistics(docs, (total or 0) / max(1, docs), frequency)


@dataclass
class SplitTree:
    """Binary splits of vectors by a direction and a bound; a node without children is a leaf."""

    directions: np.ndarray
    bounds: np.ndarray
    below: np.ndarray

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The node at which each vector ends."""
        node = np.zeros(len(vectors), np.int64)
        while True:
            inner = np.flatnonzero(self.below[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            right = _line(vectors[inner], self.directions[at]) > self.bounds[at]
            node[inner] = self.below[at] + right


def _line(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Projection of each vector on its direction, in steps that rounding can't part."""
    return np.round(np.einsum("ij,ij->i", vectors, directions), 5)


def learn_tree(vectors: np.ndarray, weights: np.ndarray, most: float) -> SplitTree:
    """Split rows by their widest direction at the middle of their weight, until a leaf weighs ``most`` or has too few rows to be split."""
    directions, bounds, below, members = [], [], [], [np.arange(len(vectors))]
    for node in itertools.count():
        if node == len(members):
            return SplitTree(np.array(directions).reshape(-1, vectors.shape[1]), np.array(bounds), np.array(below, np.int64))
        rows = members[node]
        directions.append(np.zeros(vectors.shape[1]))
        bounds.append(0.0)
        below.append(-1)
        if weights[rows].sum() <= most or len(rows) < 2 * LEAST_DRAWN:
            continue
        direction = np.linalg.eigh(np.cov(vectors[rows], rowvar=False, aweights=weights[rows]))[1][:, -1]
        line = _line(vectors[rows], np.broadcast_to(direction, (len(rows), len(direction))))
        order = np.argsort(line, kind="stable")
        middle = np.searchsorted(np.cumsum(weights[rows][order]), weights[rows].sum() / 2)
        bound = line[order][min(middle, len(rows) - 1)]
        if not (line > bound).any():
            bound -= 1e-6  # the upper half is one value
        right = line > bound
        if right.all() or not right.any():
            continue
        directions[node], bounds[node], below[node] = direction, bound, len(members)
        members += [rows[~right], rows[right]]


def _size(n_tokens: np.ndarray) -> np.ndarray:
    """As how many documents of a shard documents of so many tokens count."""
    return -(-n_tokens // DOCUMENT_TOKENS)


def _tree(documents: DataFrame, count: int) -> SplitTree:
    """Learned from about DRAWN rows."""
    rate = max(1, -(-count // DRAWN))
    rows = documents.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(rate)) == 0).select("vector", "n_tokens").collect()
    vectors = np.frombuffer(b"".join(r["vector"] for r in rows), np.float16).reshape(-1, PROJECTIONS).astype(np.float64)
    return learn_tree(vectors, _size(np.array([r["n_tokens"] for r in rows], np.int64)).astype(np.float64) * rate, SHARD_DOCUMENTS)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, PROJECTIONS).astype(np.float64)


def _shards_of_leaves(documents: DataFrame, tree: SplitTree) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each node of the tree, by the sizes of all documents in its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tree.below), np.int64)
        for batch in batches:
            if batch.num_rows:
                np.add.at(total, tree.leaves(_vectors(batch.column(0))), _size(batch.column(1).to_numpy()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["leaf", "n"])

    sums = documents.select("vector", "n_tokens").mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    parts = np.zeros(len(tree.below), np.int64)
    for row in sums:  # a row a leaf at most, and these come from a bounded sample
        parts[row["leaf"]] = -(-row["n"] // SHARD_DOCUMENTS)
    return np.cumsum(parts) - parts, parts


def _sharded(documents: DataFrame, tree: SplitTree) -> DataFrame:
    """doc_id, ids and shard of every document."""
    first, parts = _shards_of_leaves(documents, tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.leaves(_vectors(batch.column("vector")))
                part = batch.column("row").to_numpy() % parts[leaf]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(first[leaf] + part)], ["doc_id", "ids", "shard"])

    numbered = documents.select("doc_id", "ids", "vector", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 62)).alias("row"))
    return numbered.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids binary, shard long")


def pack_documents(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids as little-endian unsigned 32-bit integers unless left out."""
    enc = vocab.encoder(vocab_path)
    dtype = enc.dtype
    tokens = _tokens_with_vectors(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), vocab_path, end_id)
    statistics = _statistics(tokens, max(enc.vocab_size, end_id + 1))
    placed = tokens.where("kind = 'doc'")
    documents = _sharded(placed, _tree(placed, statistics.documents))
    kind = df.schema[id_col].dataType.simpleString()

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        table = table.combine_chunks()
        raws, doc_ids = table.column("ids").to_pylist(), table.column("doc_id").to_pylist()
        order = sorted(range(len(raws)), key=lambda k: (doc_ids[k] is not None, 0 if doc_ids[k] is None else doc_ids[k], raws[k]))
        raws = [raws[k] for k in order]
        lengths = [len(x) // dtype.itemsize for x in raws]
        ends = np.cumsum(lengths)
        ids = np.frombuffer(b"".join(raws), dtype)
        pieces = pack_shard(lengths, InvertedIndex(ids, ends, statistics))
        wide = memoryview(ids.astype("<u4").tobytes())
        begins = (ends - lengths).tolist()
        cut = [wide[4 * (begins[d] + s) : 4 * (begins[d] + s + n)] for d, s, n in zip(pieces.doc, pieces.start, pieces.length, strict=True)]
        columns = {
            "doc_id": table.column("doc_id").take(pa.array([order[d] for d in pieces.doc], pa.int64())),
            "start": pa.array(pieces.start, pa.int64()),
            "length": pa.array(pieces.length, pa.int64()),
            "ids_crc32": pa.array(map(zlib.crc32, cut), pa.int64()),
            "doc_tokens": pa.array([lengths[d] for d in pieces.doc], pa.int64()),
            "sequence_id": pa.array([(shard << 32) + s for s in pieces.sequence], pa.int64()),
            "offset": pa.array(pieces.offset, pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array(map(bytes, cut), pa.binary())
        return pa.table(columns)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return documents.groupBy("shard").applyInArrow(pack, schema)
