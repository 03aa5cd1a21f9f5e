"""Toxicity by non-negative positive-unlabelled learning in numpy.

The classifier learns from confirmed toxic texts and from texts whose label isn't looked at,
of which a share of ``prior`` is toxic. With losses l+ and l- of calling a text toxic and
clean, the risk is ``prior * P[l+] + max(0, U[l-] - prior * P[l-])``: the clean part of the
unlabelled texts is what is left when the toxic share is taken away, and a negative rest,
a sign of fitting single texts, is pushed back up. ``prior`` is the toxic share of the
labelled rows that may be learned from.

A text's score is the sigmoid of a bias and the weights of its distinct words; a word's
weight is the sum of those of its hashed parts: the word, its beginning, and its runs of
``GRAM`` letters, so that inflected forms share what they have learned.

Rules: null texts are empty and have the score of the bias; equal texts have equal scores;
repeated rows are scored separately; labels of ids outside the table, null labels and null
ids are not used; a label row repeated counts once, toxic if any says so; of rows that share
an id the least text is learned from; without toxic labels every score is that of a bias of
-60, about 0; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.caches import bounded, keep
from weftline.plans.scratch import materialize

#: The training sample: most confirmed toxic and most unlabelled texts, taken by the hash of the id. All of their words count.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 12000
BUCKETS, GRAM = 1 << 18, 5
#: Parts in more than this share of the texts, on average, have no weight.
COMMON = 0.3
#: Steps: a fixed number, as held-out accuracy still rises while the risk hardly falls.
EPOCHS, RATE, SHRINK = 250, 0.01, 0.001
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000


def parts_of(word: str) -> list[int]:
    """Buckets of the word, of its first four and five letters, and of its letter runs."""
    parts = {"=" + word, "^" + word[:4], "^" + word[:GRAM]}
    parts.update(word[i : i + GRAM] for i in range(len(word) - GRAM + 1))
    return sorted({zlib.crc32(p.encode()) % BUCKETS for p in parts})


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def word_weight(self, word: str) -> float:
        return float(self.weights[parts_of(word)].sum())

    def score(self, total: float) -> float:
        """The score of a text whose words' weights sum to ``total``."""
        return float(1 / (1 + np.exp(-np.clip(total + self.bias, -60, 60))))


class _WordWeights(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE:
            self.clear()
        out = self[word] = self.model.word_weight(word)
        return out


class Incidence:
    """Which of ``width`` columns each row has (``columns``, up to ``ends`` of each row), for sums of what stands in a row's columns, and of what its rows give to a column."""

    def __init__(self, columns: np.ndarray, ends: np.ndarray, width: int):
        self.columns, self.width = columns.astype(np.int32), width
        order = np.argsort(self.columns, kind="stable").astype(np.int32)
        self.rows = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))[order]
        self.row_ends, self.column_ends = ends, np.cumsum(np.r_[0, np.bincount(self.columns, minlength=width)])

    @classmethod
    def of(cls, rows: Iterable[np.ndarray], width: int) -> Incidence:
        flat, ends = array("i"), [0]
        for row in rows:
            flat.extend(row)
            ends.append(len(flat))
        return cls(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.array(ends), width)

    @staticmethod
    def _grouped(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, full = np.zeros(len(ends) - 1), np.flatnonzero(ends[:-1] < ends[1:])
        if len(full):
            out[full] = np.add.reduceat(values, ends[:-1][full])
        return out

    def sums(self, columns: np.ndarray) -> np.ndarray:
        return self._grouped(columns[self.columns], self.row_ends)

    def back(self, rows: np.ndarray) -> np.ndarray:
        return self._grouped(rows[self.rows], self.column_ends)


def parts_of_words(words: Iterable[str]) -> Incidence:
    """The parts of each word; the column after the last part is for a bias."""
    return Incidence.of(map(parts_of, words), BUCKETS + 1)


def fit(text_words: Incidence, word_parts: Incidence, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the risk over texts given by the words they have and words by their parts, by scaled gradient steps with momentum on the whole sample."""
    if not positive.any() or not unlabelled.any():
        return Model(np.zeros(BUCKETS, np.float32), -60.0)
    share_p, share_u = positive / positive.sum(), unlabelled / unlabelled.sum()
    # Each part's step is scaled by how often it occurs, so that common parts don't overshoot and a part of a single text moves little.
    often = word_parts.back(text_words.back(prior * share_p + share_u))
    scale = np.where(often > COMMON * (1 + prior), 0, RATE / (often + SHRINK))
    scale[-1] = RATE
    theta, pace = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for _ in range(EPOCHS):
        z = text_words.sums(word_parts.sums(theta)) + theta[-1]
        toxic = 1 / (1 + np.exp(-np.clip(z, -60, 60)))  # slope of l-; that of l+ is toxic - 1
        loss = np.logaddexp(0, z)
        rest = share_u @ loss - prior * (share_p @ loss)
        slope = (share_u - prior * share_p) * toxic
        slope = prior * share_p * (toxic - 1) + slope if rest >= 0 else -slope
        grad = word_parts.back(text_words.back(slope))
        grad[-1] = slope.sum()
        grad[:-1] += SHRINK * theta[:-1]
        pace = 0.9 * pace - scale * grad
        theta += pace
    return Model(theta[:-1].astype(np.float32), float(theta[-1]))


def may_learn(doc_id: Column) -> Column:
    """Whether labels of this id may be learned from; the others are held out."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != 0


def _first_by_hash(ids: DataFrame, most: int, salt: int) -> DataFrame:
    return ids.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(most)


def train(texts: DataFrame, labels: DataFrame) -> Model:
    """Fit on bounded samples of the (doc_id, text) rows; labels has doc_id and toxic."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may_learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = usable.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    if prior == 0:
        return Model(np.zeros(BUCKETS, np.float32), -60.0)
    positive = _first_by_hash(usable.where("toxic = 1").select("doc_id"), MOST_POSITIVE, 1).withColumn("positive", F.lit(True))
    known = texts.where(F.col("doc_id").isNotNull() & may_learn(F.col("doc_id"))).select("doc_id").distinct()
    unlabelled = _first_by_hash(known, MOST_UNLABELLED, 2).withColumn("unlabelled", F.lit(True))
    chosen = positive.join(unlabelled, "doc_id", "full").select("doc_id", F.coalesce("positive", F.lit(False)).alias("positive"), F.coalesce("unlabelled", F.lit(False)).alias("unlabelled"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([sorted(distinct_words(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], ["positive", "unlabelled", "words"])

    # The chosen ids are at most MOST_POSITIVE + MOST_UNLABELLED rows; each gives one text.
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive", "unlabelled").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = materialize(one.select("positive", "unlabelled", "text").mapInArrow(split, "positive boolean, unlabelled boolean, words array<string>"), "toxicity-sample")
    rows = sample.toArrow()
    flags = [rows.column(c).to_numpy().astype(float) for c in ("positive", "unlabelled")]
    lists = rows.column("words").combine_chunks()
    coded, ends = lists.flatten().dictionary_encode(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = coded.dictionary
    by_name = pc.array_sort_indices(words)
    rank = np.empty(len(words), np.int32)
    rank[by_name.to_numpy()] = np.arange(len(words), dtype=np.int32)
    columns = rank[coded.indices.to_numpy()]
    del rows, lists, coded
    word_parts = parts_of_words(w.as_py() for w in words.take(by_name))
    del words, by_name
    # Sums in one order, whatever order the rows came in.
    order = np.array(sorted(range(len(ends) - 1), key=lambda k: columns[ends[k] : ends[k + 1]].tobytes()), np.int64)
    lengths = np.diff(ends)[order]
    columns = np.concatenate([columns[ends[k] : ends[k + 1]] for k in order] or [columns])
    text_words = Incidence(columns, np.cumsum(np.r_[0, lengths]), word_parts.row_ends.size - 1)
    return fit(text_words, word_parts, *(f[order] for f in flags), prior)


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every whole text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _weights_of(model).__getitem__
        for batch in batches:
            scores = [model.score(sum(map(weight, sorted(distinct_words(t))))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def _weights_of(model: Model) -> _WordWeights:
    """The model's word weights that this worker keeps from task to task."""
    return keep(("toxicity", zlib.crc32(model.weights.tobytes()), model.bias), lambda: _WordWeights(model))


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 at 0.5 or more) of every document."""
    texts = bounded(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = score_texts(texts, train(texts, labels.select("doc_id", "toxic")))
    return scored.select("doc_id", F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with their columns, whose text scores below 0.5; clashing names don't matter, as columns go by place."""
    names, schema = bounded(df).columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _weights_of(model).__getitem__
        for batch in batches:
            clean = [model.score(sum(map(weight, sorted(distinct_words(t))))) < 0.5 for t in batch.column(names.index(text_col)).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return df.mapInArrow(run, schema)
