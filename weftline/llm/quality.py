"""Quality scores from weak labels: a label model by expectation-maximisation, then a hashed linear scorer.

Heuristic labellers look at a text and vote good or bad, or are silent; most look for one
fault and vote only where they find it. They overlap and err. The label model estimates
each labeller's accuracy, the chance that its vote is right, from how often each pattern of
votes occurs over all documents: labellers that agree with the rest are trusted more. It
needs no true labels; silence says nothing. Each pattern so gets a posterior chance of being
good. These train a linear model on hashed features of a bounded sample of texts, taken
evenly over the patterns, which scores every text, also those on which all are silent.

Features are the shapes of a text's tokens (runs of letter, capital, digit and other signs),
whether tokens repeat the one before, and coarse bins of a few ratios.

Rules: null texts are empty; a text without tokens has no votes and is scored by its bins;
equal texts have equal scores; repeated rows are scored separately and all count in the
label model; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.caches import bounded, keep
from weftline.plans.scratch import materialize

GOOD, BAD, SILENT = 1, 0, 2
#: Most texts of the scorer's sample, and most of one pattern of votes.
SAMPLE, OF_PATTERN = 8000, 2000
BUCKETS, EPOCHS, RATE, SHRINK = 1 << 16, 300, 0.5, 1e-4
#: Texts scoring less are rejected.
THRESHOLD = 0.5
#: Shapes that a worker keeps, and the longest token whose shape is kept.
_CACHE, _CACHED_LENGTH = 150_000, 64


def _shape(token: str) -> str:
    """Classes of a token's characters, runs folded; other signs stand for themselves."""
    out, last = [], ""
    for c in token:
        k = "U" if c.isupper() else "l" if c.isalpha() else "9" if c.isdigit() else c
        if k != last:
            out.append(k)
        elif len(out) < 2 or out[-1] != "+":
            if not (c.isalnum()):
                out.append("+")
        last = k
    return "".join(out)


class _Shapes(dict):
    def __missing__(self, token: str) -> str:
        if len(token) > _CACHED_LENGTH:
            return _shape(token)
        if len(self) >= _CACHE:
            self.clear()
        out = self[token] = _shape(token)
        return out


@dataclass
class Facts:
    """What labellers and features look at."""

    tokens: int
    shapes: Counter
    capitals: float  # tokens of several capitals
    signs: float  # tokens that end in a run of signs
    bare: float  # tokens without a letter or digit
    digits: float  # tokens of digits
    shouting: float  # tokens with a doubled exclamation or question mark
    repeats: float  # tokens equal to the one before
    distinct: float  # distinct tokens
    lines_again: float  # lines met before
    mean_length: float
    short: float  # plain words of up to three letters
    commonest: float  # occurrences of the commonest token
    pairs: float  # distinct pairs of neighbouring tokens
    plain: float  # words in small letters, with at most a sign after them


def facts_of(text: str | None) -> Facts:
    text = text or ""
    tokens = text.split()
    n = max(1, len(tokens))
    shapes = Counter(map(keep("shapes", _Shapes).__getitem__, tokens))
    counts = Counter(tokens)
    share = lambda test: sum(c for s, c in shapes.items() if test(s)) / n
    lines = [line for line in text.split("\n") if line]
    return Facts(
        tokens=len(tokens),
        shapes=shapes,
        capitals=share(lambda s: s.startswith("U") and "l" not in s),
        signs=share(lambda s: s.endswith("+")),
        bare=share(lambda s: not any(k in s for k in "Ul9")),
        digits=share(lambda s: "9" in s and "l" not in s and "U" not in s),
        shouting=share(lambda s: "!+" in s or "?+" in s),
        repeats=sum(map(str.__eq__, tokens, tokens[1:])) / n,
        distinct=len(counts) / n,
        commonest=max(counts.values(), default=0) / n,
        pairs=len(set(zip(tokens, tokens[1:], strict=False))) / n,
        lines_again=1 - len(set(lines)) / max(1, len(lines)),
        mean_length=sum(map(len, tokens)) / n,
        short=sum(len(t) <= 3 and t.isalpha() for t in tokens) / n,
        plain=share(lambda s: s.lstrip("U").startswith("l") and len(s.lstrip("U")) <= 2),
    )


def _fault(found: bool) -> int:
    return BAD if found else SILENT


#: The labellers by name. Their bounds are guesses about text in general; how far to trust each is for the label model to find out.
LABELLERS = {
    "capitals": lambda f: _fault(f.capitals >= 0.25),
    "signs": lambda f: _fault(f.signs >= 0.15),
    "bare": lambda f: _fault(f.bare >= 0.12),
    "digits": lambda f: _fault(f.digits >= 0.4),
    "shouting": lambda f: _fault(f.shouting >= 0.15),
    "repeats": lambda f: _fault(f.repeats >= 0.15 and f.tokens >= 10),
    "lines": lambda f: _fault(f.lines_again >= 0.5),
    "length": lambda f: _fault(f.tokens >= 5 and not 2.5 <= f.mean_length <= 10),
    "distinct": lambda f: _fault(f.distinct <= 0.25 and f.tokens >= 20),
    "short": lambda f: _fault(f.short <= 0.05 and f.tokens >= 20),
    "plain": lambda f: _fault(f.plain <= 0.55 and f.tokens >= 10),
    "commonest": lambda f: _fault(f.commonest >= 0.2 and f.tokens >= 10),
    "pairs": lambda f: _fault(f.pairs <= 0.5 and f.tokens >= 20),
    "prose": lambda f: GOOD if f.tokens >= 5 and f.plain >= 0.7 and f.distinct >= 0.4 and f.bare <= 0.05 and f.repeats <= 0.05 else SILENT,
    "wording": lambda f: GOOD if f.tokens >= 10 and f.short >= 0.1 and f.capitals <= 0.1 and f.commonest <= 0.15 and f.pairs >= 0.7 else SILENT,
}


def votes_of(facts: Facts) -> str:
    """A digit for each labeller; all are silent on a text without tokens."""
    return "".join(str(vote(facts) if facts.tokens else SILENT) for vote in LABELLERS.values())


def features_of(facts: Facts) -> dict[int, float]:
    """Hashed features: shares of token shapes, and bins of the ratios."""
    n = max(1, facts.tokens)
    named = {f"shape {s}": (c / n) ** 0.5 for s, c in facts.shapes.items()}
    for name in ("capitals", "signs", "bare", "digits", "shouting", "repeats", "distinct", "lines_again", "short", "plain", "pairs"):
        named[f"{name} {min(9, int(getattr(facts, name) * 10))}"] = 1.0
    named[f"length {min(12, int(facts.mean_length))}"] = 1.0
    named[f"tokens {min(12, facts.tokens.bit_length())}"] = 0.3
    out: dict[int, float] = {}
    for name, value in named.items():
        k = zlib.crc32(name.encode()) % BUCKETS
        out[k] = out.get(k, 0.0) + value
    return out


@dataclass
class LabelModel:
    """The share of good texts and the accuracy of each labeller's votes."""

    good: float
    accuracy: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Chance of each pattern of votes to be of a good text."""
        votes = np.array([[int(v) for v in p] for p in patterns]).reshape(len(patterns), -1)
        trust = np.log(self.accuracy / (1 - self.accuracy))
        z = np.log(self.good / (1 - self.good)) + ((votes == GOOD) * trust).sum(1) - ((votes == BAD) * trust).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def accuracies(self) -> dict[str, float]:
        return dict(zip(LABELLERS, self.accuracy.tolist(), strict=True))


def fit_label_model(patterns: dict[str, int], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over pattern counts, begun with labellers that are right four times of five and as many good texts."""
    names, counts = list(patterns), np.array(list(patterns.values()), float)
    votes = np.array([[int(v) for v in p] for p in names])
    model = LabelModel(0.8, np.full(votes.shape[1], 0.8))
    for _ in range(rounds):
        good = model.posterior(names)
        right = counts[:, None] * ((votes == GOOD) * good[:, None] + (votes == BAD) * (1 - good)[:, None])
        cast = counts[:, None] * (votes != SILENT)
        accuracy = np.clip((right.sum(0) + 8) / (cast.sum(0) + 10), 0.5, 0.999)  # as if it had been right in 8 of 10 votes before
        share = float(np.clip(counts @ good / counts.sum(), 0.05, 0.95))
        moved = abs(share - model.good) + np.abs(accuracy - model.accuracy).max()
        model = LabelModel(share, accuracy)
        if moved < 1e-7:
            break
    return model


@dataclass
class Scorer:
    """A linear model of hashed features."""

    weights: np.ndarray
    bias: float
    labels: LabelModel | None = field(default=None)

    def scores(self, features: list[bytes]) -> np.ndarray:
        """Score of each text by its stored features."""
        owner, at, value = unpacked(features)
        z = np.bincount(owner, self.weights[at].astype(np.float64) * value, len(features)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def packed(features: dict[int, float]) -> bytes:
    """Features in order as two bytes a bucket, then eight a value."""
    at = sorted(features)
    return np.array(at, "<u2").tobytes() + np.array([features[k] for k in at], "<f8").tobytes()


def unpacked(features: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and value of all features of the texts."""
    sizes = [len(f) // 10 for f in features]
    at = np.frombuffer(b"".join(f[: 2 * n] for f, n in zip(features, sizes, strict=True)), "<u2").astype(np.int64)
    value = np.frombuffer(b"".join(f[2 * n :] for f, n in zip(features, sizes, strict=True)), "<f8")
    return np.repeat(np.arange(len(features)), sizes), at, value


def fit_scorer(features: list[bytes], target: np.ndarray, weight: np.ndarray) -> Scorer:
    """Logistic regression on posterior labels, by steps scaled to how often a feature occurs."""
    owner, at, value = unpacked(features)
    weight = weight / weight.sum()
    theta, pace = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    often = np.bincount(at, weight[owner] * value**2, BUCKETS + 1)
    scale = RATE / (10 * often + 0.05)
    scale[-1] = RATE
    for _ in range(EPOCHS):
        z = np.bincount(owner, theta[at] * value, len(features)) + theta[-1]
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target)
        grad = np.bincount(at, slope[owner] * value, BUCKETS + 1)
        grad[-1] = slope.sum()
        grad[:-1] += SHRINK * theta[:-1]
        pace = 0.5 * pace - scale * grad
        theta += pace
    return Scorer(theta[:-1].astype(np.float32), float(theta[-1]))


def _analysed(df: DataFrame, text_col: str, keep_text: bool) -> tuple[DataFrame, tuple[str, str, str]]:
    """The rows, without the text unless it is kept, with a digest of the text, its votes and its features, and what these columns are called; written, so that each text is analysed once."""
    taken = set(df.columns)
    added = tuple(next(n for n in (f"{base}_{k}" for k in range(len(taken) + 1)) if n not in taken) for base in ("digest", "votes", "features"))
    names, text = df.columns, df.columns.index(text_col)
    kept = [c for c in names if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [facts_of(t) for t in batch.column(text).to_pylist()]
            columns = [batch.column(names.index(c)) for c in kept] + [batch.column(len(names))]
            columns += [pa.array(map(votes_of, facts), pa.string()), pa.array([packed(features_of(f)) for f in facts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(added[0], T.LongType()), T.StructField(added[1], T.StringType()), T.StructField(added[2], T.BinaryType())])
    digested = bounded(df).withColumn(added[0], F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return materialize(digested.mapInArrow(run, schema), "quality-analysed"), added


def train(analysed: DataFrame) -> Scorer | None:
    """Fit the label model on the votes on all texts and the scorer on a bounded sample of the (digest, votes, features) rows; None for an empty table."""
    # Two answers of each labeller: at most 2**15 patterns, of which few occur.
    found = analysed.groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("digest").alias("texts")).collect()
    counts = {r["votes"]: r["n"] for r in found}
    if not counts:
        return None
    model = fit_label_model(dict(sorted(counts.items())))
    each = max(1, min(OF_PATTERN, SAMPLE // len(counts)))
    # Of each pattern the texts of least hash: first thinned by rate, so that no pattern's list holds many more than are taken.
    # Rates are over distinct texts and expect so many more than are taken that fewer (by over six deviations) never pass.
    expected = each + 10 * each**0.5 + 40
    rates = analysed.sparkSession.createDataFrame([(r["votes"], min(1.0, expected / r["texts"])) for r in found], "votes string, rate double")
    order = F.pmod(F.xxhash64(F.lit(3), "digest"), F.lit(1 << 40))
    thin = analysed.join(F.broadcast(rates), "votes").where(order < F.col("rate") * (1 << 40))
    # Equal texts have equal features, so these go along with the digests: at most SAMPLE rows, or one a pattern.
    distinct = thin.groupBy("votes", "digest").agg(F.first("features").alias("features"))
    chosen = distinct.groupBy("votes").agg(F.slice(F.sort_array(F.collect_list(F.struct(order.alias("at"), "digest", "features"))), 1, each).alias("some"))
    taken = sorted(chosen.select("votes", F.explode("some").alias("s")).select("votes", "s.digest", "s.features").collect(), key=lambda r: r["digest"])
    patterns = [r["votes"] for r in taken]
    per_pattern = Counter(patterns)
    weight = np.array([counts[p] ** 0.5 / per_pattern[p] for p in patterns])
    scorer = fit_scorer([bytes(r["features"]) for r in taken], model.posterior(patterns), weight)
    scorer.labels = model
    return scorer


def quality_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, votes, weak_label (the label model's chance of good), score (the scorer's) and kept (whether it isn't rejected) of every document."""
    kind = df.schema[id_col].dataType.simpleString()
    rows, added = _analysed(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", keep_text=False)
    rows = rows.select("doc_id", *[F.col(a).alias(b) for a, b in zip(added, ("digest", "votes", "features"), strict=True)])
    scorer = train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior: dict[str, float] = {}
        for batch in batches:
            votes = batch.column(1).to_pylist()
            if new := sorted({*votes} - {*posterior}):
                posterior.update(zip(new, scorer.labels.posterior(new).tolist(), strict=True))
            scores = scorer.scores(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array([posterior[v] for v in votes], pa.float64()), pa.array(scores, pa.float64()), pa.array(scores >= THRESHOLD, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "votes", "weak_label", "score", "kept"])

    return rows.select("doc_id", "votes", "features").mapInArrow(run, f"doc_id {kind}, votes string, weak_label double, score double, kept boolean")


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with their columns, that a scorer trained on all of them doesn't reject."""
    rows, added = _analysed(df, text_col, keep_text=True)
    scorer = train(rows.select(*[F.col(a).alias(b) for a, b in zip(added, ("digest", "votes", "features"), strict=True)]))
    if scorer is None:
        return df
    names, features = df.columns, rows.columns.index(added[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = scorer.scores(batch.column(features).to_pylist()) >= THRESHOLD
            yield batch.select(list(range(len(names)))).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, df.schema)
