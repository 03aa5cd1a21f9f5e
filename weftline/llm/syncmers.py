"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is a sequence of tokens: its white-space separated words, of which those over
``LONG_WORD`` characters, and the characters of scripts written without spaces, are taken by
character. A run of ``K`` tokens is a closed syncmer if the smallest hash of its inner runs
(single tokens here) lies at its first or last place. Whether a run is chosen depends on that
run alone, so equal passages give equal anchors whatever stands around them. Texts under
``SHORT`` characters have anchors over their characters as well, as they have few words.

* ``anchors``: every chosen run of words with its place, for positional matching;
* a fingerprint: all anchors of the whole text with their places, in order;
* ``likeness``: anchors are matched by what they are and by their places to each other. Two
  neighbouring anchors and their distance are a link; the likeness is the share of links that
  two fingerprints have in common among those of either, so a passage counts wherever it
  stands, and shared words in another order don't.

Rules: null and token-free texts have the empty fingerprint, which is fully like itself and
not at all like any other; a text of fewer than ``K`` tokens, or without a chosen run, has
one anchor, the hash of all its tokens; equal texts have equal fingerprints; rows with
equal ids follow each other in the order of their text's hash; null ids come first; extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
#: Words over so many characters are taken by character; texts under so many are also.
LONG_WORD, SHORT = 32, 512
#: Scripts written without spaces: each character is a token.
_ALONE = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsKhmer}\p{IsLao}\p{IsMyanmar}])"
#: Text bytes of one range of ids, the ranges whose bounds are looked up at once, and the most, whose bounds the driver holds.
RANGE_BYTES, RANGES, MOST_RANGES = 8 << 20, 4096, 1 << 16


def _words(text: Column) -> Column:
    spaced = F.when(text.rlike(_ALONE), F.regexp_replace(text, _ALONE, " $1 ")).otherwise(text)
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def _tokens(words: Column) -> Column:
    """Words, the long ones by character."""
    cut = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
    return F.when(F.exists(words, lambda w: F.length(w) > LONG_WORD), cut).otherwise(words)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: ~c.rlike(r"^\s?$"))


def _with_lowest(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Add the smallest hash of each run of K = 5 tokens, by doubling: of runs of 2, of 4, of 5."""
    h, n = F.col(hashes), F.size(hashes)
    long = n >= K
    two, four, five = f"{out}_2", f"{out}_4", out
    df = df.withColumn(two, F.when(long, F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.least(a, b))))
    df = df.withColumn(four, F.when(long, F.zip_with(F.slice(two, 1, n - 3), F.slice(two, 3, n - 3), lambda a, b: F.least(a, b))))
    df = df.withColumn(five, F.when(long, F.zip_with(F.slice(four, 1, n - 4), F.slice(h, 5, n - 4), lambda a, b: F.least(a, b))))
    return df.drop(two, four)


def _run_hash(hashes: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(K)])


def _is_syncmer(hashes: Column, low: Column, i: Column) -> Column:
    return (F.get(hashes, i) == low) | (F.get(hashes, i + (K - 1)) == low)


def _with_anchors(df: DataFrame, tokens: Column, out: str) -> DataFrame:
    """Add the array of (position, anchor) of every closed syncmer of the tokens, or of all of them together."""
    h, low, chosen = f"{out}_h", f"{out}_low", f"{out}_chosen"
    df = _with_lowest(df.withColumn(f"{out}_tokens", tokens).withColumn(h, F.transform(_tokens(F.col(f"{out}_tokens")), lambda w: F.xxhash64(w))), h, low)
    found = F.transform(F.col(low), lambda m, i: F.when(_is_syncmer(F.col(h), m, i), F.struct(i.alias("position"), _run_hash(F.col(h), i).alias("anchor"))))
    kind = "array<struct<position:int,anchor:bigint>>"
    df = df.withColumn(chosen, F.coalesce(F.array_compact(found).cast(kind), F.array().cast(kind)))
    whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(h).alias("anchor"))).cast(kind)
    anchors = F.when(F.size(chosen) > 0, F.col(chosen)).when(F.size(h) > 0, whole).otherwise(F.array().cast(kind))
    return df.withColumn(out, anchors).drop(h, low, chosen, f"{out}_tokens")


def with_fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add a struct of the anchors of ``text`` by words and, if it is short, by characters."""
    words, characters = f"{out}_words", f"{out}_characters"
    df = _with_anchors(df, _words(text), words)
    df = _with_anchors(df, F.when(F.length(text) < SHORT, _characters(text)).otherwise(F.array().cast("array<string>")), characters)
    return df.withColumn(out, F.struct(F.col(words).alias("words"), F.col(characters).alias("characters"))).drop(words, characters)


def links(fingerprint: Column) -> Column:
    """Hashes of neighbouring anchors and their distance; of the anchor alone if there is one."""

    def of(anchors: Column, kind: int) -> Column:
        n = F.size(anchors)
        pairs = F.zip_with(F.slice(anchors, 1, F.greatest(n - 1, F.lit(0))), F.slice(anchors, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(F.lit(kind), a["anchor"], b["anchor"], b["position"] - a["position"]))
        return F.when(n == 1, F.transform(anchors, lambda a: F.xxhash64(F.lit(kind), a["anchor"]))).otherwise(pairs)

    return F.concat(of(fingerprint["words"], 0), of(fingerprint["characters"], 1))


def likeness(a: Column, b: Column) -> Column:
    """Share of common ones among the links of either, 0 to 1."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either).cast("double")


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as lower-case hex: for each anchor a digit that says how many tokens it stands after the one before (closed syncmers stand at most four apart), and eight for its low 32 bits; those over characters after a semicolon."""

    def of(anchors: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(anchors, i - 1)["position"]).otherwise(0)
            return F.concat(F.hex(a["position"] - before), F.lpad(F.hex(a["anchor"].bitwiseAND(0xFFFFFFFF)), 8, "0"))

        return F.lower(F.array_join(F.transform(anchors, one), ""))

    return F.concat(of(fingerprint["words"]), F.when(F.size(fingerprint["characters"]) > 0, F.concat(F.lit(";"), of(fingerprint["characters"]))).otherwise(""))


def anchors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``position`` (token number) and ``anchor`` (64-bit hash) of every closed syncmer of every text, or of a text without one."""
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _with_anchors(texts, _words(F.col("text")), "a").select("doc_id", F.explode("a").alias("a")).select("doc_id", F.col("a.position").cast("long").alias("position"), "a.anchor")


def _ranges(df: DataFrame, id_col: str, text_col: str) -> list[int]:
    """Ids at which ranges of about RANGE_BYTES of text begin; at most MOST_RANGES of them."""

    def shares(count: int) -> Column:
        return F.percentile_approx(id_col, F.from_json(F.lit(json.dumps([k / count for k in range(1, count)])), "array<double>"), F.lit(10 * count))

    size, found = df.agg(F.sum(F.octet_length(text_col)), shares(RANGES)).first()
    count = min(MOST_RANGES, (size or 0) // RANGE_BYTES + 1)
    if count > RANGES:
        found = df.agg(shares(count)).first()[0]
    every = max(1, RANGES // count) if count <= RANGES else 1
    return sorted(set((found or [])[every - 1 :: every])) if count > 1 else []


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are not above ``value``, by binary search in a constant array; null ids come before the first."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")  # folded into one constant
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    at = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, F.least(at + step - 1, F.lit(len(bounds) - 1))) <= value), at + step).otherwise(at),
    )
    return F.coalesce(at, F.lit(0))


def with_next(texts: DataFrame, bounds: list[int]) -> DataFrame:
    """Add ``print`` (fingerprint) and ``next`` (text and links) of the row after by ascending ``doc_id``; after the last comes the first.

    Rows go to ranges of ids, dealt by number, in one exchange of the texts; the first row of
    each range goes to the range before it as well. At most MOST_RANGES rows are broadcast.
    """
    ranged = texts.withColumn("range", _range_of(F.col("doc_id"), bounds))
    light = ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_hash")).alias("first"))
    around = Window.orderBy("range")  # a row a range
    everywhere = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = light.select(F.coalesce(F.lag("range").over(around), F.last("range").over(everywhere)).alias("before"), "first")
    heads = heads.select("before", F.col("first.doc_id").alias("head_id"), F.col("first.text_hash").alias("head_hash"))
    at_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_hash") == F.col("head_hash"))
    own, copy = (F.struct(F.col(c).alias("range"), F.lit(v).alias("copy")) for c, v in (("range", False), ("before", True)))
    dealt = ranged.join(F.broadcast(heads), at_head, "left").withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    dealt = dealt.select("doc_id", "text", "text_hash", "to.range", "to.copy").repartitionById(len(bounds) + 1, F.col("range"))
    window = Window.partitionBy("range").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text_hash")
    printed = with_fingerprint(dealt, F.col("text"), "print").withColumn("links", links(F.col("print")))
    return printed.withColumn("next", F.lead(F.struct("text", "links")).over(window)).where(~F.col("copy"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the same text with its second half replaced by the start of the next document.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next, the likeness of the fingerprint to that of the edited text
    and of the next document.
    """
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = _ranges(texts, "doc_id", "text")
    followed = with_next(texts.withColumn("text_hash", F.xxhash64("text")), bounds)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    pairs = followed.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "print", "links", F.col("next.links").alias("next_links"))
    pairs = with_fingerprint(pairs, F.col("edited"), "edited_print").withColumn("edited_links", links(F.col("edited_print")))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("links"), F.col("edited_links")).alias("near_edited"),
        likeness(F.col("links"), F.col("next_links")).alias("near_next"),
    )
