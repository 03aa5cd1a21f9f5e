"""Ignore patterns, searches in logs and names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import ancestors, stage_base


def glob_regex(pattern: str) -> str:
    """A regular expression for a wild-match pattern over a path without a slash in front; folders end in one."""
    body = pattern.removesuffix("/")
    anchored = "/" in body.lstrip("/") or body.startswith("/")
    body = body.removeprefix("/")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out.append("/.*")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inner = body[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = end + 1
        else:
            out.append(re.escape(body[i]))
            i += 1
    tail = "/.*" if pattern.endswith("/") else "(?:/.*)?"
    return "^" + ("" if anchored else "(?:.*/)?") + "".join(out) + tail + "$"


def parse_ignore(lines: list[tuple[str, str]], spark: SparkSession) -> DataFrame:
    """(line, source, pattern, negated, regex) of ignore lines, given as (source, text); blank lines and comments aside."""
    rows = []
    for number, (source, text) in enumerate(lines, 1):
        text = text.rstrip("\n").strip()
        if not text or text.startswith("#"):
            continue
        negated = text.startswith("!")
        rows.append((number, source, text, negated, glob_regex(text.removeprefix("!").removeprefix("\\"))))
    return spark.createDataFrame(rows, "line int, source string, pattern string, negated boolean, regex string")


def check_ignored(paths: DataFrame, patterns: DataFrame, protected: tuple[str, ...] = ()) -> DataFrame:
    """(path, ignored, pattern, line): the last pattern that matches decides; protected names are never ignored.

    Patterns are lines of small text files, so they become parts of the plan: a path is held against one after
    the other, from the last, and each is compiled once.
    """
    kind = "struct<pattern:string,line:int,negated:boolean>"
    last = F.lit(None).cast(kind)
    for p in patterns.orderBy("line").collect():
        last = F.when(F.col("path").rlike(p["regex"]), F.struct(F.lit(p["pattern"]).alias("pattern"), F.lit(p["line"]).alias("line"), F.lit(p["negated"]).alias("negated"))).otherwise(last)
    safe = F.lit(False)
    for name in protected:
        safe = safe | F.array_contains(F.split("path", "/"), name)
    found = paths.select("path").distinct().withColumn("m", last)
    ignored = F.coalesce(~F.col("m.negated"), F.lit(False)) & ~safe
    return found.select("path", ignored.alias("ignored"), F.col("m.pattern").alias("pattern"), F.col("m.line").alias("line"))


def not_ignored(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """Paths that neither they nor a folder around them is ignored."""
    every = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("at"))
    hit = check_ignored(every.select(F.col("at").alias("path")), patterns).where("ignored").select(F.col("path").alias("at"))
    return paths.join(every.join(hit, "at", "left_semi").select("path").distinct(), "path", "left_anti")


def search_log(lines: DataFrame, text: str, order: str = "seq") -> DataFrame:
    """Lines that hold the text in any case, with a 1-based match number in each stage."""
    found = lines.where(F.contains(F.lower("line"), F.lit(text.lower())))
    return found.withColumn("match", F.row_number().over(Window.partitionBy("stage").orderBy(order)))


def filter_stages(stages: DataFrame, text: str) -> DataFrame:
    """(stage, base, visible, group_visible): names that hold the text in any case, and groups with one that does."""
    hit = F.contains(F.lower("stage"), F.lit(text.lower()))
    named = stages.select("stage", stage_base(F.col("stage")).alias("base"), hit.alias("visible"))
    groups = named.groupBy("base").agg(F.bool_or("visible").alias("group_visible"))
    return named.join(groups, "base").select("stage", "base", "visible", "group_visible")


def listed(paths: DataFrame, folder: str, pattern: str) -> DataFrame:
    """Paths below a folder that match a wild-match pattern."""
    inside = paths.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    return inside.where(F.substring("path", len(folder.rstrip("/")) + 2, 1 << 30).rlike(glob_regex(pattern)))


def any_match(column: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of a few patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | column.rlike(glob_regex(p))
    return hit
