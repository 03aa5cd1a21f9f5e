"""Tables and summaries as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import shown_number

# Signs of changes.
SIGNS = {"added": "+", "removed": "-", "modified": "~"}


def format_table(df: DataFrame, kind: str = "plain", empty: str = "") -> str:
    """All rows as plain text, Markdown or JSON; for results that are read by people, which the caller keeps as short as they want."""
    found = [r.asDict(recursive=True) for r in df.collect()]
    if kind == "json":
        return json.dumps(found, default=str)
    if not found:
        return empty
    cells = [["-" if r[c] is None else str(r[c]) for c in df.columns] for r in found]
    if kind == "md":
        lines = [df.columns, ["---"] * len(df.columns), *cells]
        return "\n".join("| " + " | ".join(x.replace("|", "\\|") for x in line) + " |" for line in lines)
    widths = [max(map(len, column)) for column in zip(df.columns, *cells, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in [df.columns, *cells])


def summary_text(counts: DataFrame) -> DataFrame:
    """One row of text from the numbers of rows added, removed and modified."""
    parts = [F.when(F.col(f"n_{kind}") > 0, F.concat(F.lit(sign), F.col(f"n_{kind}").cast("string"), F.lit(f" {kind}"))) for kind, sign in SIGNS.items()]
    text = F.array_join(F.array_compact(F.array(*parts)), ", ")
    return counts.select(F.when(text == "", "no changes").otherwise(text).alias("text"))


def signed_changes(changes: DataFrame) -> DataFrame:
    """Row changes with their sign in front."""
    sign = F.element_at(F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv]), F.col("change_type"))
    return changes.select(sign.alias("sign"), *changes.columns)


def metric_table(metrics: DataFrame, precision: int = 5) -> DataFrame:
    """(path, key, shown) in order; floats with fixed digits, ``-`` for null."""
    return metrics.select("path", "key", shown_number(F.col("value"), precision).alias("shown")).orderBy("path", "key")


def change_table(changes: DataFrame, keys: list[str], precision: int | None = None) -> DataFrame:
    """Keys, old, new and change_type as shown; numbers with fixed digits where a precision is given."""
    show = (lambda c: shown_number(F.col(c), precision)) if precision is not None else (lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")))
    return changes.select(*keys, show("old").alias("old"), show("new").alias("new"), "change_type").orderBy(*keys)
