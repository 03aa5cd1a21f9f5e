"""Readers of tables, documents, metrics, parameters and listings."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import parsed_number, skipped_entry, value_type

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl"}
PEEK_ROWS = 100


class FormatError(ValueError):
    """A file of an unknown format, or a line that can't be read."""


def detect_format(path: str) -> str:
    """csv, json or jsonl by the suffix in any case, else unknown."""
    dot = path.rfind(".")
    return FORMATS.get(path[dot:].lower(), "unknown") if dot > path.rfind("/") else "unknown"


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, sep: str = ",", kind: str | None = None) -> DataFrame:
    """A table of CSV, JSON or JSON lines; types are inferred unless a schema is given, and dates stay text.

    CSV is read in splits unless a quoted value may go on over lines, which a pass over the lines tells.
    """
    kind = kind or detect_format(path if isinstance(path, str) else path[0])
    reader = spark.read if schema is None else spark.read.schema(schema)
    paths = path if isinstance(path, str) else list(path)
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).option("preferDate", False).option("timestampFormat", "'none'").option("sep", sep).option("multiLine", _spans_lines(spark, paths)).option("escape", '"').csv(paths)
    if kind == "json":
        return reader.option("multiLine", True).option("inferTimestamp", False).json(paths)
    if kind == "jsonl":
        return reader.option("inferTimestamp", False).json(paths)
    raise FormatError(f"{path}: unknown format")


def _spans_lines(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether a line of the files has an odd number of quotes, as records that go on over lines have."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(paths).where(quotes % 2 == 1).isEmpty()


def peek_schema(spark: SparkSession, path: str) -> dict[str, str]:
    """Column types, of CSV and JSON lines from the first rows only."""
    kind = detect_format(path)
    if kind == "json":
        return dict(read_table(spark, path).dtypes)
    head = spark.read.text(path).limit(PEEK_ROWS + 1)
    lines = [r["value"] for r in head.collect()]
    rdd = spark.sparkContext.parallelize(lines, 1)
    if kind == "csv":
        return dict(spark.read.option("header", True).option("inferSchema", True).csv(rdd).dtypes)
    return dict(spark.read.option("inferTimestamp", False).json(rdd).dtypes)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows without reading values: CSV records without the header, physical lines of JSON lines, elements of JSON."""
    kind = detect_format(path)
    if kind == "csv":
        return max(0, spark.read.option("multiLine", _spans_lines(spark, path)).option("header", True).option("escape", '"').csv(path).count())
    if kind == "jsonl":
        return spark.read.text(path).count()
    return read_table(spark, path).count()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file, 1-based."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line")).select((F.col("at") + 1).alias("line_no"), "line")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines, in the order of the file, blank lines aside; a line that isn't JSON raises FormatError with its place.

    Lines are read in splits; only to name a bad one are they numbered.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = F.try_parse_json(F.col("value")).isNull()
    if not lines.where(bad).isEmpty():
        first = read_lines(spark, path).where(F.trim("line") != "").where(F.try_parse_json("line").isNull()).agg(F.min("line_no")).first()[0]
        raise FormatError(f"{path}:{first}: not JSON")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_object(spark: SparkSession, path: str):
    """The value of a JSON or YAML document, which are small: definitions, parameters, metrics."""
    text = read_text(spark, path)
    if path.lower().endswith((".yaml", ".yml")):
        return parse_yaml(text)
    return json.loads(text)


def read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row["value"] if row else ""


def parse_yaml(text: str):
    """The value of a YAML document, by PyYAML if it is there, else of the plain subset: block mappings, block lists and scalars."""
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    return yaml.safe_load(text)


def _plain_yaml(text: str):
    rows = [(len(line) - len(line.lstrip()), line.strip()) for line in text.split("\n") if line.strip() and not line.lstrip().startswith("#")]

    def scalar(s: str):
        s = s.strip()
        if s[:1] in ("'", '"') and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s[:1] in "[{" and s:
            return json.loads(s) if s[0] == "{" or '"' in s else [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        low = s.lower()
        if low in ("true", "false"):
            return low == "true"
        if low in ("", "null", "~"):
            return None
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s

    def block(at: int, indent: int):
        if at >= len(rows) or rows[at][0] < indent:
            return None, at
        indent = rows[at][0]
        if rows[at][1].startswith("- ") or rows[at][1] == "-":
            out = []
            while at < len(rows) and rows[at][0] == indent and rows[at][1][:1] == "-":
                rest = rows[at][1][1:].strip()
                if rest:
                    out.append(scalar(rest))
                    at += 1
                else:
                    value, at = block(at + 1, indent + 1)
                    out.append(value)
            return out, at
        out = {}
        while at < len(rows) and rows[at][0] == indent:
            key, colon, rest = rows[at][1].partition(":")
            if not colon:
                raise FormatError(f"not a mapping: {rows[at][1]!r}")
            if rest.strip():
                out[scalar(key)] = scalar(rest)
                at += 1
            else:
                out[scalar(key)], at = block(at + 1, indent + 1)
        return out, at

    if len(rows) == 1 and ":" not in rows[0][1] and not rows[0][1].startswith("-"):
        return scalar(rows[0][1])
    return block(0, 0)[0]


def flatten_object(value, prefix: str = "") -> dict:
    """Leaves of nested mappings under dotted keys; lists are leaves. Raises FormatError if the root isn't a mapping."""
    if not isinstance(value, dict):
        raise FormatError("the root must be a mapping")
    out = {}
    for key, v in value.items():
        if isinstance(v, dict):
            out.update(flatten_object(v, f"{prefix}{key}."))
        else:
            out[f"{prefix}{key}"] = v
    return out


def metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value, type) of a metric file: JSON or YAML mappings, or two-column CSV without header."""
    low = path.lower()
    if low.endswith(".csv"):
        return metric_csv(spark, path)
    if not low.endswith((".json", ".yaml", ".yml")):
        raise FormatError(f"{path}: unknown metric format")
    flat = flatten_object(read_object(spark, path))
    rows = [(path, k, None if v is None else str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v), type(v).__name__) for k, v in flat.items()]
    return spark.createDataFrame(rows, "path string, key string, value string, type string")


def metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value, type) of lines ``key,value``; shorter lines are left out, and the last line of a key counts."""
    lines = read_lines(spark, path).select("line_no", F.from_csv("line", "key string, value string").alias("r"), F.size(F.split("line", ",")).alias("n")).where("n >= 2")
    last = lines.groupBy(F.trim("r.key").alias("key")).agg(F.max_by(F.trim("r.value"), "line_no").alias("value"))
    return last.select(F.lit(path).alias("path"), "key", "value", value_type(F.col("value")).alias("type"))


def metric_numbers(metrics: DataFrame) -> DataFrame:
    """Metrics with their value as a number where they have one."""
    return metrics.withColumn("number", parsed_number(F.col("value")))


def scan_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, size, mtime, content) of files below a folder, without entries that are never data."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    files = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    parts = F.split("path", "/")
    inside = F.slice(parts, 1, F.size(parts) - 1)
    return files.where(~skipped_entry(F.element_at(parts, -1), F.lit(False)) & ~F.exists(inside, lambda p: skipped_entry(p, F.lit(True))))


def scan_metrics(spark: SparkSession, folder: str, recursive: bool = True) -> list[str]:
    """Paths of the metric files below a folder."""
    found = scan_files(spark, folder, "*.{json,yaml,yml,csv}", recursive).select("path").orderBy("path")
    return [r["path"] for r in found.collect()]


def scalar_variables(documents: Sequence[dict]) -> dict[str, str]:
    """Scalar entries of variable files as text; later files win."""
    out: dict[str, str] = {}
    for doc in documents:
        out.update({str(k): str(v).lower() if isinstance(v, bool) else str(v) for k, v in doc.items() if not isinstance(v, (dict, list)) and v is not None})
    return out


def parameter_overrides(document: dict | None) -> dict[str, dict]:
    """Entries of a parameter file that are mappings."""
    return {k: v for k, v in (document or {}).items() if isinstance(v, dict)}


def resolve_revision(refs: DataFrame, name: str) -> str | None:
    """The commit that a name stands for: an exact reference, a branch, a tag, a remote branch, else a unique hash prefix of 4 or more digits.

    ``refs`` has kind (ref, branch, tag, remote, commit), name and commit.
    """
    order = F.when(F.col("kind") == "ref", 0).when(F.col("kind") == "branch", 1).when(F.col("kind") == "tag", 2).when(F.col("kind") == "remote", 3)
    best = refs.where((F.col("name") == name) & order.isNotNull()).orderBy(order).first()
    if best:
        return best["commit"]
    if len(name) >= 4 and all(c in "0123456789abcdef" for c in name.lower()):
        found = refs.where((F.col("kind") == "commit") & F.col("commit").startswith(name.lower())).select("commit").distinct().limit(2).collect()
        return found[0]["commit"] if len(found) == 1 else None
    return None


def snapshot_files(files: DataFrame, snapshot: str, paths: DataFrame | None = None) -> DataFrame:
    """Files of one snapshot; those of the given paths, if given."""
    there = files.where(F.col("snapshot") == snapshot)
    return there if paths is None else there.join(paths.select("path").distinct(), "path", "left_semi")


def convert_foreign(document: dict, locked: dict | None = None) -> tuple[list[dict], list[dict]]:
    """Stages and notes of a pipeline definition of the DVC kind: ``foreach`` becomes a dimension, working folders go into paths."""
    stages, notes = [], []
    for name, spec in (document.get("stages") or {}).items():
        body = spec.get("do", spec)
        if isinstance(spec.get("foreach"), dict):
            notes.append({"stage": name, "severity": "warning", "message": "values of foreach items are dropped"})
        folder = body.get("wdir", "")

        def placed(entry, folder=folder):
            path, options = next(iter(entry.items())) if isinstance(entry, dict) else (entry, {})
            return (path if path.startswith("/") or not folder else f"{folder.rstrip('/')}/{path}"), options or {}

        outs = [(*placed(o), kind) for kind, key in (("data", "outs"), ("metric", "metrics"), ("plot", "plots")) for o in body.get(key) or []]
        stages.append(
            {
                "name": name,
                "cmd": body.get("cmd"),
                "items": list(spec["foreach"]) if "foreach" in spec else [],
                "deps": [placed(d)[0] for d in body.get("deps") or []],
                "outs": [{"path": p, "kind": kind, "cached": o.get("cache", True)} for p, o, kind in outs],
                "params": [p for p in body.get("params") or [] if isinstance(p, str)],
            }
        )
    return stages, notes


def export_foreign(stages: Sequence[dict]) -> dict:
    """A definition of the DVC kind; options that are the default are left out."""
    out = {}
    for s in stages:
        body = {"cmd": s.get("cmd"), "deps": list(s.get("deps", []))}
        for kind, key in (("data", "outs"), ("metric", "metrics"), ("plot", "plots")):
            found = [o["path"] if o.get("cached", True) else {o["path"]: {"cache": False}} for o in s.get("outs", []) if o["kind"] == kind]
            if found:
                body[key] = found
        out[s["name"]] = body
    return {"stages": out}
