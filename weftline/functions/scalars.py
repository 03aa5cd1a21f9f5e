"""Column expressions: null and number rules, keys, names, paths, labels and display forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Formats of names and hashes.
HASH_PATTERN = "^[0-9a-f]{16}$"
STAGE_NAME_PATTERN = r"^[a-zA-Z0-9_@./-]+$"
LONGEST_STAGE_NAME = 200
INT_PATTERN = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
FLOAT_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

DEFAULT_PRECISION = 5


def nan_to_null(column: Column, kind: T.DataType) -> Column:
    """The column with NaN as null; other types as they are."""
    return F.when(~F.isnan(column), column) if isinstance(kind, (T.FloatType, T.DoubleType)) else column


def comparable(column: Column, kind: T.DataType) -> Column:
    """A form in which equal numbers of different types, and booleans as 0 and 1, are equal."""
    if isinstance(kind, T.BooleanType):
        return column.cast("double")
    if isinstance(kind, NUMERIC) and not isinstance(kind, T.LongType):
        return nan_to_null(column, kind).cast("double")
    return column


def same_value(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> Column:
    """Null-safe equality; NaN equals null, numbers compare by value, values of unlike types differ unless both are null."""
    numeric = (*NUMERIC, T.BooleanType)
    if a_kind == b_kind:
        return nan_to_null(a, a_kind).eqNullSafe(nan_to_null(b, b_kind))
    if isinstance(a_kind, numeric) and isinstance(b_kind, numeric):
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
        if isinstance(a_kind, whole) and isinstance(b_kind, whole):
            return a.cast("bigint").eqNullSafe(b.cast("bigint"))
        return nan_to_null(a, a_kind).cast("double").eqNullSafe(nan_to_null(b, b_kind).cast("double"))
    return a.isNull() & b.isNull()


def key_json(*columns: Column) -> Column:
    """Key values as a JSON array of strings, the text by which changes are ordered and shown."""
    return F.to_json(F.array(*[c.cast("string") for c in columns]))


def value_type(text: Column) -> Column:
    """The type that a bare scalar is read as: bool, int, float or str, in that order."""
    low = F.lower(F.trim(text))
    return F.when(text.isNull(), None).when(low.isin("true", "false"), "bool").when(text.rlike(INT_PATTERN), "int").when(text.rlike(FLOAT_PATTERN), "float").otherwise("str")


def parsed_number(text: Column) -> Column:
    """The scalar's value as a number, booleans as 0 and 1; null for strings."""
    kind = value_type(text)
    low = F.lower(F.trim(text))
    return F.when(kind == "bool", (low == "true").cast("double")).when(kind.isin("int", "float"), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("double"))


def shown_number(column: Column, precision: int = DEFAULT_PRECISION) -> Column:
    """A float with fixed digits, ``-`` for null."""
    return F.when(column.isNull(), "-").otherwise(F.format_string(f"%.{precision}f", column.cast("double")))


def rounded(column: Column, kind: T.DataType, precision: int = DEFAULT_PRECISION) -> Column:
    """Floats rounded half to even, at any depth of arrays, structs and maps."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.bround(column, precision)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: rounded(x, kind.elementType, precision))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: rounded(v, kind.valueType, precision))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[rounded(column[f.name], f.dataType, precision).alias(f.name) for f in kind]))
    return column


def delta(old: Column, new: Column) -> Column:
    """The change of a number; null unless both are numbers."""
    return new - old


def stage_base(name: Column) -> Column:
    """The part of a stage name before the first ``@``."""
    return F.element_at(F.split(name, "@", 2), 1)


def stage_variant(name: Column) -> Column:
    """The part of a stage name after the first ``@``, empty without one."""
    parts = F.split(name, "@", 2)
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")


def valid_stage_name(name: Column) -> Column:
    """Letters, digits and a few signs, no parent references, not too long."""
    return name.rlike(STAGE_NAME_PATTERN) & ~F.array_contains(F.split(name, "/"), "..") & (F.length(name) <= LONGEST_STAGE_NAME)


def node_type(node: Column) -> Column:
    """What stands before the first colon of a graph node."""
    return F.element_at(F.split(node, ":", 2), 1)


def node_value(node: Column) -> Column:
    return F.element_at(F.split(node, ":", 2), -1)


def interpolated(template: Column, values: dict[str, Column | str]) -> Column:
    """The template with ``${name}`` replaced, in the given order."""
    return reduce(lambda text, kv: F.replace(text, F.lit("${" + kv[0] + "}"), kv[1] if isinstance(kv[1], Column) else F.lit(kv[1])), values.items(), template)


def unresolved(text: Column) -> Column:
    """Whether a placeholder is left."""
    return text.rlike(r"\$\{\w+\}")


# The three messages.
def path_problem(path: Column) -> Column:
    """Why a path's syntax isn't allowed; null if it is."""
    return (
        F.when(path.contains("\x00"), "contains null byte")
        .when(path.contains("\n") | path.contains("\r"), "contains newline character")
        .when(F.array_contains(F.split(path, "/"), ".."), "contains path traversal (..)")
    )


# Kinds of paths that may lie outside the base folder.
MAY_LIE_OUTSIDE = ("dependency",)


def path_policy(path: Column, kind: Column, base: str, real: Column | None = None) -> Column:
    """(valid, path, error, warning): what the policy for a kind of path says of it; ``real`` is where links lead, where that is known.

    Only dependencies may lie outside of ``base``, with a warning; links that lead outside are errors for all others.
    """
    root = base.rstrip("/")
    full = canonical_path(absolute_path(path, root))
    inside = lambda p: (p == root) | p.startswith(F.lit(root + "/"))
    free = kind.isin(*MAY_LIE_OUTSIDE)
    leads_out = F.coalesce(~inside(real), F.lit(False)) if real is not None else F.lit(False)
    astray = F.concat(kind, F.lit(" path resolves outside base via symlink: "), path)
    problem = path_problem(path)
    error = (
        F.when(problem.isNotNull(), F.concat(kind, F.lit(" path "), problem))
        .when(~inside(full) & ~free, F.concat(kind, F.lit(" path '"), path, F.lit("' resolves outside base directory")))
        .when(leads_out & ~free, astray)
    )
    warning = F.when(error.isNotNull(), None).when(~inside(full), F.concat(F.lit("Absolute "), kind, F.lit(" path may break reproducibility: "), path)).when(leads_out, astray)
    return F.struct(error.isNull().alias("valid"), F.when(error.isNull(), full).alias("path"), error.alias("error"), warning.alias("warning"))


def canonical_path(path: Column) -> Column:
    """The path without empty, ``.`` and resolved ``..`` parts; a slash at the end stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: (
        F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "..") & path.startswith("/"), acc)
        .otherwise(F.concat(acc, F.array(p)))
    )
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(F.size(acc) == 0, F.when((p == "..") & path.startswith("/"), acc).otherwise(F.array(p))).otherwise(step(acc, p)))
    body = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    named = F.when(body == "", ".").otherwise(body)
    return F.when(path.endswith("/") & ~named.endswith("/"), F.concat(named, F.lit("/"))).otherwise(named)


def relative_path(path: Column, base: str) -> Column:
    """The path below ``base``; other paths as they are."""
    root = base.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def absolute_path(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def ancestors(path: Column) -> Column:
    """All proper ancestors of a path, shortest first."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, F.filter(up, lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def paths_overlap(a: Column, b: Column) -> Column:
    """Whether the paths are equal or one lies inside the other."""
    a, b = F.rtrim(a, F.lit("/")), F.rtrim(b, F.lit("/"))
    return (a == b) | a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))


def valid_hash(value: Column) -> Column:
    return value.rlike(HASH_PATTERN)


def cache_path(value: Column) -> Column:
    """Where a content hash is stored: two digits, a slash, the rest; null for what isn't a hash."""
    return F.when(valid_hash(value), F.concat(F.left(value, F.lit(2)), F.lit("/"), F.substring(value, 3, 14)))


def remote_key(value: Column, prefix: str) -> Column:
    """Where a content hash is stored under a remote prefix."""
    return F.concat(F.lit(prefix + "files/"), cache_path(value))


def hash_of_remote_key(key: Column, prefix: str) -> Column:
    """The hash that a remote key stands for; null for other keys."""
    rest = F.split(F.substring(key, F.lit(len(prefix + "files/") + 1), F.length(key)), "/")
    joined = F.concat(F.get(rest, F.lit(0)), F.get(rest, F.lit(1)))
    whole = key.startswith(prefix + "files/") & (F.size(rest) == 2) & (F.get(rest, F.lit(0)) != "") & (F.get(rest, F.lit(1)) != "")
    return F.when(whole & valid_hash(joined), joined)


def short_hash(value: Column) -> Column:
    return F.coalesce(F.left(value, F.lit(8)), F.lit("-"))


def _tenths(ms: Column) -> Column:
    """Tenths of a second of less than a minute, rounded as the double ms / 1000 is: ties go by its exact binary value."""
    whole, rest = F.floor(ms / 100).cast("bigint"), ms % 100
    scale = 1 << 52  # the double times 2**52 is a whole number below 2**58
    exact = ((ms / 1000).cast("double") * F.lit(float(scale))).cast("bigint").cast("decimal(20,0)") * F.lit(20).cast("decimal(3,0)")
    tie = (whole * 2 + 1).cast("decimal(10,0)") * F.lit(str(scale)).cast("decimal(17,0)")
    up = (rest > 50) | ((rest == 50) & ((exact > tie) | ((exact == tie) & (whole % 2 == 1))))
    return whole + up.cast("int")


def elapsed(ms: Column) -> Column:
    """A duration as it is shown: in ms, in seconds, or in minutes and seconds."""
    tenths = _tenths(F.least(ms, F.lit(59999)))
    minutes = F.format_string("%dm%.0fs", F.floor(ms / 60000).cast("bigint"), F.bround((ms % 60000) / 1000, 0).cast("double"))
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("bigint"))).when(ms < 60000, F.format_string("%d.%ds", F.floor(tenths / 10).cast("bigint"), (tenths % 10).cast("bigint"))).otherwise(minutes)


def display_category(status: Column, reason: Column) -> Column:
    """The class under which a stage's result is shown."""
    return (
        F.when(status == "ready", "pending")
        .when(status == "in_progress", "running")
        .when(status.isin("completed", "ran"), "success")
        .when(status == "failed", "failed")
        .when((status == "skipped") & reason.startswith("upstream"), "blocked")
        .when((status == "skipped") & (reason == "cancelled"), "cancelled")
        .when(status == "skipped", "cached")
        .otherwise("unknown")
    )


# Levels of log lines.
LOG_LEVELS = ("INFO", "WARNING", "WARN", "ERROR", "DEBUG", "CRITICAL", "FATAL")


def log_level(line: Column) -> Column:
    """The level, in capitals, that a log line names after colours and a time stamp; null without one."""
    shape = r"(?i)^(?:\x1b\[[0-9;]*m)*(?:\[?[0-9:.\s,TZ-]+\]?\s*)?(?:\[?(" + "|".join(LOG_LEVELS) + r")\]?)[\s:\]-]"
    return F.nullif(F.upper(F.regexp_extract(line, shape, 1)), F.lit(""))


def file_format(path: Column) -> Column:
    """csv, json or jsonl by the suffix in any case, else unknown."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("csv", "json", "jsonl"), suffix).otherwise("unknown")


#: File names that hold pipeline definitions or parameters.
CONFIG_NAMES = ("pipeline.yaml", "pipeline.yml", "pipeline.py", "params.yaml", "params.yml")
# Entries that are never data.
SKIPPED_DIRS = ("__pycache__", ".venv", "venv", ".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "dist", "build")
SKIPPED_SUFFIXES = (".pyc", ".pyo", ".swp", ".swo", "~")


def is_code(path: Column, config_names: tuple[str, ...] = CONFIG_NAMES) -> Column:
    """Whether a change of this file concerns code or configuration rather than data."""
    return path.endswith(".py") | F.element_at(F.split(path, "/"), -1).isin(*config_names)


def skipped_entry(name: Column, is_dir: Column) -> Column:
    """Whether a directory entry is never data: a folder by name; a file by suffix or as an editor's lock."""
    file = name.startswith(".#")
    for suffix in SKIPPED_SUFFIXES:
        file = file | name.endswith(suffix)
    return F.when(is_dir, name.isin(*SKIPPED_DIRS)).otherwise(file)


def worker_count(stages: Column, wanted: Column, cpus: int) -> Column:
    """Workers to start: a negative wish counts down from the processors; no more than stages, no less than one."""
    asked = F.when(wanted < 0, wanted + cpus).otherwise(wanted)
    return F.greatest(F.lit(1), F.least(asked, stages))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def suggestions(stale: Column, modified: Column, push: Column, pull: Column) -> Column:
    """What to do next, most urgent first."""
    return F.array_compact(
        F.array(
            F.when(stale > 0, F.concat(F.lit("run "), plural(stale, "stale stage"))),
            F.when(modified > 0, F.concat(F.lit("track "), plural(modified, "modified file"))),
            F.when(push > 0, F.concat(F.lit("push "), plural(push, "object"))),
            F.when(pull > 0, F.concat(F.lit("pull "), plural(pull, "object"))),
        )
    )
