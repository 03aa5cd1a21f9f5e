"""Event operators in batch form: batches of changes, throughput, buffers, states, deferral and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import is_code
from weftline.plans.closure import reached

# Names of sink events, and states in their order.
SINK_NAMES = {"stage_started": "stage_start", "stage_completed": "stage_complete", "engine_state_changed": None, "log_line": None, "stage_state_changed": None}
STATES = ("pending", "blocked", "ready", "preparing", "running", "completed")
WINDOW_MS, BUCKET_MS = 5000, 100


def debounced(events: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Batches of events of a key in which each comes within ``gap`` of the one before: keys, first_ts, last_ts, n_events."""
    per_key = Window.partitionBy(*keys).orderBy("ts", "event_id")
    apart = F.coalesce(F.col("ts") > F.lag("ts").over(per_key) + F.expr(f"interval {gap}"), F.lit(True)).cast("int")
    numbered = events.withColumn("_new", apart).withColumn("batch", F.sum("_new").over(per_key.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "batch").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"))


def change_batches(changes: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """Batches of file changes, code and data apart: window, is_code and paths."""
    return changes.groupBy(F.session_window("ts", gap), is_code(F.col("path")).alias("is_code")).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def routed(events: DataFrame) -> DataFrame:
    """Events with the branch that handles them."""
    branch = F.when(F.col("type") == "data_changed", "affected").when(F.col("type") == "code_changed", "reload").when(F.col("type") == "run_requested", "run").when(F.col("type") == "cancel_requested", "cancel").otherwise("ignored")
    return events.withColumn("branch", branch)


def throughput(events: DataFrame, window_ms: int = WINDOW_MS, bucket_ms: int = BUCKET_MS, keys: list[str] | None = None) -> DataFrame:
    """Buckets of events, and events a second over the trailing window, bucket by bucket; by ``keys`` if given."""
    keys = keys or []
    ms = F.expr("timestampdiff(microsecond, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))") / 1000
    bucket = (F.floor(ms / bucket_ms) * bucket_ms).cast("bigint").alias("bucket_ms")
    counts = events.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n_events"))
    trailing = Window.partitionBy(*keys).orderBy("bucket_ms").rangeBetween(-window_ms, 0)
    return counts.withColumn("in_window", F.sum("n_events").over(trailing)).withColumn("per_second", F.round(F.col("in_window") * 1000 / window_ms, 4))


def state_changes(events: DataFrame, key: str, state: str) -> DataFrame:
    """Events at which a key's state isn't the one before, with that one."""
    per_key = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("previous_state", F.lag(state).over(per_key)).where(~F.col(state).eqNullSafe(F.col("previous_state")))


def producer_runs(events: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start_ts, end_ts): each start of a key and the first end after it."""
    later = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = events.withColumn("end_ts", F.last(F.when(F.col("event_type") == end, F.col("ts")), ignorenulls=True).over(later))
    return ahead.where((F.col("event_type") == start) & F.col("end_ts").isNotNull()).select(key, F.col("ts").alias("start_ts"), "end_ts")


def deferred(changes: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Changes with ``effective_ts``: the latest end of its producer's runs around it, else its own time.

    A run around a change has begun by then and not ended, so the latest end of the runs begun says it: one window, no join.
    """
    rest = F.struct(*changes.columns).alias("change")
    starts = runs.where(F.col(key).isNotNull()).select(key, F.col("start_ts").alias("at"), "end_ts", F.lit(None).cast(changes.select(rest).schema["change"].dataType).alias("change"))
    moments = changes.select(key, F.col("ts").alias("at"), F.lit(None).cast(runs.schema["end_ts"].dataType).alias("end_ts"), rest)
    begun = Window.partitionBy(key).orderBy("at", F.col("change").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    latest = starts.union(moments).withColumn("latest", F.max("end_ts").over(begun)).where("change is not null")
    held = latest.select("change.*", F.when(F.col("latest") > F.col("at"), F.col("latest")).alias("held_until"))
    return held.withColumn("effective_ts", F.coalesce("held_until", "ts")).withColumn("deferred", F.col("held_until").isNotNull())


def completions(events: DataFrame, key: str) -> DataFrame:
    """Duration in seconds from each event of a key to the next."""
    per_key = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("next_ts", F.lead("ts").over(per_key)).where("next_ts is not null").withColumn("seconds", F.expr("timestampdiff(second, ts, next_ts)"))


def failure_cascade(states: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(stage, state): what depends on a failed stage and hasn't started is blocked."""
    below = reached(edges, failed.select(F.col("stage").alias("src"))).select(F.col("dst").alias("stage")).withColumn("below", F.lit(True))
    blocked = F.col("below") & F.col("state").isin("pending", "ready")
    return states.join(below, "stage", "left").select("stage", F.when(F.coalesce(blocked, F.lit(False)), "blocked").otherwise(F.col("state")).alias("state"))


def stopped_on_failure(states: DataFrame, failed: str) -> DataFrame:
    """All stages that haven't started become skipped, related or not."""
    waiting = F.col("state").isin("pending", "ready")
    return states.select("stage", F.when(waiting, "skipped").otherwise(F.col("state")).alias("state"), F.when(waiting, f"upstream '{failed}' failed").alias("reason"))


def cancelled(states: DataFrame) -> DataFrame:
    """Stages that haven't started are skipped as cancelled."""
    waiting = F.col("state").isin("pending", "ready", "blocked")
    return states.select("stage", F.when(waiting, "skipped").otherwise(F.col("state")).alias("state"), F.when(waiting, "cancelled").alias("reason"))


def startable(ready: DataFrame, running: DataFrame, slots: int) -> DataFrame:
    """One step of scheduling: ready stages (stage, mutex array, position) whose mutexes are free, as many as there are slots.

    A stage that holds ``*`` runs alone. Of ready stages that share a mutex the first starts.
    """
    held = running.select(F.explode("mutex").alias("m")).distinct()
    exclusive = not running.where(F.array_contains("mutex", "*")).isEmpty()
    if exclusive or slots < 1:
        return ready.limit(0)
    idle = running.isEmpty()
    wants = ready.select("stage", "position", F.explode_outer("mutex").alias("m"))
    blocked = wants.join(held, "m", "left_semi").select("stage")
    if not idle:
        blocked = blocked.union(wants.where("m = '*'").select("stage"))
    free = ready.join(blocked.distinct(), "stage", "left_anti")
    first = Window.partitionBy("m").orderBy("position")
    later = free.select("stage", "position", F.explode("mutex").alias("m")).withColumn("r", F.row_number().over(first)).where("r > 1").select("stage").distinct()
    return free.join(later, "stage", "left_anti").orderBy("position").limit(slots)


def ring_buffer(lines: DataFrame, key: str, order: list, size: int) -> DataFrame:
    """The last ``size`` lines of each key, with how many came before."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    total = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"))
    kept = lines.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= size)
    return kept.join(total, key).withColumn("n_dropped", F.greatest(F.lit(0), F.col("n_lines") - size)).drop("n_lines")


def shown_lines(buffer: DataFrame, key: str) -> DataFrame:
    """Lines of a buffer with a head line where some are dropped."""
    heads = buffer.groupBy(key).agg(F.max("n_dropped").alias("n")).where("n > 0").select(key, F.lit(1 << 30).alias("age"), F.format_string("[%d earlier lines truncated]", "n").alias("line"))
    return buffer.select(key, "age", "line").union(heads)


def events_since(events: DataFrame, version: int, size: int = 1000) -> DataFrame:
    """Events after a version, of the last ``size``; all of these for a version that isn't there yet."""
    buffer = events.orderBy(F.desc("version")).limit(size)
    current = events.agg(F.max("version")).first()[0] or 0
    return buffer if version > current else buffer.where(F.col("version") > version)


def bounded_queues(events: DataFrame, client: str, order: str, size: int = 64) -> DataFrame:
    """What clients with full queues keep: the first ``size`` events, as the newest are dropped."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(client).orderBy(order))).where(F.col("place") <= size)


def sink_events(events: DataFrame) -> DataFrame:
    """Events under the names they have in a sink; those without one are dropped."""
    name = F.col("type")
    dropped = [k for k, v in SINK_NAMES.items() if v is None]
    for old, new in SINK_NAMES.items():
        if new:
            name = F.when(F.col("type") == old, new).otherwise(name)
    return events.where(~F.col("type").isin(*dropped)).withColumn("type", name)


def last_results(events: DataFrame, key: str = "stage", order: str = "seq") -> DataFrame:
    """The last completion of each stage."""
    rest = F.struct(*[c for c in events.columns if c != key])
    return events.where("type = 'stage_completed'").groupBy(key).agg(F.max_by(rest, order).alias("r")).select(key, "r.*")


def split_lines(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """Lines of output that came in chunks, in order; a line that a chunk doesn't end goes on in the next."""
    joined = chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda c: c["text"]), "").alias("text"))
    return joined.select(key, F.posexplode(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("line_no", "line"))


def answer(method: str, tables: dict[str, DataFrame], **arguments) -> DataFrame:
    """Queries of a running engine: events_since, status, stages, explain and stage_info."""
    if method == "events_since":
        return events_since(tables["events"], int(arguments["version"]))
    if method in ("status", "stages", "explain"):
        return tables[method]
    if method == "stage_info":
        return tables["stages"].where(F.col("stage") == arguments["stage"])
    raise ValueError(f"unknown query {method!r}")
