"""The event operators over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions.scalars import is_code


def file_changes(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of change records that land as JSON files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def change_batches(changes: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Batches of file changes, code and data apart, once no change within ``gap`` can still come."""
    sessions = changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap), is_code(F.col("path")).alias("is_code"))
    return sessions.agg(F.collect_set("path").alias("paths"))


def throughput(events: DataFrame, window: str = "5 seconds", slide: str = "100 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Events in each sliding window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n_events"))


def state_changes(events: DataFrame, key: str = "stage", state: str = "state") -> DataFrame:
    """State changes of each key; an event that repeats the state before gives nothing."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = held.get[0] if held.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for now in rows[state]:
            if now != before:
                out.append({key: keys[0], "state": now, "previous_state": before})
                before = now
        held.update((before,))
        yield pd.DataFrame(out, columns=[key, "state", "previous_state"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, state string, previous_state string", "last string", "append", GroupStateTimeout.NoTimeout)


def deferred_changes(events: DataFrame, key: str = "stage", start: str = "started", end: str = "completed", change: str = "changed") -> DataFrame:
    """Changes of a producer's outputs, held while it runs and let go when it ends: key, n_changes and the time they take effect."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        running, waiting = held.get if held.exists else (False, 0)
        out = []
        for event in pd.concat(list(batches)).sort_values("ts").itertuples():
            if event.type == start:
                running = True
            elif event.type == end:
                running = False
                if waiting:
                    out.append({key: keys[0], "n_changes": waiting, "effective_ts": event.ts})
                waiting = 0
            elif event.type == change and running:
                waiting += 1
            elif event.type == change:
                out.append({key: keys[0], "n_changes": 1, "effective_ts": event.ts})
        held.update((running, waiting))
        yield pd.DataFrame(out, columns=[key, "n_changes", "effective_ts"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, n_changes long, effective_ts timestamp", "running boolean, waiting long", "append", GroupStateTimeout.NoTimeout)


def fan_out(events: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, once: bool = True) -> dict[str, StreamingQuery]:
    """An independent query for each sink, so that one that fails stops no other."""
    out = {}
    for name, sink in sinks.items():
        writer = events.writeStream.queryName(name).option("checkpointLocation", f"{checkpoint}/{name}").foreachBatch(sink)
        out[name] = (writer.trigger(availableNow=True) if once else writer).start()
    return out


def json_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Appends each batch of events as JSON lines under the names of the sink."""
    from weftline.streaming.events import sink_events

    def write(batch: DataFrame, epoch: int) -> None:
        sink_events(batch).write.mode("append").json(folder)

    return write
