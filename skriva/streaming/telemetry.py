"""Telemetry as streams. Every operator is one transformation that also runs on a batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skriva.operators.review import usage_of
from skriva.operators.telemetry import OFFERED, newest_queries


def visits(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """session_id, started, ended, n of visits that are over: `events` has session_id and ts (TIMESTAMP).

    Append mode: a visit comes out once, when the watermark has passed its gap.
    """
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.session_window("ts", gap)
    out = watched.groupBy("session_id", window.alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("ended"))
    return out.select("session_id", F.col("w.start").alias("started"), "ended", "n")


def usage_counters(events: DataFrame) -> DataFrame:
    """Running usage per path, in update or complete mode; see `review.usage_of`."""
    return usage_of(events)


def session_records(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """session_id, started, unanswered, written, learned, signals: once per session that is over and has two signals.

    `events` has session_id, ts (TIMESTAMP), kind, what. Distinct questions are counted approximately only if a stream
    can't hold them; here they are a set per session, which is small.
    """
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    one = lambda kind: F.size(F.collect_set(F.when(F.col("kind") == kind, F.col("what"))))
    out = watched.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(
        one("unanswered").cast("long").alias("unanswered"), one("written").cast("long").alias("written"), F.count_if(F.col("kind") == "learned").alias("learned")
    )
    signals = F.col("unanswered") + F.col("written") + F.col("learned")
    return out.select("session_id", F.col("w.start").alias("started"), "unanswered", "written", "learned", signals.alias("signals")).where("signals >= 2")


def attribute(offered: list[str], events: list[tuple[str, str, object]], keep: int = OFFERED) -> tuple[list[str], list[tuple[str, object]]]:
    """The paths still on offer, oldest first, and the reads that count, after events (kind, path, ts) in order.

    An offer puts a path last; beyond `keep` the oldest goes. A read of a path on offer counts and takes it off.
    """
    order = dict.fromkeys(offered)
    reads = []
    for kind, path, ts in events:
        if kind == "offer":
            order.pop(path, None)
            order[path] = None
            while len(order) > keep:
                del order[next(iter(order))]
        elif kind == "read" and path in order:
            del order[path]
            reads.append((path, ts))
    return list(order), reads


def attributed_reads(events: DataFrame, keep: int = OFFERED, idle_hours: float = 24.0) -> DataFrame:
    """session_id, path, ts of the reads that follow an offer: a stream of session_id, path, kind, ts (TIMESTAMP), event_id.

    The state of a session is at most `keep` paths; it goes after `idle_hours` without events.
    For that the stream runs empty batches for ever; a run that is to end needs `spark.sql.streaming.noDataMicroBatches.enabled` off.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        offered = json.loads(state.get[0]) if state.exists else []
        for frame in frames:
            ordered = frame.sort_values(["ts", "event_id"])
            offered, reads = attribute(offered, list(zip(ordered["kind"], ordered["path"], ordered["ts"], strict=True)), keep)
            if reads:
                yield pd.DataFrame({"session_id": key[0], "path": [p for p, _ in reads], "ts": [t for _, t in reads]})
        state.update((json.dumps(offered),))
        state.setTimeoutDuration(int(idle_hours * 3600 * 1000))

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id string, path string, ts timestamp", "offered string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def import_new_files(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, quarantine: str, checkpoint: str, baseline: DataFrame | None = None):
    """Import each new transcript once: `handle` turns lines into rows for `out`; lines that aren't JSON go to `quarantine`.

    With `baseline` (session_id) the lines of these sessions, which were there before, are left out; `stream` then has
    session_id too. `stream` is `readStream.format('text')` with `maxFilesPerTrigger`; the checkpoint remembers which files are done.
    """

    def batch(df: DataFrame, number: int) -> None:
        if baseline is not None:
            df = df.join(baseline.select("session_id").distinct(), "session_id", "left_anti")
        marked = df.withColumn("_ok", F.try_parse_json("value").isNotNull() | (F.trim("value") == ""))
        handle(marked.where("_ok").drop("_ok")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        marked.where("NOT _ok").drop("_ok").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_log(queries: DataFrame, keep: int = 5000) -> DataFrame:
    """The query log's retention, as a batch between stream runs."""
    return newest_queries(queries, keep)
