"""The query log and reads that follow what was offered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEEP_QUERIES = 5000
OFFERED = 200


def newest_queries(queries: DataFrame, keep: int = KEEP_QUERIES) -> DataFrame:
    """The newest `keep` rows of the log: retention is the feature. Repeated rows count once."""
    return queries.distinct().orderBy(F.col("ts").desc(), F.col("id").desc()).limit(keep)


def attributed_reads(events: DataFrame) -> DataFrame:
    """session_id, path, ts, event_id of the reads that count: the path was offered in the session since its last read.

    `events` has session_id, path, kind ('offer' or 'read'), ts, event_id. The window is over one path of one session.
    The bound of the last `OFFERED` distinct paths is part of the streaming operator, which keeps the same state.
    """
    order = Window.partitionBy("session_id", "path").orderBy("ts", "event_id")
    before = F.lag("kind").over(order)
    reads = events.where(F.col("kind").isin("offer", "read")).withColumn("before", before)
    return reads.where("kind = 'read' AND before = 'offer'").select("session_id", "path", "ts", "event_id")


def recent_paths(events: DataFrame, keep: int = OFFERED) -> DataFrame:
    """session_id, path, last: the `keep` paths last offered in each session."""
    last = events.where("kind = 'offer'").groupBy("session_id", "path").agg(F.max("ts").alias("last"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("last").desc(), "path"))
    return last.withColumn("r", rank).where(F.col("r") <= keep).drop("r")


def closed_sessions(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """session_id, started, ended, n: visits that end with a gap. `events` has session_id and ts (TIMESTAMP)."""
    window = F.session_window("ts", gap)
    return events.groupBy("session_id", window.alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("ended")).select("session_id", F.col("w.start").alias("started"), "ended", "n")
