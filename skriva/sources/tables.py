"""The tables as stored, and the cleaned relations that queries build on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def latest_notes(notes: DataFrame) -> DataFrame:
    """One row per note_id, from its last scan; ties by path. Null ids are left out."""
    columns = [c for c in notes.columns if c != "note_id"]
    last = F.max_by(F.struct(*columns), F.struct("mtime", "path")).alias("last")
    return notes.where("note_id IS NOT NULL").groupBy("note_id").agg(last).select("note_id", "last.*")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk rows without exact repeats."""
    return chunks.where("chunk_id IS NOT NULL").distinct()


def passages(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Chunks with the columns of their note; chunks of deleted notes drop out. `tags` becomes one text."""
    n = latest_notes(notes).select(
        "note_id", "path", "project", "tier", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.array_join("tags", " "), F.lit("")).alias("tags")
    )
    # Repeats have the same note: by its id they meet, and so do chunk and note; the texts are shuffled once.
    c = distinct_chunks(chunks.repartition("note_id")).select(
        "chunk_id", "note_id", "seq", F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"), F.coalesce("body", F.lit("")).alias("body"), "tokens"
    )
    return c.join(n, "note_id")
