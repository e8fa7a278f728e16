"""The graph of wiki-links: joins on names, no graph library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.functions.text import file_stem
from skriva.sources.tables import latest_notes


def links_out(links: DataFrame) -> DataFrame:
    """src_note_id, target: the distinct outgoing links."""
    return links.where("src_note_id IS NOT NULL AND target IS NOT NULL").select("src_note_id", "target").distinct()


def links_in(links: DataFrame, notes: DataFrame) -> DataFrame:
    """note_id, src_note_id: which notes link to a note by its exact title or file stem; a note's own links don't count.

    The two names of a note are two rows, so that the join is on equality and not on either of two columns.
    """
    own = latest_notes(notes)
    names = own.select("note_id", F.explode(F.array_distinct(F.array("title", file_stem(F.col("path"))))).alias("target")).where("target IS NOT NULL")
    sources = own.select(F.col("note_id").alias("src_note_id"))
    pairs = links_out(links).join(names, "target").where("note_id <> src_note_id")
    return pairs.join(sources, "src_note_id", "left_semi").select("note_id", "src_note_id").distinct()
