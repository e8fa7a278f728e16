"""References to records that do not exist, per table side and period.

The distinct keys of the references are anti-joined with the parent keys, so a key that holds a third of all rows is one
row; what is missing is joined back to the references for their rows or counts. That join is a semi-join on equality: the
few missing keys go to every task if they are small when they have been counted, and else adaptive execution splits the
partition of a hot key.

Null keys refer to nothing and are never orphans. Parents that arrive later than the reference count. Repeated parents
and references change nothing but the number of rows counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriva.functions.text import WS, strip_ws
from skriva.session import cut


def note_name(col: Column) -> Column:
    """A wiki-link target, title or stem as it is compared: without section, alias, folder and `.md`, in lower case."""
    head = F.regexp_extract(col, r"^([^#|]*)", 1)
    last = F.regexp_replace(F.regexp_extract(head, r"([^/]*)$", 1), r"\.md$", "")
    return F.lower(F.regexp_replace(strip_ws(last), f"{WS}+", " "))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.md$", "")


def note_names(notes: DataFrame) -> DataFrame:
    """name: every distinct name by which a note can be linked."""
    names = F.explode(F.array(note_name(F.col("title")), note_name(file_stem(F.col("path")))))
    return notes.select(names.alias("name")).where("name IS NOT NULL AND name <> ''").distinct()


def orphan_keys(references: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """key: the distinct non-null keys of `references` that no parent has."""
    own = references.select(key).where(F.col(key).isNotNull()).distinct()
    return own.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def orphan_rows(references: DataFrame, key: str, orphans: DataFrame) -> DataFrame:
    """The rows of `references` whose key is among `orphans`."""
    return references.join(orphans.select(key), key, "left_semi")


def _link_references(links: DataFrame) -> DataFrame:
    return links.where("src_note_id IS NOT NULL AND target IS NOT NULL").withColumn("name", note_name(F.col("target")))


def link_orphans(links: DataFrame, notes: DataFrame) -> DataFrame:
    """src_note_id, target, side ('src' or 'target'): the distinct orphan references, values as stored."""
    # Read by both sides, each for its keys and for its rows.
    pairs = cut(_link_references(links.select("src_note_id", "target").distinct()))
    src = orphan_rows(pairs, "src_note_id", orphan_keys(pairs, "src_note_id", notes, "note_id"))
    named = pairs.where("name <> ''")
    target = orphan_rows(named, "name", orphan_keys(named, "name", note_names(notes), "name"))
    columns = ["src_note_id", "target"]
    return src.select(*columns, F.lit("src").alias("side")).unionByName(target.select(*columns, F.lit("target").alias("side")))


def link_orphan_report(links: DataFrame, notes: DataFrame) -> DataFrame:
    """side, month (of seen_at, 'YYYY-MM' or null), orphan_rows, orphan_keys.

    Rows are counted per key and month before any join, so nothing is joined back row by row.
    """
    refs = _link_references(links).withColumn("month", F.date_format("seen_at", "yyyy-MM"))

    def side(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, name: str) -> DataFrame:
        counts = rows.groupBy(key, "month").agg(F.count("*").alias("n"))
        have = parents.select(F.col(parent_key).alias(key)).where(F.col(key).isNotNull()).distinct()
        gone = counts.join(have, key, "left_anti")
        per = gone.groupBy("month").agg(F.sum("n").alias("orphan_rows"), F.count("*").alias("orphan_keys"))
        return per.select(F.lit(name).alias("side"), "month", "orphan_rows", "orphan_keys")

    return side(refs, "src_note_id", notes, "note_id", "src").unionByName(
        side(refs.where("name <> ''"), "name", note_names(notes), "name", "target")
    )
