"""Frequency of every distinct value or term.

Every record is one row with all its terms, made once: repeated rows of a record combine by hash within each task before
they are shuffled. Inside the row the terms are sorted, so that the first of equal ones counts the record and all of them
count as occurrences; what leaves the row is summed by hash within each task, shuffled by term and summed again. The
bounds on record frequency then mark what is too rare or too common. Nothing is gathered per term, so a term may hold any
share of the rows; a record's row holds its different versions, not its repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriva.functions.text import WS, nfkc_lower, strip_ws
from skriva.session import cut

#: A term in at most so many records is rare.
RARE_RECORDS = 2
#: A term in more than this share of the records with a term is common.
COMMON_SHARE = 0.1

# Characters that end a term in a query text.
QUERY_MARKS = r'["*(){}:^-]'
_NONE = "\x00"


def clean_tag(col: Column) -> Column:
    """Lower NFKC text trimmed, without leading `#`."""
    return F.regexp_replace(strip_ws(col), "^#+", "")


def tag_terms(notes: DataFrame) -> DataFrame:
    """field_name, record, terms: the tags of each note. Null tags, tag lists and note ids give none.

    The tags of a note that was scanned again are the same tags: rows that repeat a note's list count once, other lists
    of the same note count too. Characters U+0000 are left out.
    """
    tags = F.transform("tags", lambda t: F.replace(t, F.lit(_NONE), F.lit("")))
    rows = notes.where("note_id IS NOT NULL AND tags IS NOT NULL").select(F.col("note_id").alias("record"), F.array_join(tags, _NONE).alias("said"))
    lists = rows.groupBy("record").agg(F.array_join(F.collect_set("said"), _NONE).alias("said"))
    terms = F.transform(F.split(nfkc_lower(F.col("said")), _NONE), clean_tag)
    return lists.select(F.lit("tags").alias("field_name"), "record", F.filter(terms, lambda t: t != "").alias("terms"))


def gap_terms(queries: DataFrame) -> DataFrame:
    """field_name, record, terms of the query texts that found nothing (hits = 0); repeated rows count once."""
    rows = queries.where("hits = 0 AND id IS NOT NULL AND text IS NOT NULL").select(F.col("id").alias("record"), "text")
    texts = rows.groupBy("record").agg(F.array_join(F.collect_set("text"), " ").alias("text"))
    words = F.split(F.regexp_replace(nfkc_lower(F.col("text")), QUERY_MARKS, " "), f"{WS}+")
    return texts.select(F.lit("query").alias("field_name"), "record", F.filter(words, lambda t: t != "").alias("terms"))


def term_frequencies(records: DataFrame, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """field_name, term, occurrences, records, mark ('rare', 'common' or null; rare is tested first).

    `records` has field_name and terms (array), one row per record. Null terms are left out; a record without terms
    counts for nothing.
    """
    ordered = records.select("field_name", F.array_sort(F.filter("terms", lambda t: t.isNotNull())).alias("t")).where(F.size("t") > 0)
    each = F.transform(F.col("t"), lambda t, i: F.struct(t.alias("term"), F.when((i > 0) & (F.get("t", i - 1) == t), 0).otherwise(1).alias("first")))
    # One more element without a term counts the record itself.
    itself = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("first")))
    emitted = ordered.select("field_name", F.explode(F.concat(each, itself)).alias("e"))
    counts = cut(emitted.groupBy("field_name", "e.term").agg(F.count("*").cast("long").alias("occurrences"), F.sum("e.first").cast("long").alias("records")))
    # One number per field name; the fields are named in the code.
    bound = F.lit(None).cast("double")
    for r in counts.where("term IS NULL").collect():
        bound = F.when(F.col("field_name") == r["field_name"], r["records"] * common).otherwise(bound)
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > bound, "common")
    return counts.where("term IS NOT NULL").select("field_name", "term", "occurrences", "records", mark.alias("mark"))
