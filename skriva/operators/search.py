"""Keyword rankings of a batch of queries, their fusion, priors and usage.

No step writes or shuffles a pair of a query and a passage that isn't among the best. The distinct terms of the stated
queries go to the tasks in blocks of at most `BLOCK_CHARS` characters, each as one automaton that finds all its terms in one
walk over a text, overlapping places included; where they stand is written once (`postings`), and each range of queries reads
it and keeps its best. Scores are rounded to `postings.DIGITS` before ranking, with the chunk as the last criterion, so that
a ranking is the same on any cluster.

Null and blank query texts have no terms and rank nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skriva.functions import scoring
from skriva.functions.text import cjk_windows, long_terms, query_terms, short_terms
from skriva.operators import postings
from skriva.operators.postings import Index
from skriva.session import cut, stored

DEFAULT_LIMIT, DEFAULT_BUDGET = 8, 2000
COLUMNS = ("title", "tags", "breadcrumb", "body")
#: Characters of the terms in a block: some 100 MB as an automaton.
BLOCK_CHARS = 1_000_000


def depth_of(limit: int) -> int:
    """How many candidates each ranking gives."""
    return max(4 * limit, 20)


def in_scope(scope: str, project: str | None) -> Column:
    """Which passages a search may see: all, the global ones, or those of a project with the global ones."""
    if scope == "all" or scope == "project" and not project:
        return F.lit(True)
    if scope == "global":
        return F.coalesce(F.col("project") == "", F.lit(False))
    return F.coalesce(F.col("project").isin(project, ""), F.lit(False))


def _term_blocks(terms: DataFrame) -> Iterator[list[str]]:
    """The distinct terms in blocks of bounded size; they are read in partitions."""
    block: list[str] = []
    chars = 0
    for (term,) in terms.select("term").where("term <> ''").distinct().toLocalIterator():
        if block and chars + len(term) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(term)
        chars += len(term)
    if block:
        yield block


def distinct_terms(queries: DataFrame, select) -> DataFrame:
    """query_id, term, n: the distinct lower-case terms that `select` takes from a query's terms, and their number."""
    terms = F.array_distinct(F.transform(select(query_terms(F.col("text"))), lambda t: F.lower(t)))
    return queries.select("query_id", terms.alias("t")).select("query_id", F.size("t").alias("n"), F.explode("t").alias("term"))


def windowed_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, n of the pieces of a query's long terms, for queries whose pieces are more than their terms."""
    lower = F.transform(long_terms(query_terms(F.col("text"))), lambda t: F.lower(t))
    pieces = F.array_distinct(F.flatten(F.transform(lower, cjk_windows)))
    both = queries.select("query_id", F.size(F.array_distinct(lower)).alias("own"), pieces.alias("t")).where(F.size("t") > F.col("own"))
    return both.select("query_id", F.size("t").alias("n"), F.explode("t").alias("term"))


LABELS = ("all-terms", "keyword", "partial")


def _asked(own: DataFrame, windows: DataFrame | None) -> DataFrame:
    """query_id, terms, n, windows: one row per query with its terms, those of all its texts."""
    rows = own.select("query_id", "n", "term", F.lit(0).alias("kind"))
    if windows is not None:
        rows = rows.unionByName(windows.select("query_id", F.lit(None).cast("int").alias("n"), "term", F.lit(1).alias("kind")))
    listed = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("term"))))
    return rows.groupBy("query_id").agg(listed(0).alias("terms"), F.coalesce(F.min("n"), F.lit(0)).alias("n"), listed(1).alias("windows"))


def _ranked(index: Index, asked: DataFrame, depth: int, labels: tuple[str, ...], scoped: bool, bm25: bool = True) -> DataFrame:
    """Queries of equal terms are ranked once."""
    keys = ["terms", "n", "windows"]
    asked = stored(asked)
    # Not as a file: its size would say that the rankings made from it are small enough to broadcast.
    units = cut(asked.select(*keys).distinct().withColumn("unit", F.monotonically_increasing_id()))
    found = postings.rank(index, units, depth, labels, scoped, bm25)
    return asked.join(units, keys).select("query_id", "unit").join(found, "unit").select("query_id", "label", "rank", "chunk_id", "score")


def keyword_index(passages: DataFrame, queries: DataFrame, scope: Column | None = None, labels: tuple[str, ...] = LABELS) -> Index:
    """Where the long terms of the queries, and their windows, stand, as far as `labels` need them. Statistics are of all passages, whatever the scope."""
    own = distinct_terms(queries, long_terms)
    terms = (own.where("n > 1") if labels == ("all-terms",) else own).select("term")
    if "partial" in labels:
        terms = terms.union(windowed_terms(queries).select("term"))
    length = sum(F.greatest(F.lit(0), F.length(F.lower(c)) - 2) for c in COLUMNS)
    seen = F.lit(True) if scope is None else scope
    texts = passages.select("chunk_id", length.cast("long").alias("length"), seen.alias("seen"), *(F.lower(c).alias(c) for c in COLUMNS))
    return postings.build(texts, list(_term_blocks(terms)), scoring.BM25_WEIGHTS, False)


def keyword_rankings(
    passages: DataFrame, queries: DataFrame, depth: int, scope: Column | None = None, labels: tuple[str, ...] = LABELS, index: Index | None = None
) -> DataFrame:
    """query_id, label, rank (from 1), chunk_id, score of the rankings all-terms, keyword and partial, or of those in `labels`.

    all-terms: passages with every long term, for queries of two or more. keyword: with any of them. partial: with any
    window of the terms, for queries that no passage answers in full and whose windows are more than their terms.
    `queries` has query_id and text; the scope is applied before the cut at `depth`. `index` is that of these passages, of
    these queries or more, and of the scope if there is one, where there is one already.
    """
    index = index or keyword_index(passages, queries, scope, labels)
    asked = _asked(distinct_terms(queries, long_terms), windowed_terms(queries) if "partial" in labels else None)
    return _ranked(index, asked.where("n > 1") if labels == ("all-terms",) else asked, depth, labels, scope is not None)


def _short(queries: DataFrame) -> DataFrame:
    return distinct_terms(queries, short_terms).withColumn("n", F.lit(0)).distinct()


def substring_index(passages: DataFrame, queries: DataFrame, scope: Column | None = None) -> Index:
    """Which columns hold the short terms of the queries."""
    seen = F.lit(True) if scope is None else scope
    texts = passages.select("chunk_id", F.col("tokens").cast("long").alias("tokens"), seen.alias("seen"), *(F.lower(c).alias(c) for c in scoring.SUBSTRING_WEIGHTS))
    return postings.build(texts, list(_term_blocks(_short(queries))), scoring.SUBSTRING_WEIGHTS, True)


def substring_ranking(passages: DataFrame, queries: DataFrame, depth: int, scope: Column | None = None, index: Index | None = None) -> DataFrame:
    """The ranking by terms of one or two characters: title 3, breadcrumb 2, body 1 for each term a column holds. `index` as for `keyword_rankings`."""
    index = index or substring_index(passages, queries, scope)
    return _ranked(index, _asked(_short(queries), None), depth, ("substring",), scope is not None, False)


def asked_once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries of which no two have the same texts, and for each query_id the one (`first`) that stands for it."""
    own = queries.groupBy("query_id").agg(F.sort_array(F.collect_set("text")).alias("texts"))
    same = own.groupBy("texts").agg(F.min("query_id").alias("first"))
    of = stored(own.join(same, "texts").select("query_id", "first"))
    return stored(queries.join(of.where("query_id = first").select("query_id"), "query_id", "left_semi")), of


def answered(found: DataFrame, of: DataFrame) -> DataFrame:
    """`found` of the queries of `asked_once` for all queries."""
    return of.join(found.withColumnRenamed("query_id", "first"), "first").select(*found.columns)


def fuse(rankings: DataFrame) -> DataFrame:
    """query_id, chunk_id, fused, matched_by, first_label, first_rank: reciprocal rank fusion of the rankings."""
    order = {label: i for i, label in enumerate(("all-terms", "keyword", "partial", "substring", "semantic"))}
    place = F.lit(len(order))
    for label, i in order.items():
        place = F.when(F.col("label") == label, i).otherwise(place)
    return (
        rankings.groupBy("query_id", "chunk_id")
        .agg(
            F.sum(scoring.rrf_part(F.col("rank"))).alias("fused"),
            F.array_join(F.array_sort(F.collect_set("label")), "+").alias("matched_by"),
            F.min(F.struct(place.alias("p"), "rank")).alias("first"),
        )
        .select("query_id", "chunk_id", F.round("fused", 9).alias("fused"), "matched_by", F.col("first.p").alias("first_label"), F.col("first.rank").alias("first_rank"))
    )


def boosted(fused: DataFrame, passages: DataFrame, usage: DataFrame | None = None, now: float = 0.0) -> DataFrame:
    """`fused` with tiered and boosted scores, and the position each has by them.

    The position sorts by boosted, then tiered, then fused score, then by first label and rank: what three stable sorts
    one after the other give. `usage` has path, uses, last_used, pinned; without it nothing is boosted. The columns row and
    cost of the passages, where they have them, are kept.
    """
    own = [c for c in ("row", "cost") if c in passages.columns]
    scored = fused.join(passages.select("chunk_id", "path", "tier", "tokens", *own), "chunk_id")
    scored = scored.withColumn("tiered", F.round(F.col("fused") * scoring.tier_prior(F.col("tier")), 9))
    weight = F.lit(0.0)
    if usage is not None:
        scored = scored.join(usage.select("path", "uses", "last_used", "pinned"), "path", "left")
        weight = scoring.usage_score(F.col("uses"), F.col("last_used"), F.col("pinned"), now)
    # Two more digits than the product of nine digits and a boost of a quarter has at most: nothing lies half-way.
    scored = scored.withColumn("score", F.round(scoring.usage_boost(F.col("tiered"), weight), 11))
    order = [F.col("score").desc(), F.col("tiered").desc(), F.col("fused").desc(), "first_label", "first_rank", "chunk_id"]
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("position", position.cast("long")).select("query_id", "position", "chunk_id", "path", "tokens", "matched_by", "fused", "tiered", "score", *own)


def outside_scope(passages: DataFrame, queries: DataFrame, scope: Column, depth: int = 200) -> DataFrame:
    """query_id, outside: how many passages the keyword rankings find in all, but not within the scope."""
    index = keyword_index(passages, queries, scope)
    everywhere, inside = (keyword_rankings(passages, queries, depth, s, index=index).select("query_id", "chunk_id") for s in (None, scope))
    found = everywhere.subtract(inside).groupBy("query_id").agg(F.count("*").alias("outside"))
    return queries.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("outside", F.lit(0)).alias("outside"))
