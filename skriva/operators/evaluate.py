"""Quality of rankings against expected passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_ranks(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, rank of the first expected passage (null if none came): `ranked` has query_id, chunk_id, rank."""
    hit = ranked.join(expected.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return expected.select("query_id").distinct().join(hit, "query_id", "left")


def metrics(ranks: DataFrame, by: list[str] = ()) -> DataFrame:
    """queries, recall_1, recall_5, mrr[, per group]: `ranks` has rank (null for a miss)."""
    at = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return ranks.groupBy(*by).agg(
        F.count("*").alias("queries"), F.round(at(1), 6).alias("recall_1"), F.round(at(5), 6).alias("recall_5"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")
    )


def leaks(ranked: DataFrame, passages: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, leaked: results from another project than the query's own; global passages are no leak."""
    own = ranked.join(passages.select("chunk_id", "project"), "chunk_id").join(queries.select("query_id", F.col("project").alias("own")), "query_id")
    return own.groupBy("query_id").agg(F.count_if((F.col("project") != "") & (F.col("project") != F.col("own"))).alias("leaked"))
