"""One ranking from several differently scaled scores.

A walk over the items of a query: from an item, pick one of the query's labels at random and jump to an item that is
ranked at least as high under it, all of them alike (the item itself among them; an item without a valid score under the
label is below all that have one). With damping the walk has one stationary distribution; items are ordered by it. Only
ranks enter, so no label wins by its scale.

The jump sums are suffix sums over each label's order, so a step costs one pass over the scores. Queries of up to
`LOCAL_ROWS` scores are walked whole, thousands at a time in one numpy table. Larger ones, of any size, are walked as
DataFrames: their orders are cut into range partitions, sums are taken within blocks and carried over block totals.

An item that alone is best under every label gets from every other item at least the share that any item gets, and keeps
all its own: it is always first. Therefore the exact test for it needs to look at the first item only.

Null queries, chunks, labels and null, NaN or infinite scores are left out; repeated scores of an item under one label
count once, the best of them. Ties in the distribution are ordered by chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skriva.functions.text import strip_ws
from skriva.session import cut

# Whether less is better under a label.
LOWER_IS_BETTER = {"all-terms": True, "keyword": True, "partial": True, "substring": False, "semantic": False}

DAMPING = 0.85
TOLERANCE = 1e-9
MAX_STEPS = 200
#: Scores of one query that are walked in one task.
LOCAL_ROWS = 1000
#: Scores in one range partition of the large path.
BLOCK_ROWS = 200_000

SCHEMA = "query_id bigint, chunk_id bigint, stationary double, position int, firsts int, labels int"


def oriented(hits: DataFrame, lower: dict[str, bool] = LOWER_IS_BETTER) -> DataFrame:
    """query_id, chunk_id, label, g: valid scores turned so that more is better, one per item and label."""
    label = F.translate(F.lower(strip_ws(F.col("matched_by"))), "_", "-")
    score = F.col("score").cast("double")
    low = [k for k, v in lower.items() if v]
    valid = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < math.inf)
    return (
        hits.select(F.col("query_id").cast("long"), F.col("chunk_id").cast("long"), label.alias("label"), score.alias("score"))
        .where(valid)
        .where(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("label").isin(list(lower)))
        .groupBy("query_id", "chunk_id", "label")
        .agg(F.max(F.when(F.col("label").isin(low), -F.col("score")).otherwise(F.col("score")) + F.lit(0.0)).alias("g"))
    )


def walk(query: np.ndarray, label: np.ndarray, chunk: np.ndarray, g: np.ndarray, damping: float = DAMPING, tolerance: float = TOLERANCE, steps: int = MAX_STEPS) -> tuple[np.ndarray, ...]:
    """Scores of whole queries, in any order -> query, chunk, stationary, position, firsts, labels per item."""
    order = np.lexsort((-g, label, query))
    query, label, chunk, g = query[order], label[order], chunk[order], g[order]
    n = len(g)
    new_list = np.r_[True, (query[1:] != query[:-1]) | (label[1:] != label[:-1])]
    list_of = np.cumsum(new_list) - 1
    list_start = np.flatnonzero(new_list)
    list_size = np.diff(np.append(list_start, n))
    new_tie = new_list | np.r_[True, g[1:] != g[:-1]]
    tie_of = np.cumsum(new_tie) - 1
    tie_start = np.flatnonzero(new_tie)
    tie_end = np.append(tie_start[1:], n)
    at_least = (tie_end[tie_of] - list_start[list_of]).astype(float)
    alone_first = (tie_start[tie_of] == list_start[list_of]) & (tie_end[tie_of] - tie_start[tie_of] == 1)

    by_item = np.lexsort((chunk, query))
    q2, c2 = query[by_item], chunk[by_item]
    new_item = np.r_[True, (q2[1:] != q2[:-1]) | (c2[1:] != c2[:-1])]
    item = np.empty(n, np.int64)
    item[by_item] = np.cumsum(new_item) - 1
    item_query, item_chunk = q2[new_item], c2[new_item]
    new_query = np.r_[True, item_query[1:] != item_query[:-1]]
    group = np.cumsum(new_query) - 1
    group_size = np.bincount(group)
    group_of_list = group[item[list_start]]
    lists = np.bincount(group_of_list)
    m = len(item_query)
    below = 1.0 / (list_size + 1)
    # What an item keeps under the labels that have no score of it.
    kept = np.bincount(group_of_list, below, len(lists))[group] - np.bincount(item, below[list_of], m)
    p = 1.0 / group_size[group]
    rest = (1 - damping) / group_size[group]
    factor = damping / lists[group]
    for _ in range(steps):
        pe = p[item]
        share = pe / at_least
        # Suffix sums within each list, from the first of the ties.
        total = np.cumsum(share[::-1])[::-1]
        after = np.append(total, 0.0)[np.append(list_start[1:], n)]
        suffix = total[tie_start[tie_of]] - after[list_of]
        unscored = (1.0 - np.bincount(list_of, pe, len(list_start))).clip(0) * below
        flow = np.bincount(item, suffix + unscored[list_of], m) + p * kept
        q = rest + factor * flow
        q /= np.bincount(group, q)[group]
        change = np.abs(q - p)
        p = q
        if np.bincount(group, change).max(initial=0) < tolerance:
            break
    firsts = np.bincount(item, alone_first, m).astype(np.int32)
    rank_order = np.lexsort((item_chunk, -np.round(p, 12), group))
    position = np.empty(m, np.int32)
    start = np.append(0, np.cumsum(group_size))[:-1]
    position[rank_order] = (np.arange(m) - start[group[rank_order]] + 1).astype(np.int32)
    return item_query, item_chunk, p, position, firsts, lists[group].astype(np.int32)


def _walk_small(scores: DataFrame) -> DataFrame:
    """Queries as rows of arrays, so that a batch holds whole queries."""
    names = sorted(LOWER_IS_BETTER)
    packed = scores.groupBy("query_id").agg(F.collect_list(F.struct("chunk_id", F.array_position(F.lit(names), F.col("label")).cast("int").alias("l"), "g")).alias("s"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            query = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            if not len(query):
                continue
            cols = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)]
            out = walk(query, cols[1], cols[0], cols[2])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["query_id", "chunk_id", "stationary", "position", "firsts", "labels"])

    return packed.mapInArrow(go, SCHEMA)


def _walk_large(scores: DataFrame, rows: int, damping: float, tolerance: float, steps: int, block_rows: int) -> DataFrame:
    """The same walk for queries of any size; `rows` is the number of scores."""
    q, ql, qlp = ["query_id"], ["query_id", "label"], ["query_id", "label", "block"]
    parts = max(1, math.ceil(rows / block_rows))
    # Equal scores are one row here, so neither ties nor a long order gather in a task.
    ties = scores.groupBy(*ql, "g").agg(F.count("*").alias("n")).repartitionByRange(parts, *ql, F.col("g").desc())
    ties = cut(ties.withColumn("block", F.spark_partition_id()))
    totals = ties.groupBy(*qlp).agg(F.sum("n").alias("t"))
    earlier = Window.partitionBy(*ql).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*ql).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    before = totals.withColumn("before", F.coalesce(F.sum("t").over(earlier), F.lit(0))).drop("t")
    upto = F.sum("n").over(Window.partitionBy(*qlp).orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ties.join(before, qlp).select(*qlp, "g", "n", (F.col("before") + upto).alias("at_least"))
    lists = scores.groupBy(*ql).agg(F.count("*").alias("size")).withColumn("below", 1 / (F.col("size") + 1))
    lists = cut(lists)
    per_query = lists.groupBy(*q).agg(F.count("*").alias("labels"), F.sum("below").alias("all_below"))
    entries = cut(scores.join(ranked, [*ql, "g"]).join(lists.select(*ql, "below"), ql))
    items = entries.groupBy("query_id", "chunk_id").agg(
        F.sum("below").alias("in_below"), F.sum(F.when((F.col("at_least") == 1) & (F.col("n") == 1), 1).otherwise(0)).cast("int").alias("firsts")
    )
    sizes = items.groupBy(*q).agg(F.count("*").alias("items")).join(per_query, q)
    items = cut(items.join(sizes, q).withColumn("kept", F.col("all_below") - F.col("in_below")).withColumn("p", 1 / F.col("items")))
    for _ in range(steps):
        given = entries.join(items.select("query_id", "chunk_id", "p"), ["query_id", "chunk_id"])
        tie_sums = given.groupBy(*qlp, "g").agg(F.sum(F.col("p") / F.col("at_least")).alias("s"), F.sum("p").alias("m"))
        block_sums = tie_sums.groupBy(*qlp).agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
        carried = block_sums.select(
            *qlp,
            F.coalesce(F.sum("s").over(later), F.lit(0.0)).alias("carry"),
            F.greatest(F.lit(0.0), 1 - F.sum("m").over(Window.partitionBy(*ql))).alias("unscored"),
        )
        within = F.sum("s").over(Window.partitionBy(*qlp).orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
        suffix = tie_sums.join(carried, qlp).select(*qlp, "g", (F.col("carry") + within).alias("suffix"), "unscored")
        flow = (
            entries.join(suffix, [*qlp, "g"])
            .groupBy("query_id", "chunk_id")
            .agg(F.sum(F.col("suffix") + F.col("unscored") * F.col("below")).alias("flow"))
        )
        moved = items.join(flow, ["query_id", "chunk_id"]).withColumn(
            "next", (1 - damping) / F.col("items") + damping / F.col("labels") * (F.col("flow") + F.col("p") * F.col("kept"))
        )
        moved = cut(moved.drop("flow"))
        change = moved.groupBy(*q).agg(F.sum(F.abs(F.col("next") - F.col("p"))).alias("c")).agg(F.max("c")).first()[0]
        items = moved.withColumn("p", F.col("next")).drop("next")
        if change is None or change < tolerance:
            break
    # Positions by range partitions, like the orders above.
    spread = items.select("query_id", "chunk_id", "p", "firsts", "labels", F.round("p", 12).alias("r"))
    spread = cut(spread.repartitionByRange(parts, "query_id", F.col("r").desc(), "chunk_id").withColumn("block", F.spark_partition_id()))
    counts = spread.groupBy("query_id", "block").agg(F.count("*").alias("t"))
    earlier_q = Window.partitionBy("query_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("query_id", "block", F.coalesce(F.sum("t").over(earlier_q), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("query_id", "block").orderBy(F.col("r").desc(), "chunk_id"))
    return spread.join(offsets, ["query_id", "block"]).select(
        "query_id", "chunk_id", F.col("p").alias("stationary"), (F.col("before") + nth).cast("int").alias("position"), "firsts", F.col("labels").cast("int").alias("labels")
    )


def rank_items(hits: DataFrame, local_rows: int = LOCAL_ROWS, damping: float = DAMPING, tolerance: float = TOLERANCE, steps: int = MAX_STEPS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, chunk_id, stationary, position (from 1), firsts (labels under which it alone is best), labels (of the query)."""
    scores = oriented(hits)
    sizes = scores.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > local_rows)
    large = sizes.select("query_id", "n")
    total = large.agg(F.sum("n")).first()[0]
    if not total:
        return _walk_small(scores)
    large = cut(large)
    small = _walk_small(scores.join(large, "query_id", "left_anti"))
    rest = cut(scores.join(large.select("query_id"), "query_id", "left_semi"))
    return small.unionByName(_walk_large(rest, total, damping, tolerance, steps, block_rows))


def clear_winners(ranked: DataFrame) -> DataFrame:
    """query_id, chunk_id of first items that alone are best under every label of their query, of two labels at least."""
    return ranked.where("position = 1 AND labels >= 2 AND firsts = labels").select("query_id", "chunk_id")
