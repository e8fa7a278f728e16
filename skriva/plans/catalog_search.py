"""Queries on retrieval: rankings, fusion, selection. The stated query set runs against all passages, where a query doesn't say that it takes the whole log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriva.functions import scoring, text
from skriva.memory import search_log
from skriva.operators import evaluate, review, search, select, vectors
from skriva.plans import sqlparts as s
from skriva.plans.registry import query
from skriva.session import cut, stored
from skriva.sources.tables import passages, table

DEPTH = search.depth_of(search.DEFAULT_LIMIT)
NOW = s.NOW
#: The project whose view the scoped queries take.
PROJECT = "pebble"
_SCOPED = f"project IN ('{PROJECT}', '')"


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").where("id % 50 = 0").select(F.col("id").alias("query_id"), "text").distinct()


def asked_all(spark: SparkSession, d: str) -> DataFrame:
    """Every query of the log."""
    return table(spark, d, "queries").select(F.col("id").alias("query_id"), "text").distinct()


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return passages(table(spark, d, "chunks"), table(spark, d, "notes"))


def _keyword(spark: SparkSession, d: str, scope=None, depth: int = DEPTH, labels: tuple[str, ...] = search.LABELS) -> DataFrame:
    return search.keyword_rankings(_passages(spark, d), asked(spark, d), depth, scope, labels)


@query(f"WITH {s.BM25} SELECT query_id, rank, chunk_id, score FROM ({s.keyword_rankings(DEPTH)}) WHERE label = 'keyword'")
def bm25_keyword(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d, labels=("keyword",)).select("query_id", "rank", "chunk_id", "score")


_WHOLE_LOG = s.BM25.replace(s.ASKED, "q AS (SELECT DISTINCT id AS query_id, text FROM queries)")


@query(f"WITH {_WHOLE_LOG} SELECT query_id, rank, chunk_id, score FROM ({s.keyword_rankings(DEPTH)}) WHERE label = 'all-terms'")
def bm25_all_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every query of the log against all passages."""
    found = search.keyword_rankings(_passages(spark, d), asked_all(spark, d), DEPTH, labels=("all-terms",))
    return found.select("query_id", "rank", "chunk_id", "score")


_CASES = s.BM25.replace(s.ASKED, "q AS (SELECT item_id AS query_id, question AS text FROM eval_items)").replace(
    s.PASSAGES, "p AS (SELECT turn_id AS chunk_id, '' AS title, '' AS tags, '' AS breadcrumb, coalesce(text, '') AS body FROM turns)"
)


@query(f"WITH {_CASES} SELECT query_id, rank, chunk_id, score FROM ({s.keyword_rankings(DEPTH)}) WHERE label = 'partial'")
def partial_windows(spark: SparkSession, d: str) -> DataFrame:
    """The questions of the retrieval cases, many of them Japanese, against the turns, which answer few in full."""
    questions = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    texts = table(spark, d, "turns").select(F.col("turn_id").alias("chunk_id"), *(F.lit("").alias(c) for c in ("title", "tags", "breadcrumb")), F.coalesce("text", F.lit("")).alias("body"))
    return search.keyword_rankings(texts, questions, DEPTH, labels=("partial",)).select("query_id", "rank", "chunk_id", "score")


@query(f"WITH {s.BM25} SELECT query_id, rank, chunk_id, score FROM ({s.substring_ranking(DEPTH)})")
def substring_rank(spark: SparkSession, d: str) -> DataFrame:
    return search.substring_ranking(_passages(spark, d), asked(spark, d), DEPTH).select("query_id", "rank", "chunk_id", "score")


@query(f"WITH {s.BM25} SELECT query_id, label, rank, chunk_id FROM ({s.keyword_rankings(DEPTH, _SCOPED)})")
def keyword_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d, search.in_scope("project", PROJECT)).select("query_id", "label", "rank", "chunk_id")


def _rankings(p: DataFrame, q: DataFrame) -> DataFrame:
    return search.keyword_rankings(p, q, DEPTH).unionByName(search.substring_ranking(p, q, DEPTH))


_RANKINGS = f"{s.BM25}, rankings AS ({s.keyword_rankings(DEPTH)} UNION ALL {s.substring_ranking(DEPTH)}), {s.FUSED}"


@query(f"WITH {_RANKINGS} SELECT query_id, chunk_id, fused, matched_by FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return search.fuse(_rankings(stored(_passages(spark, d)), asked(spark, d))).select("query_id", "chunk_id", "fused", "matched_by")


def _positions(usage: bool) -> str:
    boost = f", round(tiered * (1 + 0.25 * coalesce({s.USAGE_SCORE}, 0.0)), 11) AS score" if usage else ", tiered AS score"
    join = "LEFT JOIN (SELECT path, uses, last_used, pinned FROM usage) USING (path)" if usage else ""
    return f"SELECT query_id, chunk_id, path, tokens, body, fused, tiered, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tiered DESC, fused DESC, first, chunk_id) AS position FROM (SELECT *{boost} FROM tiered {join})"


@query(f"WITH {_RANKINGS} SELECT query_id, position, chunk_id, tiered FROM ({_positions(False)})")
def tier_prior(spark: SparkSession, d: str) -> DataFrame:
    p = stored(_passages(spark, d))
    return search.boosted(search.fuse(_rankings(p, asked(spark, d))), p).select("query_id", "position", "chunk_id", "tiered")


def _path_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage per note path from the log's results: a row of `hits` shows the note, one under all-terms uses it, one under partial pins it."""
    hits, q = table(spark, d, "hits").select("query_id", "chunk_id", "matched_by").distinct(), table(spark, d, "queries").select(F.col("id").alias("query_id"), "ts").distinct()
    chunk = table(spark, d, "chunks").select("chunk_id", "note_id").distinct()
    notes = passages_notes(spark, d)
    rows = hits.join(q, "query_id").join(chunk, "chunk_id").join(notes, "note_id")
    label = F.translate(F.lower(text.strip_ws(F.col("matched_by"))), "_", "-")
    kind = F.when(label == "all-terms", "used").when(label == "partial", "pin").otherwise("shown")
    return review.usage_of(rows.select("path", kind.alias("kind"), "ts", F.lit(1).alias("pinned")))


def passages_notes(spark: SparkSession, d: str) -> DataFrame:
    from skriva.sources.tables import latest_notes

    return latest_notes(table(spark, d, "notes")).select("note_id", "path")


_PATH_USAGE = f"""
usage AS (SELECT path, count(*) FILTER (k = 'shown') AS impressions, count(*) FILTER (k = 'used') AS uses, coalesce(max(ts) FILTER (k = 'used'), 0.0) AS last_used, coalesce(max((k = 'pin' AND ts IS NOT NULL)::INT), 0) AS pinned
  FROM (SELECT n.path, q.ts, CASE replace(lower({s.strip("h.matched_by")}), '_', '-') WHEN 'all-terms' THEN 'used' WHEN 'partial' THEN 'pin' ELSE 'shown' END AS k
        FROM (SELECT DISTINCT query_id, chunk_id, matched_by FROM hits) h JOIN (SELECT DISTINCT id, ts FROM queries) q ON h.query_id = q.id
        JOIN (SELECT DISTINCT chunk_id, note_id FROM chunks) c ON h.chunk_id = c.chunk_id JOIN n ON c.note_id = n.note_id) WHERE path IS NOT NULL GROUP BY path)"""


@query(f"WITH {_RANKINGS}, {_PATH_USAGE} SELECT query_id, position, chunk_id, score FROM ({_positions(True)})")
def usage_boost(spark: SparkSession, d: str) -> DataFrame:
    p = stored(_passages(spark, d))
    ranked = search.boosted(search.fuse(_rankings(p, asked(spark, d))), p, _path_usage(spark, d), NOW)
    return ranked.select("query_id", "position", "chunk_id", "score")


def _priced(spark: SparkSession, d: str) -> DataFrame:
    """The passages, stored, each row with its number and cost."""
    return stored(_passages(spark, d).withColumn("cost", select.cost(F.col("tokens"), F.col("body"))), "row")


def _selected(spark: SparkSession, d: str, dedupe: bool) -> DataFrame:
    """What the stated queries return; queries of the same text are searched once."""
    p, (q, of) = _priced(spark, d), search.asked_once(asked(spark, d))
    ordered = search.boosted(search.fuse(_rankings(p, q)), p)
    return search.answered(select.select_stored(ordered, p, search.DEFAULT_LIMIT, search.DEFAULT_BUDGET, dedupe), of)


_COST = f"CASE WHEN coalesce(tokens, 0) > 0 THEN tokens ELSE {s.tokens('body')} END"


@query(
    f"""WITH {_RANKINGS}, pos AS ({_positions(False)}),
packed AS (SELECT query_id, list(struct_pack(c := chunk_id, t := {_COST}) ORDER BY position) AS items FROM pos GROUP BY query_id),
picked AS (SELECT query_id, items, list_reduce(items, lambda a, x: CASE WHEN len(a.hits) = 8 THEN a
    WHEN a.spent + x.t > 2000 THEN struct_pack(hits := a.hits, spent := a.spent, over := a.over + 1)
    ELSE struct_pack(hits := list_append(a.hits, x.c), spent := a.spent + x.t, over := a.over) END,
  struct_pack(hits := []::BIGINT[], spent := 0::BIGINT, over := 0::BIGINT)) AS r FROM packed)
SELECT query_id, array_to_string(r.hits, ',') AS hits, len(r.hits) AS returned, r.spent AS tokens, len(items) AS considered, r.over AS truncated FROM picked"""
)
def budget_select(spark: SparkSession, d: str) -> DataFrame:
    chosen = _selected(spark, d, False)
    return chosen.select("query_id", F.array_join(F.col("hits").cast("array<string>"), ",").alias("hits"), "returned", "tokens", "considered", "truncated")


_SHINGLES = "list_distinct(list_transform(range(1, length(nb) - 3), lambda i: substr(nb, i::INTEGER, 5)))"


@query(
    f"""WITH {_RANKINGS}, pos AS (SELECT *, {s.squeeze('body')} AS nb FROM ({_positions(False)})),
sets AS MATERIALIZED (SELECT query_id, position, chunk_id, {_COST} AS cost, {_SHINGLES} AS g FROM pos),
packed AS (SELECT query_id, list(struct_pack(c := chunk_id, t := cost, g := g) ORDER BY position) AS items FROM sets GROUP BY query_id),
picked AS (SELECT query_id, items, list_reduce(items, lambda a, x: CASE WHEN len(a.hits) = 8 THEN a
    WHEN len(x.g) >= 12 AND len(list_filter(a.kept, lambda k: len(k) >= 12 AND len(list_intersect(k, x.g)) / least(len(k), len(x.g)) >= 0.7)) > 0
      THEN struct_pack(hits := a.hits, kept := a.kept, spent := a.spent, over := a.over, same := a.same + 1)
    WHEN a.spent + x.t > 2000 THEN struct_pack(hits := a.hits, kept := a.kept, spent := a.spent, over := a.over + 1, same := a.same)
    ELSE struct_pack(hits := list_append(a.hits, x.c), kept := list_append(a.kept, x.g), spent := a.spent + x.t, over := a.over, same := a.same) END,
  struct_pack(hits := []::BIGINT[], kept := []::VARCHAR[][], spent := 0::BIGINT, over := 0::BIGINT, same := 0::BIGINT)) AS r FROM packed)
SELECT query_id, array_to_string(r.hits, ',') AS hits, len(r.hits) AS returned, r.spent AS tokens, len(items) AS considered, r.over AS truncated, r.same AS redundant FROM picked"""
)
def redundancy_select(spark: SparkSession, d: str) -> DataFrame:
    chosen = _selected(spark, d, True)
    return chosen.withColumn("hits", F.array_join(F.col("hits").cast("array<string>"), ","))


@query(
    f"""WITH {s.PASSAGES} SELECT note_id, chunk_id, spent FROM (
  SELECT note_id, chunk_id, sum({_COST}) OVER (PARTITION BY note_id ORDER BY seq, chunk_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM p WHERE seq IS NOT NULL) WHERE spent <= 2000"""
)
def read_truncate(spark: SparkSession, d: str) -> DataFrame:
    from skriva.operators.blocked import running_sum

    rows = _passages(spark, d).where("seq IS NOT NULL")
    summed = running_sum(rows, ["note_id"], ["seq", "chunk_id"], select.cost(F.col("tokens"), F.col("body")), "spent")
    return summed.where("spent <= 2000").select("note_id", "chunk_id", "spent")


@query(
    f"""WITH {s.BM25}, a AS (SELECT DISTINCT query_id, chunk_id FROM ({s.keyword_rankings(200)})), b AS (SELECT DISTINCT query_id, chunk_id FROM ({s.keyword_rankings(200, _SCOPED)}))
SELECT query_id, count(chunk_id) AS outside FROM (SELECT DISTINCT query_id FROM q) LEFT JOIN (SELECT * FROM a EXCEPT SELECT * FROM b) USING (query_id) GROUP BY ALL"""
)
def outside_scope(spark: SparkSession, d: str) -> DataFrame:
    return search.outside_scope(_passages(spark, d), asked(spark, d), search.in_scope("project", PROJECT))


@query(
    f"""WITH {s.BM25}, scoped AS ({s.keyword_rankings(DEPTH, _SCOPED)}), wide AS ({s.keyword_rankings(DEPTH)})
SELECT query_id, label, rank, chunk_id, false AS widened FROM scoped UNION ALL
SELECT query_id, label, rank, chunk_id, true FROM wide WHERE query_id NOT IN (SELECT query_id FROM scoped)"""
)
def widen_on_miss(spark: SparkSession, d: str) -> DataFrame:
    p, q, scope = _passages(spark, d), asked(spark, d), search.in_scope("project", PROJECT)
    index = search.keyword_index(p, q, scope)
    scoped = cut(search.keyword_rankings(p, q, DEPTH, scope, index=index))
    missed = q.join(scoped.select("query_id").distinct(), "query_id", "left_anti")
    wide = search.keyword_rankings(p, missed, DEPTH, index=index)
    columns = ["query_id", "label", "rank", "chunk_id"]
    return scoped.select(*columns, F.lit(False).alias("widened")).unionByName(wide.select(*columns, F.lit(True).alias("widened")))


_COSINE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
sim AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6) AS score
        FROM v a, v b WHERE a.vec_id % 50 = 0 {scope})
SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sim WHERE score >= 0.3) WHERE rank <= {depth}"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 50 = 0"), v


@query("WITH " + _COSINE.format(scope="", depth=DEPTH))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.cosine_ranking(*_vectors(spark, d), DEPTH).select("query_id", "rank", "chunk_id", "score")


@query("WITH " + _COSINE.format(scope="AND a.label = b.label", depth=DEPTH))
def cosine_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Each query sees the vectors of its own label."""
    q, v = _vectors(spark, d)
    out = None
    # One scan per label; labels are the projects of this table, some ten.
    for label in [r[0] for r in v.select("label").distinct().collect()]:
        part = vectors.cosine_ranking(q.where(F.col("label").eqNullSafe(label)), v.where(F.col("label").eqNullSafe(label)), DEPTH)
        out = part if out is None else out.unionByName(part)
    return out.select("query_id", "rank", "chunk_id", "score")


@query()
def ann_cells(spark: SparkSession, d: str) -> DataFrame:
    """Search through an index of cells, with as many probes as the recall takes on this table; tested against `cosine_topk`."""
    q, v = _vectors(spark, d)
    cells, indexed, _ = vectors.rebuild_index(v)
    if cells is None:
        return vectors.cosine_ranking(q, v, DEPTH).select("query_id", "rank", "chunk_id", "score")
    probes = vectors.probes_for(q, indexed, cells, DEPTH)
    return vectors.ann_ranking(q, indexed, cells, probes, DEPTH).select("query_id", "rank", "chunk_id", "score")


#: The labels that a scoped vector search may see.
SEEN_LABELS = [0, 1, 2, 3, 4]


@query("WITH " + _COSINE.format(scope=f"AND b.label IN ({', '.join(map(str, SEEN_LABELS))})", depth=DEPTH))
def cosine_seen(spark: SparkSession, d: str) -> DataFrame:
    """All queries among the vectors of some labels, exactly."""
    q, v = _vectors(spark, d)
    return vectors.cosine_ranking(q, v.where(F.col("label").isin(SEEN_LABELS)), DEPTH).select("query_id", "rank", "chunk_id", "score")


@query()
def ann_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The same through the index: the scope holds before the cut; tested against `cosine_seen`."""
    q, v = _vectors(spark, d)
    cells, indexed, _ = vectors.rebuild_index(v, keep=["label"])
    scope = F.col("label").isin(SEEN_LABELS)
    if cells is None:
        return vectors.cosine_ranking(q, v.where(scope), DEPTH).select("query_id", "rank", "chunk_id", "score")
    probes = vectors.probes_for(q, indexed.where(scope), cells, DEPTH)
    return vectors.ann_ranking(q, indexed, cells, probes, DEPTH, scope=scope).select("query_id", "rank", "chunk_id", "score")


@query()
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The whole search of a project for every query of the log: keyword, substring and vector rankings, fused, weighed and
    chosen, and asked again of everything where the project has nothing. Texts are encoded by the hashing encoder."""
    p = _priced(spark, d)
    encoded = stored(vectors.encode_texts(p.select("chunk_id", F.concat_ws("\n", "breadcrumb", "body").alias("t")), "chunk_id", "t").withColumnRenamed("chunk_id", "vec_id"))

    def meaning(asked: DataFrame) -> DataFrame:
        return vectors.stored_ranking(vectors.encode_texts(asked, "query_id", "text").withColumnRenamed("query_id", "vec_id"), encoded, DEPTH)

    return search_log(p, asked_all(spark, d), meaning, scope="project", project=PROJECT, usage=stored(_path_usage(spark, d)), now=NOW)


@query("SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.missing_vectors(table(spark, d, "chunks"), table(spark, d, "embeddings"))


_LABEL = f"replace(lower({s.strip('matched_by')}), '_', '-')"


@query(
    f"""WITH h AS (SELECT DISTINCT query_id, chunk_id, {_LABEL} AS label, score FROM hits WHERE score IS NOT NULL AND isfinite(score)),
g AS (SELECT query_id, chunk_id, label, max(CASE WHEN label IN ('substring', 'semantic') THEN score ELSE -score END) AS g FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY g DESC, chunk_id) AS rank FROM g),
fused AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS f FROM r GROUP BY ALL),
best AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, chunk_id) AS k FROM fused) WHERE k = 1),
judged AS (SELECT l.label, b.query_id, min(r.rank) AS rank FROM best b JOIN (SELECT DISTINCT query_id, label FROM r) l USING (query_id)
           LEFT JOIN r ON r.query_id = b.query_id AND r.chunk_id = b.chunk_id AND r.label = l.label GROUP BY ALL)
SELECT label, count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5,
       round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM judged GROUP BY label"""
)
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How well each label alone finds the passage that all labels together put first."""
    from pyspark.sql.window import Window

    label = F.translate(F.lower(text.strip_ws(F.col("matched_by"))), "_", "-").alias("label")
    rows = table(spark, d, "hits").where("score IS NOT NULL AND NOT isnan(score) AND abs(score) < double('inf')").select("query_id", "chunk_id", label, "score").distinct()
    high = F.when(F.col("label").isin("substring", "semantic"), F.col("score")).otherwise(-F.col("score"))
    ranked = rows.groupBy("query_id", "chunk_id", "label").agg(F.max(high).alias("g"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "label").orderBy(F.col("g").desc(), "chunk_id")))
    fused = ranked.groupBy("query_id", "chunk_id").agg(F.sum(scoring.rrf_part(F.col("rank"))).alias("f"))
    best = fused.groupBy("query_id").agg(F.max_by("chunk_id", F.struct(F.round("f", 9), -F.col("chunk_id"))).alias("chunk_id"))
    wanted = best.join(ranked.select("query_id", "label").distinct(), "query_id")
    judged = wanted.join(ranked, ["query_id", "chunk_id", "label"], "left").select("query_id", "label", "rank")
    return evaluate.metrics(judged, ["label"]).select("label", "queries", "recall_1", "recall_5", "mrr")




@query(f"WITH {s.PASSAGES} SELECT chunk_id, path, project, tier, row_number() OVER (PARTITION BY note_id ORDER BY seq, chunk_id) AS nth FROM p")
def passage_join(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("note_id").orderBy("seq", "chunk_id")).cast("long")
    return _passages(spark, d).select("chunk_id", "path", "project", "tier", nth.alias("nth"))


@query(
    f"""WITH {s.PASSAGES} SELECT chunk_id, '- [[' || {s.stem("path")} || ']]' || CASE WHEN breadcrumb <> '' THEN ' (' || breadcrumb || ')' ELSE '' END AS line,
CASE WHEN project IS NULL THEN 'unknown' WHEN project = '' THEN 'global' ELSE 'project ' || project END AS origin FROM p"""
)
def result_render(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("- [["), text.file_stem(F.col("path")), F.lit("]]"), F.when(F.col("breadcrumb") != "", F.concat(F.lit(" ("), "breadcrumb", F.lit(")"))).otherwise(""))
    origin = F.when(F.col("project").isNull(), "unknown").when(F.col("project") == "", "global").otherwise(F.concat(F.lit("project "), "project"))
    return _passages(spark, d).select("chunk_id", line.alias("line"), origin.alias("origin"))
