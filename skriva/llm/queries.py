"""Queries and SQL of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriva.llm import conversations as conv
from skriva.llm import leakage, pii, quality, rankwalk, secrets, splitter, terms, tokenizer

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@_query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conv.dropped_sessions(_t(spark, d, "turns"), _t(spark, d, "sessions"))


@_query
def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conv.conversations(_t(spark, d, "turns"))


@_query
def p1_latest(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with the last version of each turn, so that edits, deletes and retries drop no session."""
    return conv.conversations(_t(spark, d, "turns"), keep="latest")


#: In RE2's spelling, for DuckDB.
_WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_P1_BASE = rf"""
WITH named AS (
  SELECT *, regexp_replace(lower(regexp_replace(session_id, '^[{_WS}]+|[{_WS}]+$', '', 'g')), '^rollout-', '') AS sid,
         lower(regexp_replace(kind, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS k0
  FROM turns),
rows_ AS (
  SELECT DISTINCT sid, seq, CASE k0 WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'agent' ELSE k0 END AS k, text, detail
  FROM named WHERE sid IS NOT NULL AND sid <> ''),
told AS (
  SELECT *, CASE WHEN k = 'user' THEN 'U' WHEN k = 'agent' THEN 'A' ELSE 'O' END AS s FROM rows_
  WHERE NOT (coalesce(k, '') IN ('user', 'agent') AND NOT coalesce(regexp_matches(text, '[^{_WS}]'), false))),
seen AS (SELECT sid, string_agg(s, '' ORDER BY seq) AS s FROM told GROUP BY sid),
sizes AS (SELECT sid, count(*) AS n, count(DISTINCT seq) AS d, max(seq) AS high FROM rows_ GROUP BY sid),
judged AS (
  SELECT z.sid, n <> d OR d <> high + 1 OR NOT contains(coalesce(s, ''), 'U') OR NOT contains(coalesce(s, ''), 'A')
         OR regexp_matches(coalesce(s, ''), 'UO+U|UO*$') AS bad
  FROM sizes z LEFT JOIN seen USING (sid))
"""
_SQL["p1_found"] = (
    _P1_BASE
    + rf"""
SELECT sid AS session_id FROM judged WHERE bad
UNION
SELECT sid FROM (SELECT regexp_replace(lower(regexp_replace(session_id, '^[{_WS}]+|[{_WS}]+$', '', 'g')), '^rollout-', '') AS sid
                 FROM sessions) WHERE sid IS NOT NULL AND sid <> '' AND sid NOT IN (SELECT sid FROM rows_)
"""
)
_SQL["p1_latest"] = (
    _P1_BASE.replace("SELECT DISTINCT sid, seq, CASE", "SELECT sid, seq, CASE").replace(
        "WHERE sid IS NOT NULL AND sid <> ''),",
        "WHERE sid IS NOT NULL AND sid <> '' QUALIFY row_number() OVER (PARTITION BY sid, seq ORDER BY logged_at DESC NULLS LAST, turn_id DESC NULLS LAST) = 1),",
    )
    + """
SELECT sid AS session_id, row_number() OVER (PARTITION BY sid ORDER BY seq) - 1 AS position,
       CASE s WHEN 'U' THEN 'user' ELSE 'agent' END AS role, text
FROM told JOIN judged USING (sid) WHERE NOT bad AND s IN ('U', 'A')
"""
)
_SQL["p1_conversations"] = (
    _P1_BASE
    + """
SELECT sid AS session_id, row_number() OVER (PARTITION BY sid ORDER BY seq) - 1 AS position,
       CASE s WHEN 'U' THEN 'user' ELSE 'agent' END AS role, text
FROM told JOIN judged USING (sid) WHERE NOT bad AND s IN ('U', 'A')
"""
)


def _all_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(terms.tag_terms(_t(spark, d, "notes")).unionByName(terms.gap_terms(_t(spark, d, "queries"))))


@_query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _all_terms(spark, d).where("mark IS NOT NULL").select("field_name", "term", "mark")


@_query
def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return _all_terms(spark, d)


@_query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secret_fields(_t(spark, d, "turns"), "turn_id", ["text", "detail"]).select("turn_id", "field_name").distinct()


@_query
def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secret_fields(_t(spark, d, "turns"), "turn_id", ["text", "detail"], redact=True)


@_query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitter.split_items(_t(spark, d, "chunks"), "chunk_id", "body", emit_text=False)
    return pieces.where("pieces > 1").select("chunk_id").distinct()


_SQL["p4_found"] = r"""
WITH c AS (
  SELECT chunk_id, length(regexp_replace(body, '[^\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{ac00}-\x{d7af}]', '', 'g')) AS cjk,
         length(body) AS n FROM chunks)
SELECT DISTINCT chunk_id FROM c WHERE cjk + (n - cjk + 3) // 4 > 400
"""


@_query
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = _t(spark, d, "chunks").dropDuplicates(["chunk_id", "note_id", "seq", "breadcrumb", "body"])
    return splitter.split_items(chunks, "chunk_id", "body", ["breadcrumb"])


@_query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rankwalk.clear_winners(rankwalk.rank_items(_t(spark, d, "hits")))


_SQL["p5_found"] = r"""
WITH v AS (
  SELECT query_id, chunk_id, l, max(CASE WHEN l IN ('all-terms', 'keyword', 'partial') THEN -score ELSE score END) AS g
  FROM (SELECT *, replace(lower(trim(matched_by)), '_', '-') AS l FROM hits)
  WHERE score IS NOT NULL AND isfinite(score) AND query_id IS NOT NULL AND chunk_id IS NOT NULL
    AND l IN ('all-terms', 'keyword', 'partial', 'substring', 'semantic')
  GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY query_id, l ORDER BY g DESC) AS rk FROM v),
b AS (SELECT query_id, l, count(*) AS ties, min(chunk_id) AS chunk_id FROM r WHERE rk = 1 GROUP BY ALL)
SELECT query_id, min(chunk_id) AS chunk_id FROM b GROUP BY query_id
HAVING count(*) >= 2 AND max(ties) = 1 AND min(chunk_id) = max(chunk_id)
"""


@_query
def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rankwalk.rank_items(_t(spark, d, "hits"))


@_query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(_t(spark, d, "documents"), "doc_id", "text")


def _personal(spark: SparkSession, d: str, redact: bool = False) -> DataFrame:
    model = pii.train(pii.known_names(_t(spark, d, "person_names")))
    parts = [
        pii.personal_data(_t(spark, d, table), key, [field], model, redact).withColumn("table_name", F.lit(table)).withColumnRenamed(key, "row_id")
        for table, key, field in (("turns", "turn_id", "text"), ("chunks", "chunk_id", "body"))
    ]
    return parts[0].unionByName(parts[1])


@_query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("table_name", "row_id", "pii_type").distinct()


@_query
def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, redact=True).select("table_name", "row_id", "field_name", "redacted")


@_query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


@_query
def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    leaks = leakage.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))
    return leaks.withColumn("containment", F.round("containment", 6))


_P9_BASE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS t FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 11], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 10)) AS i FROM dw)),
dc AS (SELECT doc_id, regexp_replace(lower(text), '[^\pL\pN]', '', 'g') AS t FROM documents),
dg AS (SELECT DISTINCT doc_id, substr(t, i, 20) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 18)) AS i FROM dc)),
iw AS (SELECT item_id, regexp_extract_all(lower(passage), '[\pL\pN]+') AS t FROM eval_items WHERE lang <> 'ja'),
ic AS (SELECT item_id, regexp_replace(lower(passage), '[^\pL\pN]', '', 'g') AS t FROM eval_items WHERE lang = 'ja'),
isw AS (SELECT DISTINCT item_id, array_to_string(t[i:i + 11], ' ') AS g FROM (SELECT item_id, t, unnest(range(1, len(t) - 10)) AS i FROM iw)),
isc AS (SELECT DISTINCT item_id, substr(t, i, 20) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 18)) AS i FROM ic)),
n AS (SELECT item_id, count(*) AS size FROM (SELECT * FROM isw UNION ALL SELECT * FROM isc) GROUP BY ALL),
hits AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN isw USING (g) GROUP BY ALL
         UNION ALL SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN isc USING (g) GROUP BY ALL)
"""
_SQL["p9_found"] = _P9_BASE + "SELECT doc_id, item_id FROM hits"
_SQL["p9_leaks"] = _P9_BASE + "SELECT doc_id, item_id, shared, round(shared / size, 6) AS containment FROM hits JOIN n USING (item_id)"


@_query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge_documents(_t(spark, d, "documents"), _t(spark, d, "quality_labels")).where("unlike_prose").select("doc_id").distinct()


@_query
def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge_documents(_t(spark, d, "documents"), _t(spark, d, "quality_labels"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
