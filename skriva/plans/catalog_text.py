"""Queries on texts, paths and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriva.functions import scoring, text
from skriva.plans import sqlparts as s
from skriva.plans.registry import query
from skriva.sources import markdown
from skriva.sources.tables import distinct_chunks, table

INCLUDE, EXCLUDE = ["quarry", "kestrel"], ["quarry/README.md", "journal/xenon"]


@query(f"SELECT doc_id, {s.tokens('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, substr(sha256(text), 1, 32) AS digest FROM documents")
def digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.digest(F.col("text")).alias("digest"))


@query(f"SELECT doc_id, {s.squeeze('text')} AS normal FROM documents")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.squeeze(F.col("text")).alias("normal"))


@query(
    f"""WITH t AS (SELECT DISTINCT id, text, {s.query_terms("text")} AS ts FROM queries)
SELECT id, array_to_string(ts, ' ') AS terms, array_to_string(list_filter(ts, lambda x: length(x) >= 3), ' ') AS long_terms, array_to_string(list_filter(ts, lambda x: length(x) < 3), ' ') AS short_terms FROM t"""
)
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = text.query_terms(F.col("text"))
    rows = table(spark, d, "queries").select("id", "text").distinct()
    return rows.select("id", F.array_join(terms, " ").alias("terms"), F.array_join(text.long_terms(terms), " ").alias("long_terms"), F.array_join(text.short_terms(terms), " ").alias("short_terms"))


@query(
    f"""WITH t AS (SELECT DISTINCT unnest({s.query_terms("text")}) AS term FROM queries)
SELECT term, regexp_matches(term, '[{s.SEARCH_CJK}]') AS ideographs, CASE WHEN length(term) >= 5 AND regexp_matches(term, '[{s.SEARCH_CJK}]')
  THEN array_to_string(list_distinct_ordered, '|') ELSE term END AS windows
FROM (SELECT term, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered
      FROM (SELECT term, list_concat([term], list_transform(range(0, greatest(length(term) - 3, 0), 2), lambda i: substr(term, (i + 1)::INTEGER, 4)), [substr(term, greatest(length(term) - 3, 1), 4)]) AS l FROM t))"""
)
def cjk_windows(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "queries").select(F.explode(text.query_terms(F.col("text"))).alias("term")).distinct()
    return terms.select("term", F.col("term").rlike(f"[{text.SEARCH_CJK}]").alias("ideographs"), F.array_join(text.cjk_windows(F.col("term")), "|").alias("windows"))


@query(
    f"""WITH {s.NOTES} SELECT note_id, CASE WHEN starts_with(path, 'journal/episodes/') THEN 'episode' WHEN starts_with(path, 'journal/') THEN 'journal' ELSE 'durable' END AS tier_by_path,
CASE WHEN len(x) = 0 THEN '' WHEN x[1] = 'journal' THEN CASE WHEN len(x) > 2 THEN x[2] ELSE '' END WHEN len(x) > 1 THEN x[1] ELSE '' END AS project_by_path,
coalesce({s.strip("project")}, CASE WHEN len(x) = 0 THEN '' WHEN x[1] = 'journal' THEN CASE WHEN len(x) > 2 THEN x[2] ELSE '' END WHEN len(x) > 1 THEN x[1] ELSE '' END) AS project
FROM (SELECT *, list_filter(string_split(path, '/'), lambda y: y <> '') AS x FROM n)"""
)
def tier_project(spark: SparkSession, d: str) -> DataFrame:
    from skriva.sources.tables import latest_notes

    path = F.col("path")
    return latest_notes(table(spark, d, "notes")).select(
        "note_id", text.tier_of(path).alias("tier_by_path"), text.project_of(path, F.lit(None).cast("string")).alias("project_by_path"), text.project_of(path, F.col("project")).alias("project")
    )


_INSIDE = " OR ".join(f"path = '{p}' OR starts_with(path, '{p}/')" for p in INCLUDE)
_OUTSIDE = " OR ".join(f"path = '{p}' OR starts_with(path, '{p}/')" for p in EXCLUDE)


@query(
    f"""WITH {s.NOTES} SELECT note_id, NOT starts_with(path, 'journal/sessions/') AND NOT ({_OUTSIDE}) AS without_include,
NOT starts_with(path, 'journal/sessions/') AND NOT ({_OUTSIDE}) AND (path = 'journal' OR starts_with(path, 'journal/') OR {_INSIDE}) AS inside FROM n"""
)
def boundary_filter(spark: SparkSession, d: str) -> DataFrame:
    from skriva.sources.tables import latest_notes

    path = F.col("path")
    return latest_notes(table(spark, d, "notes")).select("note_id", text.indexable(path, [], EXCLUDE).alias("without_include"), text.indexable(path, INCLUDE, EXCLUDE).alias("inside"))


_FRONT = r"regexp_extract(coalesce(text, ''), '(?s)\A---[ \t]*\r?\n(.*?\n)---[ \t]*(?:\r?\n|\z)', 1)"


def _meta(key: str) -> str:
    return rf"regexp_replace({s.strip(f"regexp_extract({_FRONT}, '(?m)^{key}:(.*)$', 1)")}, '^[\x22\x27]+|[\x22\x27]+$', '', 'g')"


@query(
    f"""WITH f AS (SELECT doc_id, text, {_meta("title")} AS mt, {_meta("tags")} AS mg, CASE WHEN regexp_matches({_FRONT}, '(?m)^project:') THEN {_meta("project")} END AS mp,
  regexp_replace(regexp_replace(coalesce(text, ''), '(?s)\\A---[ \\t]*\\r?\\n(.*?\\n)---[ \\t]*(?:\\r?\\n|\\z)', ''), '\\A\\n+', '') AS body FROM documents)
SELECT doc_id, CASE WHEN mt <> '' THEN mt ELSE coalesce(nullif({s.strip("regexp_extract(body, '(?m)^#{1,6}[ \\t]+([^\\r\\n]*)', 1)")}, ''), doc_id::VARCHAR) END AS title,
array_to_string(list_transform(list_filter(string_split(regexp_replace(mg, '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), ','), lambda x: trim(x) <> ''), lambda x: trim(x)), '|') AS tags,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\\[\\[([^\\]|#]+)(?:[#|][^\\]]*)?\\]\\]', 1), lambda x: trim(x)))), '|') AS links,
mp AS project FROM f""".replace("\\\\", "\\")
)
def md_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    parsed = markdown.parse_notes(raw)
    project = F.try_element_at(markdown.front_matter(F.col("text")), F.lit("project"))
    return parsed.select("doc_id", "title", F.array_join("tags", "|").alias("tags"), F.array_join("links", "|").alias("links"), text.strip_ws(project).alias("project"))


@query()
def md_chunks(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return markdown.chunk_notes(markdown.parse_notes(raw), "doc_id")


@query(
    rf"""WITH l AS (SELECT chunk_id, string_split_regex(body, '\r\n|\r|\n') AS ls FROM (SELECT DISTINCT * FROM chunks WHERE chunk_id IS NOT NULL) WHERE body IS NOT NULL)
SELECT chunk_id, count(*) AS lines, sum({s.tokens("line")})::BIGINT AS tokens, max(i) AS last FROM (SELECT chunk_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l) GROUP BY chunk_id"""
)
def chunk_seq(spark: SparkSession, d: str) -> DataFrame:
    lines = markdown.line_costs(distinct_chunks(table(spark, d, "chunks")))
    return lines.groupBy("chunk_id").agg(F.count("*").alias("lines"), F.sum("tokens").cast("long").alias("tokens"), F.max("seq").cast("long").alias("last"))


@query(
    f"""WITH t AS (SELECT DISTINCT unnest(tags) AS tag FROM notes), j AS (SELECT doc_id, {_meta("tags")} AS raw FROM documents)
SELECT doc_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(raw, '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), ','), lambda x: trim(x) <> ''), lambda x: trim(x)), '|') AS tags FROM j""".replace("\\\\", "\\")
)
def tag_split(spark: SparkSession, d: str) -> DataFrame:
    raw = F.try_element_at(markdown.front_matter(F.col("text")), F.lit("tags"))
    return table(spark, d, "documents").select("doc_id", F.array_join(text.split_tags(raw), "|").alias("tags"))


@query(
    f"""WITH {s.NOTES} SELECT note_id, {s.stem("path")} AS stem, substr(sha256(path), 1, 16) AS slug, trim(path, '/') AS prefix,
'journal/episodes/' || CASE WHEN coalesce(project, '') = '' THEN '_global' ELSE project END || '/2025-01-01-cli-' || coalesce(nullif(substr(digest, 1, 8), ''), 'unknown') || '.md' AS episode,
regexp_replace(regexp_extract('git@host.invalid:' || path || '.git', '([^/:]*)$', 1), '\\.git$', '') AS repository FROM n""".replace("\\\\", "\\")
)
def path_strings(spark: SparkSession, d: str) -> DataFrame:
    from skriva.operators.sessions import episode_path
    from skriva.sources.tables import latest_notes

    path = F.col("path")
    return latest_notes(table(spark, d, "notes")).select(
        "note_id",
        text.file_stem(path).alias("stem"),
        text.digest(path, 16).alias("slug"),
        text.clean_prefix(path).alias("prefix"),
        episode_path(F.col("project"), F.lit("2025-01-01"), F.lit("cli"), F.col("digest")).alias("episode"),
        text.repository_name(F.concat(F.lit("git@host.invalid:"), path, F.lit(".git"))).alias("repository"),
    )


def _grams(x: str) -> str:
    n = s.squeeze(x)
    return f"list_distinct(list_transform(range(1, length({n}) - 3), lambda i: substr({n}, i::INTEGER, 5)))"


@query(
    f"""WITH g AS (SELECT item_id, {_grams("coalesce(question, '')")} AS a, {_grams("coalesce(passage, '')")} AS b FROM eval_items)
SELECT item_id, len(list_intersect(a, b)) AS shared, CASE WHEN least(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) ELSE 0.0 END AS containment FROM g"""
)
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "eval_items").select("item_id", text.shingles(F.col("question")).alias("a"), text.shingles(F.col("passage")).alias("b"))
    return g.select("item_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.round(scoring.containment(F.col("a"), F.col("b")), 6).alias("containment"))


_PAIRS = rf"""
WITH t AS (SELECT doc_id, {s.squeeze("text")} AS n FROM documents WHERE text IS NOT NULL),
r AS (SELECT min(doc_id) AS id, n FROM t GROUP BY n),
w AS (SELECT id, list_filter(string_split(n, ' '), lambda x: x <> '') AS ws FROM r),
g AS (SELECT DISTINCT id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
c AS (SELECT id, count(*) AS c FROM g GROUP BY id),
f AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
x AS (SELECT * FROM g WHERE g IN (SELECT g FROM f)),
m AS (SELECT a.id AS "left", b.id AS "right", count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY ALL)"""


@query(
    _PAIRS
    + """ SELECT "left", "right", round(k / (a.c + b.c - k), 6) AS similarity FROM m JOIN c a ON a.id = "left" JOIN c b ON b.id = "right" WHERE k / (a.c + b.c - k) >= 0.8"""
)
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    from skriva.operators.neardup import similar_pairs

    return similar_pairs(table(spark, d, "documents"), "doc_id", "text").withColumn("similarity", F.round("similarity", 6))


@query(
    _PAIRS.replace("WITH t AS", "WITH RECURSIVE t AS", 1)
    + """,
sim AS (SELECT "left", "right" FROM m JOIN c a ON a.id = "left" JOIN c b ON b.id = "right" WHERE k / (a.c + b.c - k) >= 0.8),
e AS (SELECT "left" AS a, "right" AS b FROM sim UNION ALL SELECT "right", "left" FROM sim),
reach AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.root = e.a),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
many AS (SELECT a AS node, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, coalesce(roots.root, r.id) AS class_id, coalesce(links, 0) AS links FROM t JOIN r USING (n) LEFT JOIN roots ON roots.node = r.id LEFT JOIN many ON many.node = r.id
UNION ALL SELECT doc_id, doc_id, 0 FROM documents WHERE text IS NULL"""
)
def near_duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    from skriva.operators.neardup import document_classes

    return document_classes(table(spark, d, "documents"), "doc_id", "text")


_DUPLICATES = f"""{s.PASSAGES}, t AS (SELECT chunk_id, path, breadcrumb, {s.squeeze('body')} AS t FROM p),
g AS (SELECT DISTINCT chunk_id, substr(t, i, 5) AS g FROM (SELECT chunk_id, t, unnest(range(1, length(t) - 3)) AS i FROM t)),
k AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id HAVING count(*) >= 10),
shared AS (SELECT a.chunk_id AS l, b.chunk_id AS r, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL),
d AS (SELECT l AS "left", r AS "right", x.path AS left_path, y.path AS right_path, x.breadcrumb AS left_heading, y.breadcrumb AS right_heading, round(c / least(m.n, o.n), 3) AS similarity
FROM shared JOIN k m ON l = m.chunk_id JOIN k o ON r = o.chunk_id JOIN t x ON l = x.chunk_id JOIN t y ON r = y.chunk_id WHERE x.path IS DISTINCT FROM y.path AND c / least(m.n, o.n) >= 0.8)"""


@query(
    f"""WITH RECURSIVE {_DUPLICATES}, e AS MATERIALIZED (SELECT "left" AS a, "right" AS b FROM d UNION ALL SELECT "right", "left" FROM d),
reach AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.root = e.a),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node), many AS (SELECT a AS node, count(*) AS links FROM e GROUP BY a)
SELECT chunk_id, coalesce(roots.root, chunk_id) AS class_id, coalesce(links, 0) AS links FROM p LEFT JOIN roots ON roots.node = chunk_id LEFT JOIN many ON many.node = chunk_id"""
)
def passage_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each passage with its class of duplicates and the number of its links; copies aren't put together in pairs."""
    from skriva.operators.neardup import passage_classes as find
    from skriva.sources.tables import passages

    return find(passages(table(spark, d, "chunks"), table(spark, d, "notes")))


@query(f"WITH {_DUPLICATES} SELECT * FROM d")
def passage_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Passages that are written down in another note too, whole or nearly."""
    from skriva.operators.neardup import passage_duplicates as find
    from skriva.sources.tables import passages

    return find(passages(table(spark, d, "chunks"), table(spark, d, "notes"))).withColumn("similarity", F.round("similarity", 3))


@query(
    """SELECT vec_id, round(e[1], 3) AS first, round(e[1] * 1000, 1) AS scaled FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"""
)
def rounding(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")[0].cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(e, 3).alias("first"), F.round(e * 1000, 1).alias("scaled"))
