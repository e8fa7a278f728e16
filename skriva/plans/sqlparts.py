"""Parts of the SQL that the core's queries are compared with, in DuckDB's spelling."""

from __future__ import annotations

#: White space as Unicode has it.
WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{ac00}-\x{d7af}"
SEARCH_CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '[{WS}]+', ' ', 'g')))"


def tokens(x: str) -> str:
    cjk = rf"length(regexp_replace({x}, '[^{CJK}]', '', 'g'))"
    return f"(CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE greatest(1, {cjk} + (length({x}) - {cjk} + 3) // 4) END)::INTEGER"


def query_terms(x: str) -> str:
    cleaned = strip(rf"""regexp_replace(coalesce({x}, ''), '["*(){{}}:^-]', ' ', 'g')""")
    return rf"list_filter(string_split_regex({cleaned}, '[{WS}]+'), lambda t: t <> '')"


def stem(x: str) -> str:
    return rf"regexp_replace(regexp_extract({x}, '([^/]*)$', 1), '\.md$', '')"


def clip(x: str, limit: int) -> str:
    t = strip(x)
    return rf"CASE WHEN length({t}) <= {limit} THEN {t} ELSE regexp_replace(substr({t}, 1, {limit}), '[{WS}]+$', '') || chr(10) || '[… ' || (length({t}) - {limit})::VARCHAR || ' more characters]' END"


NOTES = """
n AS (SELECT * FROM notes WHERE note_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY mtime DESC NULLS LAST, path DESC NULLS LAST) = 1)"""

PASSAGES = (
    NOTES
    + """,
p AS (SELECT chunk_id, note_id, seq, coalesce(breadcrumb, '') AS breadcrumb, coalesce(body, '') AS body, tokens, path, project, tier,
             coalesce(title, '') AS title, coalesce(array_to_string(list_filter(tags, lambda x: x IS NOT NULL), ' '), '') AS tags
      FROM (SELECT DISTINCT * FROM chunks WHERE chunk_id IS NOT NULL) c JOIN n USING (note_id))"""
)

#: The stated query set of every search: the rows of the log whose id is divisible by 50, against all passages.
ASKED = "q AS (SELECT DISTINCT id AS query_id, text FROM queries WHERE id % 50 = 0)"

_LOW = "low AS (SELECT *, lower(title) AS lt, lower(tags) AS lg, lower(breadcrumb) AS lb, lower(body) AS ly FROM p)"


def _count(column: str) -> str:
    return f"(length({column}) - length(replace({column}, term, ''))) / length(term)"


_LENGTH = "greatest(0, length(lt) - 2) + greatest(0, length(lg) - 2) + greatest(0, length(lb) - 2) + greatest(0, length(ly) - 2)"

#: Parts of the BM25 score per passage and term, and the passages' scores per query.
BM25 = f"""
{PASSAGES},
{ASKED},
{_LOW},
qt AS (SELECT query_id, list_distinct(list_transform(list_filter({query_terms("text")}, lambda t: length(t) >= 3), lambda t: lower(t))) AS ts FROM q),
asked AS (SELECT query_id, len(ts) AS n, unnest(ts) AS term FROM qt),
pieces AS (SELECT query_id, ts, list_distinct(flatten(list_transform(ts, lambda t: CASE WHEN length(t) >= 5 AND regexp_matches(t, '[{SEARCH_CJK}]')
             THEN list_concat([t], list_transform(range(0, length(t) - 3, 2), lambda i: substr(t, (i + 1)::INTEGER, 4)), [substr(t, length(t) - 3, 4)]) ELSE [t] END))) AS w FROM qt),
windows AS (SELECT query_id, len(w) AS n, unnest(w) AS term FROM pieces WHERE len(w) > len(ts)),
terms AS (SELECT term FROM asked UNION SELECT term FROM windows),
matches AS (SELECT chunk_id, term, 4 * {_count("lt")} + 3 * {_count("lg")} + 2 * {_count("lb")} + {_count("ly")} AS f, {_LENGTH} AS d
            FROM low JOIN terms ON contains(lt, term) OR contains(lg, term) OR contains(lb, term) OR contains(ly, term)),
corpus AS (SELECT count(*) AS nd, avg({_LENGTH}) AS md FROM low),
idf AS (SELECT term, CASE WHEN ln((nd - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((nd - count(*) + 0.5) / (count(*) + 0.5)) END AS w
        FROM matches, corpus GROUP BY term, nd),
parts AS (SELECT chunk_id, term, -w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / md)) AS part FROM matches JOIN idf USING (term), corpus),
scores AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score, count(*) AS found, any_value(n) AS n FROM parts JOIN asked USING (term) GROUP BY ALL),
wscores AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM parts JOIN windows USING (term) GROUP BY ALL)"""


def top(rows: str, label: str, depth: int, order: str = "score") -> str:
    return f"""SELECT query_id, '{label}' AS label, rank, chunk_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, chunk_id) AS rank FROM ({rows})) WHERE rank <= {depth}"""


def keyword_rankings(depth: int, visible: str = "true") -> str:
    seen = f"chunk_id IN (SELECT chunk_id FROM p WHERE {visible})"
    return (
        top(f"SELECT * FROM scores WHERE found = n AND n > 1 AND {seen}", "all-terms", depth)
        + " UNION ALL "
        + top(f"SELECT * FROM scores WHERE {seen}", "keyword", depth)
        + " UNION ALL "
        + top(f"SELECT * FROM wscores WHERE {seen} AND query_id NOT IN (SELECT query_id FROM scores WHERE found = n AND {seen})", "partial", depth)
    )


def substring_ranking(depth: int, visible: str = "true") -> str:
    rows = f"""SELECT query_id, chunk_id, tokens, sum(contains(ly, term)::INT + 2 * contains(lb, term)::INT + 3 * contains(lt, term)::INT)::DOUBLE AS score
      FROM (SELECT * FROM low WHERE {visible}) JOIN (SELECT DISTINCT query_id, lower(unnest(list_filter({query_terms("text")}, lambda t: length(t) < 3))) AS term FROM q)
        ON contains(ly, term) OR contains(lb, term) OR contains(lt, term) GROUP BY ALL"""
    return top(rows, "substring", depth, "score DESC, coalesce(tokens, 0)")


#: Reciprocal rank fusion of `rankings`, and the passages' position by tier and usage.
FUSED = """
fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS fused, string_agg(DISTINCT label, '+' ORDER BY label) AS matched_by,
                 min(CASE label WHEN 'all-terms' THEN 0 WHEN 'keyword' THEN 1 WHEN 'partial' THEN 2 WHEN 'substring' THEN 3 ELSE 4 END * 1000000 + rank) AS first
          FROM rankings GROUP BY ALL),
tiered AS (SELECT *, round(fused * CASE tier WHEN 'durable' THEN 1.0 WHEN 'journal' THEN 0.9 WHEN 'episode' THEN 0.65 ELSE 1.0 END, 9) AS tiered
           FROM fused JOIN (SELECT chunk_id, path, tier, tokens, body FROM p) USING (chunk_id))"""

#: Usage from the events table: a view shows a path, a click uses it, a purchase above 300 pins it.
USAGE = """
ue AS (SELECT 'u' || user_id::VARCHAR AS path, CASE WHEN event_type = 'view' THEN 'shown' WHEN event_type = 'click' THEN 'used' WHEN event_type = 'purchase' AND value > 300 THEN 'pin' END AS kind,
              epoch_us(ts) / 1e6 AS ts FROM events),
usage AS (SELECT path, count(*) FILTER (kind = 'shown') AS impressions, count(*) FILTER (kind = 'used') AS uses,
                 coalesce(max(ts) FILTER (kind = 'shown'), 0.0) AS last_shown, coalesce(max(ts) FILTER (kind = 'used'), 0.0) AS last_used,
                 max((kind = 'pin')::INT)::BIGINT AS pinned FROM ue WHERE kind IS NOT NULL AND path IS NOT NULL GROUP BY path)"""
NOW = 1706745600.0
USAGE_SCORE = f"""CASE WHEN coalesce(pinned, 0) <> 0 THEN 1.0
  WHEN coalesce(uses, 0) > 0 AND coalesce(last_used, 0) > 0 THEN least(1.0, ln(1 + uses) / ln(21)) * pow(0.5, greatest(0.0, ({NOW} - last_used) / 86400.0) / 30.0) ELSE 0.0 END"""
