"""Queries on what is asked, used and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriva.functions import scoring
from skriva.operators import links, review, snapshots, telemetry, workspace
from skriva.plans import sqlparts as s
from skriva.plans.catalog_search import _PATH_USAGE, _path_usage
from skriva.plans.registry import query
from skriva.sources import markdown
from skriva.sources.tables import latest_notes, table

NOW = s.NOW
#: After the last scan of any note.
NOTES_NOW = 1783000000.0


@query(
    f"""WITH r AS (SELECT DISTINCT id, text, ts, lower({s.strip("text")}) AS key FROM queries WHERE hits = 0 AND text IS NOT NULL)
SELECT key, arg_max(text, (ts, id)) AS text, count(*) AS n, max(ts) AS last FROM r WHERE key <> '' GROUP BY key HAVING count(*) >= 2 ORDER BY n DESC, last DESC, key LIMIT 15"""
)
def knowledge_gaps(spark: SparkSession, d: str) -> DataFrame:
    return review.knowledge_gaps(table(spark, d, "queries"))


def event_usage(spark: SparkSession, d: str) -> DataFrame:
    """A view shows a path, a click uses it, a purchase above 300 pins it."""
    kind = F.when(F.col("event_type") == "view", "shown").when(F.col("event_type") == "click", "used").when((F.col("event_type") == "purchase") & (F.col("value") > 300), "pin")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"), ts.alias("ts"), F.lit(1).alias("pinned"))
    return review.usage_of(rows.where("kind IS NOT NULL"))


@query(f"WITH {s.USAGE} SELECT path, impressions, uses, round(last_shown, 3) AS last_shown, round(last_used, 3) AS last_used, pinned FROM usage")
def usage_events(spark: SparkSession, d: str) -> DataFrame:
    return event_usage(spark, d).withColumns({c: F.round(c, 3) for c in ("last_shown", "last_used")})


@query(f"WITH {s.USAGE} SELECT path, round({s.USAGE_SCORE}, 6) AS weight FROM usage")
def usage_score(spark: SparkSession, d: str) -> DataFrame:
    weight = scoring.usage_score(F.col("uses"), F.col("last_used"), F.col("pinned"), NOW)
    return event_usage(spark, d).select("path", F.round(weight, 6).alias("weight"))


@query(f"WITH {s.USAGE} SELECT path, uses, round({s.USAGE_SCORE}, 3) AS weight FROM usage WHERE uses > 0 ORDER BY weight DESC, path LIMIT 10")
def hot_paths(spark: SparkSession, d: str) -> DataFrame:
    return review.hot_paths(event_usage(spark, d), NOW)


def _note_usage(spark: SparkSession, d: str) -> DataFrame:
    return _path_usage(spark, d)


@query(f"WITH {s.NOTES}, {_PATH_USAGE} SELECT path, impressions FROM usage WHERE uses = 0 AND pinned = 0 AND impressions >= 5 ORDER BY impressions DESC, path LIMIT 10")
def shown_unread(spark: SparkSession, d: str) -> DataFrame:
    return review.shown_unread(_note_usage(spark, d))


@query(
    f"""WITH {s.NOTES}, used AS (SELECT DISTINCT n.path FROM (SELECT DISTINCT query_id, chunk_id, matched_by FROM hits) h JOIN (SELECT DISTINCT id, ts FROM queries) q ON h.query_id = q.id
  JOIN (SELECT DISTINCT chunk_id, note_id FROM chunks) c ON h.chunk_id = c.chunk_id JOIN n ON c.note_id = n.note_id WHERE replace(lower({s.strip("h.matched_by")}), '_', '-') IN ('all-terms', 'partial') AND n.path IS NOT NULL)
SELECT path, round(({NOTES_NOW} - mtime) / 86400.0, 1) AS age FROM n WHERE mtime > 0 AND path NOT IN (SELECT path FROM used) AND ({NOTES_NOW} - mtime) / 86400.0 >= 90 ORDER BY age DESC, path LIMIT 15"""
)
def stale_notes(spark: SparkSession, d: str) -> DataFrame:
    return review.stale_notes(table(spark, d, "notes"), _note_usage(spark, d), NOTES_NOW)


@query(
    f"""WITH {s.NOTES}, e AS (SELECT path, unnest(tags) AS tag FROM n WHERE starts_with(path, 'journal/') AND NOT starts_with(path, 'journal/sessions/')),
c AS (SELECT tag, path, count(*) AS c FROM e WHERE tag IS NOT NULL AND tag <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY path) AS r FROM c)
SELECT tag, sum(c)::BIGINT AS n, string_agg(path, ',' ORDER BY path) FILTER (r <= 10) AS paths FROM k
WHERE tag NOT IN (SELECT title FROM n WHERE NOT starts_with(path, 'journal/') AND title IS NOT NULL) GROUP BY tag HAVING sum(c) >= 3"""
)
def promotion(spark: SparkSession, d: str) -> DataFrame:
    return review.promotion(table(spark, d, "notes"))


@query(f"WITH {s.NOTES} SELECT project, count(*) AS notes FROM n GROUP BY project")
def projects(spark: SparkSession, d: str) -> DataFrame:
    return review.projects(table(spark, d, "notes"))


_TABLES = ("notes", "chunks", "links", "queries", "hits", "sessions", "turns", "documents", "embeddings", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def stats(spark: SparkSession, d: str) -> DataFrame:
    return review.stats({t: table(spark, d, t) for t in _TABLES})


@query("SELECT DISTINCT src_note_id, target FROM links WHERE src_note_id IS NOT NULL AND target IS NOT NULL")
def links_out(spark: SparkSession, d: str) -> DataFrame:
    return links.links_out(table(spark, d, "links"))


_LINKS_IN = f"""WITH {s.NOTES}, names AS (SELECT note_id, title AS target FROM n WHERE title IS NOT NULL UNION SELECT note_id, {s.stem("path")} FROM n WHERE path IS NOT NULL)
SELECT DISTINCT note_id, src_note_id FROM links JOIN names USING (target) WHERE note_id <> src_note_id AND src_note_id IN (SELECT note_id FROM n)"""


@query(_LINKS_IN)
def links_in(spark: SparkSession, d: str) -> DataFrame:
    return links.links_in(table(spark, d, "links"), table(spark, d, "notes"))


@query(f"SELECT note_id, count(*) AS inbound FROM ({_LINKS_IN}) GROUP BY note_id ORDER BY inbound DESC, note_id")
def links_ordered(spark: SparkSession, d: str) -> DataFrame:
    counts = links.links_in(table(spark, d, "links"), table(spark, d, "notes")).groupBy("note_id").agg(F.count("*").alias("inbound"))
    return counts.orderBy(F.col("inbound").desc(), "note_id")


#: The two states that are compared: the notes as scanned up to this time with the ids that chunks still name, and the last scans.
AS_OF = 1755000000.0
_STATES = f"""{s.NOTES},
prev AS (SELECT note_id::VARCHAR AS path, mtime, digest FROM (SELECT * FROM notes WHERE note_id IS NOT NULL AND mtime <= {AS_OF}
           QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY mtime DESC NULLS LAST, path DESC NULLS LAST) = 1)
         UNION ALL SELECT DISTINCT note_id::VARCHAR, 0.0, 'deleted' FROM chunks WHERE note_id IS NOT NULL AND note_id NOT IN (SELECT note_id FROM notes WHERE note_id IS NOT NULL)),
cur AS (SELECT note_id::VARCHAR AS path, mtime, digest FROM n),
ch AS (SELECT path, CASE WHEN prev.path IS NULL THEN 'added' WHEN cur.path IS NULL THEN 'removed' WHEN coalesce(prev.mtime = cur.mtime, false) OR coalesce(prev.digest = cur.digest, false) THEN 'unchanged' ELSE 'updated' END AS change,
         coalesce(prev.mtime = cur.mtime, false) AS same FROM prev FULL JOIN cur USING (path))"""


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    notes, chunks = table(spark, d, "notes"), table(spark, d, "chunks")
    shape = [F.col("note_id").cast("string").alias("path"), "mtime", "digest"]
    gone = chunks.select("note_id").where("note_id IS NOT NULL").distinct().join(notes.select("note_id"), "note_id", "left_anti")
    gone = gone.select(F.col("note_id").cast("string").alias("path"), F.lit(0.0).alias("mtime"), F.lit("deleted").alias("digest"))
    return latest_notes(notes.where(F.col("mtime") <= AS_OF)).select(*shape).unionByName(gone), latest_notes(notes).select(*shape)


@query(f"WITH {_STATES} SELECT path, change, change = 'unchanged' AND NOT same AS touched FROM ch")
def change_classifier(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.classify_changes(*_states(spark, d))


@query(
    f"""WITH {_STATES} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'unchanged') AS unchanged,
count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged' AND NOT same) AS touched FROM ch"""
)
def change_report(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_report(snapshots.classify_changes(*_states(spark, d)))


@query(f"WITH {_STATES} SELECT path, mtime, digest FROM cur")
def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The old state with changed notes replaced and vanished ones removed is the new one."""
    previous, current = _states(spark, d)
    changes = snapshots.classify_changes(previous, current)
    new = current.join(changes.where("change IN ('added', 'updated') OR touched"), "path", "left_semi")
    return snapshots.replace_rows(previous, new, ["path"], changes.where("change = 'removed'").select("path"))


#: Less than the default, so that there is something to prune in every test table.
KEEP = 100


@query(f"SELECT DISTINCT * FROM queries ORDER BY ts DESC NULLS LAST, id DESC NULLS LAST LIMIT {KEEP}")
def prune_queries(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.newest_queries(table(spark, d, "queries"), KEEP)


def _offers(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "offer").when(F.col("event_type") == "click", "read")
    path = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), path.alias("path"), kind.alias("kind"), "ts", "event_id").where("kind IS NOT NULL")


_OFFERS = "o AS (SELECT user_id AS session_id, json_extract_string(props, '$.k') AS path, CASE event_type WHEN 'view' THEN 'offer' ELSE 'read' END AS kind, ts, event_id FROM events WHERE event_type IN ('view', 'click'))"


@query(
    f"""WITH {_OFFERS}, l AS (SELECT *, lag(kind) OVER (PARTITION BY session_id, path ORDER BY ts, event_id) AS before FROM o)
SELECT session_id, path, event_id FROM l WHERE kind = 'read' AND before = 'offer'"""
)
def offered_read(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.attributed_reads(_offers(spark, d)).select("session_id", "path", "event_id")


@query(
    f"""WITH {_OFFERS} SELECT session_id, path FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last DESC, path) AS r
FROM (SELECT session_id, path, max(ts) AS last FROM o WHERE kind = 'offer' GROUP BY ALL)) WHERE r <= 200"""
)
def recent_offers(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.recent_paths(_offers(spark, d)).select("session_id", "path")


_MARKS = "m AS (SELECT DISTINCT '/work/' || project AS mark, project AS name FROM notes WHERE project <> '')"


@query(
    f"""WITH {_MARKS}, f AS (SELECT DISTINCT cwd AS path FROM sessions WHERE cwd IS NOT NULL),
x AS (SELECT path, arg_max(name, (length(mark), name)) AS name, max(length(mark)) AS k FROM f JOIN m ON path = mark OR starts_with(path, mark || '/') GROUP BY path)
SELECT f.path, coalesce(x.name, CASE WHEN f.path = '/work' THEN '' ELSE list_last(string_split(f.path, '/')) END) AS project, CASE WHEN x.name IS NOT NULL THEN 'registry' ELSE 'folder' END AS origin FROM f LEFT JOIN x USING (path)"""
)
def registry_match(spark: SparkSession, d: str) -> DataFrame:
    folders = table(spark, d, "sessions").select(F.col("cwd").alias("path"))
    marks = table(spark, d, "notes").where("project <> ''").select(F.concat(F.lit("/work/"), "project").alias("mark"), F.col("project").alias("name")).distinct()
    return workspace.resolve(folders, marks.limit(0), marks, "/work")


@query(
    f"""WITH {_MARKS}, f AS (SELECT DISTINCT cwd AS path FROM sessions WHERE cwd IS NOT NULL),
k AS (SELECT 'marker' AS origin, mark, 'marked-' || name AS name FROM m WHERE length(name) % 4 = 0
      UNION ALL SELECT 'registry', mark, name FROM m WHERE length(name) % 4 <= 1 UNION ALL SELECT 'git', mark, 'git-' || name FROM m WHERE length(name) % 4 <= 2),
x AS (SELECT path, origin, arg_max(name, (length(mark), name)) AS name FROM f JOIN k ON path = mark OR starts_with(path, mark || '/') GROUP BY path, origin),
w AS (SELECT path, arg_min(name, o) AS name, arg_min(origin, o) AS origin FROM (SELECT *, CASE origin WHEN 'marker' THEN 1 WHEN 'registry' THEN 2 ELSE 3 END AS o FROM x) GROUP BY path)
SELECT f.path, coalesce(w.name, CASE WHEN f.path = '/work' THEN '' ELSE list_last(string_split(f.path, '/')) END) AS project, coalesce(w.origin, 'folder') AS origin FROM f LEFT JOIN w USING (path)"""
)
def workspace_match(spark: SparkSession, d: str) -> DataFrame:
    """All steps: project folders have a marker, are registered or are repositories, by the length of their names."""
    folders = table(spark, d, "sessions").select(F.col("cwd").alias("path"))
    marks = table(spark, d, "notes").where("project <> ''").select(F.concat(F.lit("/work/"), "project").alias("mark"), F.col("project").alias("name")).distinct()
    upto = lambda n, before: marks.where(F.length("name") % 4 <= n).select("mark", F.concat(F.lit(before), "name").alias("name"))
    return workspace.resolve(folders, upto(0, "marked-"), upto(1, ""), "/work", repositories=upto(2, "git-"))


@query(
    f"""WITH e AS (SELECT DISTINCT id, agent, make_timestamp((ts * 1000000)::BIGINT) AS t, text FROM queries WHERE ts > 0 AND text IS NOT NULL)
SELECT agent AS project, t::DATE AS day, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN text <> '' THEN 'n' || (length(text) % 5) END)), ','), '') AS tags,
string_agg('## ' || strftime(t, '%H:%M') || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY t, id) AS body FROM e GROUP BY ALL"""
)
def journal_merge(spark: SparkSession, d: str) -> DataFrame:
    """The query log as a journal: one file per agent and day, with the tags of all its entries."""
    rows = table(spark, d, "queries").where("ts > 0 AND text IS NOT NULL").select("id", "agent", "ts", "text").distinct()
    entries = rows.select(F.col("id").alias("entry_id"), F.col("agent").alias("project"), F.timestamp_micros((F.col("ts") * 1000000).cast("long")).alias("ts"), F.col("text").alias("content"), F.array(F.when(F.col("text") != "", F.concat(F.lit("n"), (F.length("text") % 5).cast("string")))).alias("tags"))
    return markdown.merge_journal(entries).select("project", "day", F.array_join("tags", ",").alias("tags"), "body")
