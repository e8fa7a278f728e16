"""Queries on agent sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriva.functions import text
from skriva.operators import sessions, telemetry
from skriva.plans import sqlparts as s
from skriva.plans.registry import query
from skriva.sources import transcripts
from skriva.sources.tables import table

NOW = 1782400000.0
_KEY = f"nullif(regexp_replace(lower({s.strip('session_id')}), '^rollout-', ''), '')"
_TURNS = f"""
raw AS (SELECT {_KEY} AS session_id, seq::BIGINT AS seq, turn_id, CASE lower({s.strip("kind")}) WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'agent' ELSE lower({s.strip("kind")}) END AS kind, text, detail, logged_at FROM turns),
t AS (SELECT * FROM raw WHERE session_id IS NOT NULL AND seq >= 0 QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY turn_id) = 1)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    return sessions.clean_turns(table(spark, d, "turns"))


@query(
    f"""WITH {_TURNS} SELECT session_id, count(*) FILTER (kind IN ('user', 'agent')) AS turns, count(*) FILTER (kind = 'user' AND {s.tokens("text")} >= 12) AS requests,
count(*) FILTER (kind IN ('user', 'agent')) >= 3 AND count(*) FILTER (kind = 'user' AND {s.tokens("text")} >= 12) > 0 AS worth FROM t GROUP BY session_id"""
)
def session_worth(spark: SparkSession, d: str) -> DataFrame:
    return sessions.worth_recording(turns(spark, d))


_ACTS = f"""acts AS (SELECT * FROM (SELECT *, {s.clip("coalesce(text, '')", 300)} AS said FROM t WHERE kind IN ('command', 'edit')) WHERE said <> ''),
kept AS (SELECT * FROM (SELECT *, lag(said) OVER (PARTITION BY session_id ORDER BY seq, turn_id) AS before FROM acts) WHERE before IS NULL OR before <> said)"""


@query(f"WITH {_TURNS}, {_ACTS} SELECT session_id, seq, kind, said FROM kept")
def collapse_commands(spark: SparkSession, d: str) -> DataFrame:
    return sessions.kept_commands(turns(spark, d)).select("session_id", "seq", "kind", "said")


_INTERESTING = r"(?im)^.*(?:error|exception|traceback|fatal|failed|failure|assertion|\bE\s{3}|\d+\s+passed|exited with code [1-9]|command not found|no such file|permission denied|cannot find|undefined|unresolved).*$"
_LINES = rf"""CASE WHEN regexp_matches(coalesce(text, ''), 'node_modules|\.venv|site-packages|dist/|build/|\.git/') THEN '' ELSE
  array_to_string(list_slice(list_filter(ls, lambda x, i: x <> '' AND list_position(ls, x) = i), 1, 12), chr(10)) END"""
_OUTPUT = f"(SELECT *, {_LINES} AS output FROM (SELECT *, list_transform(regexp_extract_all(coalesce(text, ''), '{_INTERESTING}'), lambda x: {s.strip('x')}) AS ls FROM t))"


@query(f"WITH {_TURNS} SELECT session_id, seq, output FROM {_OUTPUT} WHERE kind IN ('result', 'error')")
def interesting_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).where("kind IN ('result', 'error')")
    return rows.select("session_id", "seq", F.array_join(text.interesting_lines(F.col("text")), "\n").alias("output"))


_PARTS = f"""{_ACTS},
talk AS (SELECT session_id, seq, turn_id FROM {_OUTPUT} WHERE kind IN ('user', 'agent') OR kind = 'result' AND output <> ''),
parts AS (SELECT session_id, seq, turn_id, 'command' AS part, CASE kind WHEN 'edit' THEN 'edited ' ELSE '$ ' END || said AS said FROM kept UNION ALL SELECT session_id, seq, turn_id, 'text', '' FROM talk),
isl AS (SELECT *, sum((part = 'text')::INT) OVER (PARTITION BY session_id ORDER BY seq, turn_id) AS island FROM parts)"""


@query(
    f"""WITH {_TURNS}, {_PARTS} SELECT session_id, min(seq) AS first_seq, count(*) AS commands, '```' || chr(10) || string_agg(said, chr(10) ORDER BY seq, turn_id) || chr(10) || '```' AS said
FROM isl WHERE part = 'command' GROUP BY session_id, island"""
)
def command_blocks(spark: SparkSession, d: str) -> DataFrame:
    return sessions.command_blocks(turns(spark, d))


@query()
def episode_render(spark: SparkSession, d: str) -> DataFrame:
    return sessions.episodes(turns(spark, d))


_FIRST = f"""SELECT session_id, regexp_extract({s.strip("arg_min(text, (seq, turn_id))")}, '^[^\\n]*', 0) AS line FROM t
WHERE kind = 'user' AND coalesce(regexp_matches(text, '[^{s.WS}]'), false) GROUP BY session_id""".replace("\\\\n", "\\n")


@query(f"WITH {_TURNS}, f AS ({_FIRST}) SELECT session_id, {s.clip('line', 80)} AS title FROM f")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return sessions.titles(turns(spark, d))


@query(
    f"""WITH {_TURNS} SELECT session_id, seq, upto FROM (SELECT *, sum(coalesce(length(text), 0)) OVER (PARTITION BY session_id ORDER BY seq, turn_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM t) WHERE upto <= 20000"""
)
def transcript_cap(spark: SparkSession, d: str) -> DataFrame:
    return sessions.capped(turns(spark, d), 20000).select("session_id", "seq", "upto")


@query(f"WITH {_TURNS} SELECT session_id, seq, {s.clip('text', 300)} AS clipped FROM t")
def clip(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("session_id", "seq", text.clip(F.col("text"), 300).alias("clipped"))


@query()
def redact(spark: SparkSession, d: str) -> DataFrame:
    """Redaction by patterns needs look-around, which DuckDB lacks; it is tested on cases."""
    rows = turns(spark, d)
    return rows.select("session_id", "seq", text.redact(F.col("text")).alias("redacted"), F.coalesce(text.contains_secret(F.col("text")), F.lit(False)).alias("secret"))


@query(
    f"""WITH e AS (SELECT {_KEY} AS session_id, logged_at AS ts FROM turns WHERE logged_at IS NOT NULL),
x AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY session_id ORDER BY ts) + INTERVAL 15 MINUTE OR lag(ts) OVER (PARTITION BY session_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM e WHERE session_id IS NOT NULL),
y AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM x)
SELECT session_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM y GROUP BY session_id, visit"""
)
def session_close(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "turns").select(sessions.session_key(F.col("session_id")).alias("session_id"), F.col("logged_at").cast("timestamp").alias("ts")).where("session_id IS NOT NULL AND ts IS NOT NULL")
    return telemetry.closed_sessions(rows).select("session_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


@query(
    """SELECT user_id AS session_id, count(DISTINCT CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END) AS unanswered,
count(DISTINCT CASE WHEN event_type = 'purchase' THEN json_extract_string(props, '$.k') END) AS written, count(*) FILTER (event_type = 'signup') AS learned,
count(DISTINCT CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END) + count(DISTINCT CASE WHEN event_type = 'purchase' THEN json_extract_string(props, '$.k') END) + count(*) FILTER (event_type = 'signup') AS signals
FROM events GROUP BY user_id HAVING signals >= 2"""
)
def session_signals(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "unanswered").when(F.col("event_type") == "purchase", "written").when(F.col("event_type") == "signup", "learned")
    rows = table(spark, d, "events").select(F.col("user_id").alias("session_id"), kind.alias("kind"), F.get_json_object("props", "$.k").alias("what"))
    return sessions.session_signals(rows).where("worth").drop("worth")


@query(
    f"""WITH l AS (SELECT {_KEY} AS session_id, client, max(modified) AS modified FROM sessions WHERE {_KEY} IS NOT NULL GROUP BY ALL),
known AS (SELECT DISTINCT {_KEY} AS k FROM turns WHERE {_KEY} IS NOT NULL)
SELECT session_id, client FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY modified NULLS FIRST, session_id) AS r FROM l WHERE {NOW} - modified > 900 AND session_id NOT IN (SELECT k FROM known)) WHERE r <= 5"""
)
def import_state(spark: SparkSession, d: str) -> DataFrame:
    """The next sessions to import: complete, not imported yet, five per client. Sessions that have turns are imported."""
    known = table(spark, d, "turns").select(sessions.session_key(F.col("session_id")).alias("session_id")).where("session_id IS NOT NULL")
    return sessions.new_sessions(table(spark, d, "sessions"), known, NOW, limit=5).select("session_id", "client")


def as_lines(rows: DataFrame) -> DataFrame:
    """Turns written as transcript lines of the first format."""
    block = F.when(
        F.col("kind").isin("user", "agent"), F.to_json(F.struct(F.lit("text").alias("type"), "text"))
    ).when(F.col("kind") == "result", F.to_json(F.struct(F.lit("tool_result").alias("type"), F.col("text").alias("content")))).when(
        F.col("kind") == "command", F.to_json(F.struct(F.lit("tool_use").alias("type"), F.lit("Bash").alias("name"), F.struct(F.col("text").alias("command")).alias("input")))
    ).when(F.col("kind") == "edit", F.to_json(F.struct(F.lit("tool_use").alias("type"), F.lit("Edit").alias("name"), F.struct(F.col("text").alias("file_path")).alias("input"))))
    who = F.when(F.col("kind").isin("user", "result"), "user").otherwise("assistant")
    line = F.concat(F.lit('{"type":"'), who, F.lit('","message":{"content":['), block, F.lit("]}}"))
    return rows.select("session_id", F.col("seq").alias("line_no"), line.alias("value")).where("value IS NOT NULL")


@query(
    f"""WITH {_TURNS} SELECT session_id, seq AS line_no, kind, CASE WHEN kind IN ('user', 'agent') THEN {s.strip("text")} ELSE text END AS text FROM t
WHERE text IS NOT NULL AND (kind IN ('result', 'command') OR kind = 'edit' AND text <> '' OR kind IN ('user', 'agent') AND coalesce(regexp_matches(text, '[^{s.WS}]'), false)
  AND NOT (kind = 'user' AND (starts_with({s.strip("text")}, '<') OR starts_with({s.strip("text")}, 'Caveat:'))))"""
)
def transcript_turns(spark: SparkSession, d: str) -> DataFrame:
    """All turns, written as transcript lines and read back."""
    lines = as_lines(turns(spark, d).where("text IS NOT NULL AND (kind <> 'edit' OR text <> '')"))
    return transcripts.claude_turns(transcripts.parsed_lines(lines, None)).select("session_id", "line_no", "kind", "text")
