"""Agent sessions: what of them is worth keeping, and their rendering.

Orders within a session are computed in blocks (`operators.blocked`), so a session may hold any share of the rows. Only
the rendering of an episode gathers a session's text; it gathers what is left after clipping, and at most
`MAX_EPISODE_CHARS` of it and of each run of commands. `command_blocks` without a limit gives whole runs, each a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skriva.functions.text import clip, collapse_blank_lines, estimate_tokens, interesting_lines, is_blank, redact, strip_ws
from skriva.operators.blocked import previous_value, running_sum
from skriva.session import cut

USER_CHARS, AGENT_CHARS, COMMAND_CHARS, ERROR_CHARS = 1500, 1200, 300, 800
MAX_EPISODE_CHARS = 16000
MIN_TURNS, MIN_REQUEST_TOKENS = 3, 12
MIN_SIGNALS = 2
#: Seconds without a change after which a session is over.
QUIET = 900.0


def session_key(col: Column) -> Column:
    key = F.regexp_replace(F.lower(strip_ws(col)), "^rollout-", "")
    return F.when(key != "", key)


def kind_key(col: Column) -> Column:
    kind = F.lower(strip_ws(col))
    return F.when(kind == "human", "user").when(kind == "assistant", "agent").otherwise(kind)


def clean_turns(turns: DataFrame) -> DataFrame:
    """session_id, seq, turn_id, kind, text, detail, logged_at: one row per session and seq, the first sent.

    Rows without a session or number have no place and are left out.
    """
    rows = turns.select(
        session_key(F.col("session_id")).alias("session_id"), F.col("seq").cast("long").alias("seq"), "turn_id", kind_key(F.col("kind")).alias("kind"), "text", "detail", "logged_at"
    ).where("session_id IS NOT NULL AND seq >= 0 AND turn_id IS NOT NULL")
    # One shuffle: what a re-sent row adds is dropped within each task before it.
    first = F.min_by(F.struct("turn_id", "kind", "text", "detail", "logged_at"), "turn_id").alias("f")
    return rows.groupBy("session_id", "seq").agg(first).select("session_id", "seq", "f.*")


def worth_recording(turns: DataFrame) -> DataFrame:
    """session_id, turns (user and agent), requests (long enough), worth: one row per session."""
    speaks = F.coalesce(F.col("kind").isin("user", "agent"), F.lit(False))
    request = (F.col("kind") == "user") & (estimate_tokens(F.col("text")) >= MIN_REQUEST_TOKENS)
    counts = turns.groupBy("session_id").agg(F.count_if(speaks).alias("turns"), F.count_if(request).alias("requests"))
    return counts.withColumn("worth", (F.col("turns") >= MIN_TURNS) & (F.col("requests") > 0))


def kept_commands(turns: DataFrame) -> DataFrame:
    """The command and edit turns without those that repeat the one before them, other turns aside; `said` is clipped."""
    acts = turns.where(F.col("kind").isin("command", "edit")).select("session_id", "seq", "turn_id", "kind", "text").withColumn("said", clip(F.coalesce("text", F.lit("")), COMMAND_CHARS)).where("said <> ''")
    seen = previous_value(acts, ["session_id"], ["seq", "turn_id"], F.col("said"), "before")
    return seen.where("before IS NULL OR before <> said").drop("before")


def rendered_turns(turns: DataFrame) -> DataFrame:
    """session_id, seq, part ('text' or 'command'), said: what of each turn goes into an episode, before joining."""
    acts = kept_commands(turns).select(
        "session_id", "seq", "turn_id", F.lit("command").alias("part"), F.concat(F.when(F.col("kind") == "edit", "edited ").otherwise("$ "), "said").alias("said")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    output = F.array_join(interesting_lines(text), "\n")
    said = (
        F.when(F.col("kind") == "user", F.concat(F.lit("**User:** "), clip(text, USER_CHARS)))
        .when(F.col("kind") == "agent", clip(text, AGENT_CHARS))
        .when((F.col("kind") == "result") & (output != ""), F.concat(F.lit("```\n"), clip(output, ERROR_CHARS), F.lit("\n```")))
    )
    talk = turns.where(F.col("kind").isin("user", "agent", "result")).select("session_id", "seq", "turn_id", F.lit("text").alias("part"), said.alias("said")).where("said IS NOT NULL")
    return acts.unionByName(talk)


def command_blocks(turns: DataFrame, limit: int | None = None) -> DataFrame:
    """session_id, first_seq, commands, said: runs of kept commands that no text comes between, as one fenced block each.

    A block's number is the count of texts before it, a running sum over blocks of the session. With `limit`, only so many
    characters of a run are gathered, rounded up to a command, and `commands` counts these.
    """
    return _blocks_of(cut(rendered_turns(cut(turns))), limit)


def _blocks_of(parts: DataFrame, limit: int | None) -> DataFrame:
    numbered = running_sum(parts, ["session_id"], ["seq", "turn_id"], F.when(F.col("part") == "text", 1).otherwise(0), "island").where("part = 'command'")
    if limit is not None:
        size = F.length("said") + 1
        numbered = running_sum(cut(numbered), ["session_id", "island"], ["seq", "turn_id"], size, "upto").where(F.col("upto") - size <= limit)
    runs = numbered.groupBy("session_id", "island").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("commands"), F.array_sort(F.collect_list(F.struct("seq", "turn_id", "said"))).alias("lines")
    )
    lines = F.array_join(F.transform("lines", lambda x: x["said"]), "\n")
    return runs.select("session_id", "first_seq", "commands", F.concat(F.lit("```\n"), lines, F.lit("\n```")).alias("said"))


def episodes(turns: DataFrame, limit: int = MAX_EPISODE_CHARS) -> DataFrame:
    """session_id, title, body: each session reduced to what one would have noted, redacted, of bounded length.

    A session is gathered only as far as its episode goes: of each run of commands the first `limit` characters, and
    parts that begin beyond the limit are left out before.
    """
    turns = cut(turns)
    rendered = cut(rendered_turns(turns))
    blocks = _blocks_of(rendered, limit).select("session_id", F.col("first_seq").alias("seq"), "said")
    talk = rendered.where("part = 'text'").select("session_id", "seq", "said")
    parts = running_sum(cut(blocks.unionByName(talk)), ["session_id"], ["seq"], F.length("said") + 2, "upto")
    near = parts.where(F.col("upto") - F.length("said") - 2 <= limit + 2)
    gathered = near.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "said"))).alias("p"))
    body = collapse_blank_lines(strip_ws(F.array_join(F.transform("p", lambda x: x["said"]), "\n\n")))
    short = F.concat(F.regexp_replace(F.substring(body, 1, limit), r"\s+$", ""), F.lit("\n\n[… session continues]"))
    bodies = gathered.select("session_id", redact(F.when(F.length(body) > limit, short).otherwise(body)).alias("body"))
    return bodies.join(titles(turns), "session_id", "left").select("session_id", "title", "body")


def titles(turns: DataFrame) -> DataFrame:
    """session_id, title: the first line of the first user turn that says something."""
    first = turns.where(F.col("kind") == "user").where(~is_blank(F.col("text"))).groupBy("session_id").agg(F.min_by("text", F.struct("seq", "turn_id")).alias("t"))
    return first.select("session_id", clip(F.element_at(F.split(strip_ws(F.col("t")), "\n"), 1), 80).alias("title"))


def episode_path(project: Column, day: Column, client: Column, session_id: Column) -> Column:
    folder = F.when(F.coalesce(project, F.lit("")) == "", "_global").otherwise(project)
    short = F.substring(F.replace(session_id, F.lit("-"), F.lit("")), 1, 8)
    short = F.when(short == "", "unknown").otherwise(short)
    return F.concat(F.lit("journal/episodes/"), folder, F.lit("/"), day, F.lit("-"), client, F.lit("-"), short, F.lit(".md"))


def episode_file(project: str, day: str, client: str, session_id: str) -> str:
    """`episode_path` for one session on the driver."""
    return f"journal/episodes/{project or '_global'}/{day}-{client}-{session_id.replace('-', '')[:8] or 'unknown'}.md"


def capped(turns: DataFrame, limit: int) -> DataFrame:
    """The turns of each session up to the one that would make its text longer than `limit` characters."""
    summed = running_sum(turns, ["session_id"], ["seq", "turn_id"], F.coalesce(F.length("text"), F.lit(0)), "upto")
    return summed.where(F.col("upto") <= limit)


def new_sessions(sessions: DataFrame, known: DataFrame, now: float, quiet: float = QUIET, limit: int | None = None) -> DataFrame:
    """Sessions that are complete (quiet for longer than `quiet` seconds) and not known, oldest first, `limit` per client."""
    rows = sessions.select(session_key(F.col("session_id")).alias("session_id"), "client", "modified").where("session_id IS NOT NULL")
    last = rows.groupBy("session_id", "client").agg(F.max("modified").alias("modified"))
    fresh = last.where(F.lit(now) - F.col("modified") > quiet).join(known.select("session_id").distinct(), "session_id", "left_anti")
    if limit is None:
        return fresh
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("client").orderBy("modified", "session_id"))
    return fresh.withColumn("r", nth).where(F.col("r") <= limit).drop("r")


def session_signals(events: DataFrame) -> DataFrame:
    """session_id, unanswered, written, learned, signals, worth from events (session_id, kind, what)."""
    one = lambda kind: F.when(F.col("kind") == kind, F.col("what"))
    counts = events.groupBy("session_id").agg(
        F.count_distinct(one("unanswered")).alias("unanswered"), F.count_distinct(one("written")).alias("written"), F.count_if(F.col("kind") == "learned").alias("learned")
    )
    signals = F.col("unanswered") + F.col("written") + F.col("learned")
    return counts.withColumn("signals", signals).withColumn("worth", F.col("signals") >= MIN_SIGNALS)
