"""Rebuilding conversations from message rows.

The rows are an event log. Per session and sequence number the events (creates, edits, deletes as blank text,
retries under a new id) fold by version into one final turn; the sessions are then validated and ordered.

No step gathers a session in one task. Folding is a hash aggregate on (session, seq). Order is checked on blocks of
`BLOCK` sequence numbers, each reduced to a string of a few symbols that joins with its neighbours', so one session may
hold any share of the rows.

Symbols of a turn: U user, A agent, O any other kind or null; user and agent turns with blank text have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skriva.functions.text import is_blank, strip_ws
from skriva.session import cut

#: Sequence numbers in a block: bounds what one group holds.
BLOCK = 4096

# Other names of the two speakers.
KIND_NAMES = {"human": "user", "assistant": "agent"}


def session_key(col: Column) -> Column:
    """Lower case without `rollout-`; null for null, '' and white space."""
    key = F.regexp_replace(F.lower(strip_ws(col)), "^rollout-", "")
    return F.when(key != "", key)


def kind_key(col: Column) -> Column:
    kind = F.lower(strip_ws(col))
    for name, to in KIND_NAMES.items():
        kind = F.when(kind == name, to).otherwise(kind)
    return kind


def fold_turns(turns: DataFrame, keep: str = "any", text: bool = False) -> DataFrame:
    """One row per (session_id, seq): turn_id and symbol of the row that stands for it, `conflict` if versions differ[, text].

    Events of one number are a create, its re-sent copies, edits (other content), deletes (blank text) and retries (the same
    under a new id). `keep='any'` is for callers that drop sessions with conflicts: the versions agree, so the least turn_id
    stands for all, and without text every buffer is of fixed width (a hash aggregate with partial sums before the
    shuffle). `keep='latest'` takes the version with the last (logged_at, turn_id); a null time is the earliest. Rows
    without a session are left out; those with a null or negative seq have no place in a conversation: they come as one row
    with seq null, which never conflicts.
    """
    kind, said, detail = kind_key(F.col("kind")), F.col("text"), F.col("detail")
    blank = is_blank(said)
    speaker = F.when(kind == "user", F.lit(2)).when(kind == "agent", F.lit(1)).otherwise(F.lit(0))
    symbol = F.when((F.coalesce(speaker, F.lit(0)) > 0) & blank, F.lit(-1)).otherwise(F.coalesce(speaker, F.lit(0)))
    content = [kind, said, detail, kind.isNull(), said.isNull(), detail.isNull()]
    placed = F.col("seq") >= 0
    events = turns.select(
        session_key(F.col("session_id")).alias("session_id"),
        F.when(placed, F.col("seq")).cast("long").alias("seq"),
        F.col("turn_id").cast("long").alias("turn_id"),
        "logged_at",
        symbol.cast("int").alias("symbol"),
        F.xxhash64(*content).alias("h"),
        *([F.when(placed & (symbol > 0), said).alias("text")] if text else []),
    ).where(F.col("session_id").isNotNull())
    groups = events.groupBy("session_id", "seq")
    conflict = (F.col("seq").isNotNull() & (F.min("h") != F.max("h"))).alias("conflict")
    if keep == "any" and not text:
        return groups.agg(F.min("turn_id").alias("turn_id"), F.max("symbol").alias("symbol"), conflict)
    # A struct with a null first field is less than any other, and null ids less than all others.
    order = F.struct("logged_at", "turn_id") if keep == "latest" else F.struct(-F.col("turn_id"))
    stands = F.max_by(F.struct("turn_id", "symbol", *(["text"] if text else [])), order).alias("_s")
    return groups.agg(stands, conflict).select("session_id", "seq", "_s.*", "conflict")


def _blocks(folded: DataFrame, speakers: bool = False) -> DataFrame:
    """Per session and block of seq: its counts and its symbols, reduced to what its neighbours must know[, and the
    numbers of its speaking turns in order]."""
    # Number and symbol of a turn as one number, so that the order is that of the numbers.
    ordered = F.array_sort(F.collect_list(F.col("seq") * 4 + F.col("symbol") + 1))
    letters = F.array(F.lit(""), F.lit("O"), F.lit("A"), F.lit("U"))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.element_at(letters, (x % 4).cast("int") + 1)), "")
    speaking = lambda xs: F.transform(F.filter(xs, lambda x: x % 4 >= 2), lambda x: F.floor(x / 4))
    blocks = folded.groupBy("session_id", F.floor(F.col("seq") / BLOCK).alias("block")).agg(
        F.count("seq").alias("n"),
        F.max("seq").alias("high"),
        F.max(F.col("seq").isNull()).alias("unnumbered"),
        F.max("conflict").alias("conflict"),
        text(ordered).alias("s"),
        *([speaking(ordered).alias("speaking")] if speakers else []),
    )
    s = F.col("s")
    ends = F.concat(F.regexp_extract(s, "^O*[UA]", 0), F.regexp_extract(s, "[UA]O*$", 0))
    short = F.regexp_replace(F.when(ends == "", s).otherwise(ends), "O+", "O")
    return blocks.select(
        "session_id",
        "block",
        "n",
        "high",
        "unnumbered",
        "conflict",
        s.contains("U").alias("has_user"),
        s.contains("A").alias("has_agent"),
        s.rlike("UO+U").alias("unanswered"),
        short.alias("s"),
        *(["speaking"] if speakers else []),
    )


def _judge(blocks: DataFrame, keep: str) -> DataFrame:
    # A block row is some ten bytes for BLOCK turns, so a session's row stays small.
    whole = blocks.groupBy("session_id").agg(
        F.sum("n").alias("n"),
        F.count("n").alias("blocks"),
        F.max("high").alias("high"),
        F.max("unnumbered").alias("unnumbered"),
        F.max("conflict").alias("conflict"),
        F.max("has_user").alias("has_user"),
        F.max("has_agent").alias("has_agent"),
        F.max("unanswered").alias("unanswered"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("block", "s")))), lambda x: x["s"]), ""
        ).alias("s"),
    )
    gap = (F.coalesce(F.col("high") + 1, F.lit(-1)) != F.col("n")) | F.col("unnumbered")
    open_end = F.col("unanswered") | F.col("s").rlike("UO+U|UO*$")
    has = F.col("blocks") > 0
    reasons = [
        (~has, "no_turns"),
        (has & F.col("conflict") & F.lit(keep == "any"), "conflict"),
        (has & gap, "gap"),
        (has & ~(F.col("has_user") & F.col("has_agent")), "one_sided"),
        (has & open_end, "unanswered"),
    ]
    return whole.select(
        "session_id", F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in reasons))).alias("reasons")
    )


def judge_sessions(turns: DataFrame, sessions: DataFrame | None = None, keep: str = "any") -> DataFrame:
    """One row per session: session_id and `reasons`, an array that is empty for a sound conversation.

    Reasons: `no_turns` (listed in `sessions` only), `conflict` (two differing rows for one seq; not with
    keep='latest'), `gap` (a number between 0 and the highest is missing, or a row has no number), `one_sided` (no user
    or no agent turn with text), `unanswered` (a user turn without an agent turn before the next user turn or the end;
    adjacent user turns count as one).
    """
    blocks = _blocks(fold_turns(turns, keep))
    if sessions is not None:
        listed = sessions.select(session_key(F.col("session_id")).alias("session_id")).where("session_id IS NOT NULL")
        blocks = blocks.unionByName(listed.distinct(), allowMissingColumns=True)
    return _judge(blocks, keep)


def dropped_sessions(turns: DataFrame, sessions: DataFrame, keep: str = "any") -> DataFrame:
    """session_id of every session that is broken, empty or unanswered."""
    return judge_sessions(turns, sessions, keep).where(F.size("reasons") > 0).select("session_id")


def conversations(turns: DataFrame, keep: str = "any") -> DataFrame:
    """The surviving sessions as ordered rows: session_id, position (from 0), role, text.

    Rows and not one array per session, so that a session of any length fits. The rows are folded once, text included,
    and kept; blocks, judgement and places are made of the narrow columns. Turns of other kinds and blank ones have no
    position. An empty table gives no rows.
    """
    folded = cut(fold_turns(turns, keep, text=True))
    blocks = cut(_blocks(folded, speakers=True))
    sound = _judge(blocks.drop("speaking"), keep).where(F.size("reasons") == 0).select("session_id")
    before = F.sum(F.size("speaking")).over(Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    places = blocks.join(sound, "session_id", "left_semi").select("session_id", "block", "speaking", F.coalesce(before, F.lit(0)).alias("offset"))
    spoken = folded.where("symbol > 0 AND seq IS NOT NULL").select("session_id", "seq", F.floor(F.col("seq") / BLOCK).alias("block"), "symbol", "text")
    return spoken.join(places, ["session_id", "block"]).select(
        "session_id",
        (F.col("offset") + F.array_position("speaking", F.col("seq")) - 1).cast("long").alias("position"),
        F.when(F.col("symbol") == 2, "user").otherwise("agent").alias("role"),
        "text",
    )
