"""Agent transcripts in JSON lines, in two formats, as turns.

Lines are parsed as VARIANT inside the JVM, because fields change their type from line to line; what isn't JSON is
skipped. Each format is a function from lines to turns, registered by name in `FORMATS`; a new one is added there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skriva.functions.text import strip_ws
from skriva.session import cut

#: Characters of a transcript that are read.
MAX_CHARS = 32 * 1024 * 1024
#: Tools whose calls aren't recorded: those of this engine itself.
OWN_TOOLS = ("mcp__skriva__", "skriva", "memory_search")

# Which field of a tool's input says what was done.
TOOL_FIELDS = {"Bash": "command", "Edit": "file_path", "Write": "file_path", "Read": "file_path", "NotebookEdit": "notebook_path"}
EDIT_TOOLS = ("Edit", "Write", "NotebookEdit")


def read_lines(spark: SparkSession, roots: list[str]) -> DataFrame:
    """session_id, path, modified, line_no, value of all transcripts below the roots.

    A file is one row until it is split, so that its lines keep their order. `session_id` is the file name without
    `.jsonl` and `rollout-`.
    """
    raw = spark.read.text(list(roots), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    name = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", ""), "^rollout-", "")
    files = raw.select(name.alias("session_id"), F.col("_metadata.file_path").alias("path"), (F.unix_micros("_metadata.file_modification_time") / 1e6).alias("modified"), "value")
    return files.select("session_id", "path", "modified", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def parsed_lines(lines: DataFrame, limit: int | None = MAX_CHARS) -> DataFrame:
    """session_id, line_no, v: the JSON objects of each transcript, up to `limit` characters of it; None for all."""
    from skriva.operators.blocked import running_sum

    if limit is not None:
        lines = running_sum(lines, ["session_id"], ["line_no"], F.length("value") + 1, "upto").where(F.col("upto") <= limit)
    parsed = lines.where(F.trim("value") != "").select("session_id", "line_no", F.try_parse_json("value").alias("v"))
    return parsed.where("v IS NOT NULL")


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _own(name: Column) -> Column:
    own = F.lit(False)
    for p in OWN_TOOLS:
        own = own | name.startswith(p) | name.contains("memory_search")
    return own


def claude_turns(parsed: DataFrame) -> DataFrame:
    """Turns of transcripts that hold messages of content blocks; sidechains, reasoning and injected text are left out."""
    top = parsed.select("session_id", "line_no", "v", _get("v", "$.type").alias("who"), F.coalesce(_get("v", "$.isSidechain", "boolean"), F.lit(False)).alias("side"))
    top = top.where("who IN ('user', 'assistant')").where(~F.col("side"))
    content = _get("v", "$.message.content", "variant")
    blocks = F.coalesce(_get("v", "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    whole = top.where(F.schema_of_variant(content) == "STRING").select("session_id", "line_no", F.lit(0).alias("part"), "who", F.lit("text").alias("type"), _get("v", "$.message.content").alias("said"), F.lit(None).cast("variant").alias("b"))
    many = top.where(F.schema_of_variant(content).startswith("ARRAY")).select("session_id", "line_no", "who", F.posexplode(blocks).alias("part", "b"))
    many = many.select("session_id", "line_no", "part", "who", _get("b", "$.type").alias("type"), _get("b", "$.text").alias("said"), "b")
    each = whole.unionByName(many).withColumn("said", strip_ws(F.col("said")))
    tool = _get("b", "$.name")
    did = F.lit(None).cast("string")
    for name, field in TOOL_FIELDS.items():
        did = F.when(tool == name, _get("b", f"$.input.{field}")).otherwise(did)
    did = F.coalesce(did, F.lit(""))
    is_edit = tool.isin(*EDIT_TOOLS)
    item_text = F.transform(
        F.coalesce(_get("b", "$.content", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: F.coalesce(F.when(F.try_variant_get(x, "$.type", "string") == "text", F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))),
    )
    result = F.when(F.schema_of_variant(_get("b", "$.content", "variant")) == "STRING", _get("b", "$.content")).otherwise(F.array_join(F.array_compact(item_text), "\n"))
    injected = F.col("said").startswith("<") | F.col("said").startswith("Caveat:")
    kind = (
        F.when((F.col("who") == "user") & (F.col("type") == "text") & (F.col("said") != "") & ~injected, "user")
        .when((F.col("who") == "user") & (F.col("type") == "tool_result"), "result")
        .when((F.col("who") == "assistant") & (F.col("type") == "text") & (F.col("said") != ""), "agent")
        .when((F.col("who") == "assistant") & (F.col("type") == "tool_use") & ~_own(F.coalesce(tool, F.lit(""))), F.when(is_edit, "edit").when((tool == "Bash") | (did != ""), "command"))
    )
    text = (
        F.when(F.col("kind") == "result", F.coalesce(result, F.lit("")))
        .when(F.col("kind") == "edit", F.when(did == "", tool).otherwise(did))
        .when(F.col("kind") == "command", F.when(tool == "Bash", did).otherwise(F.concat(tool, F.lit(": "), did)))
        .otherwise(F.col("said"))
    )
    return each.withColumn("kind", kind).where("kind IS NOT NULL").select("session_id", "line_no", "part", "kind", text.alias("text"), F.when(F.col("kind").isin("edit", "command"), tool).otherwise("").alias("detail"))


def codex_turns(parsed: DataFrame) -> DataFrame:
    """Turns of transcripts that hold events with a payload; arguments come as a string of JSON or as an object."""
    p = parsed.select("session_id", "line_no", "v", _get("v", "$.payload.type").alias("type"))
    said = strip_ws(F.coalesce(F.when(F.col("type") == "task_complete", _get("v", "$.payload.last_agent_message")).otherwise(_get("v", "$.payload.message")), F.lit("")))
    name = F.coalesce(_get("v", "$.payload.name"), F.lit(""))
    raw = _get("v", "$.payload.arguments", "variant")
    arguments = F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(_get("v", "$.payload.arguments"))).otherwise(raw)
    q = p.select("session_id", "line_no", "v", "type", said.alias("said"), name.alias("name"), arguments.alias("a"))
    one = lambda path: F.coalesce(F.when(F.schema_of_variant(_get("a", path, "variant")).startswith("ARRAY"), F.array_join(_get("a", path, "array<string>"), " ")), _get("a", path))
    some = lambda c: F.when(c != "", c)
    command = F.coalesce(some(one("$.cmd")), some(one("$.command")))
    file = F.coalesce(some(_get("a", "$.path")), some(_get("a", "$.file_path")))
    call = (F.col("type") == "function_call") & ~_own(F.col("name"))
    kind = (
        F.when((F.col("type") == "user_message") & (F.col("said") != "") & ~F.col("said").startswith("<"), "user")
        .when(F.col("type").isin("agent_message", "task_complete") & (F.col("said") != ""), "agent")
        .when(F.col("type") == "function_call_output", "result")
        .when(call & command.isNotNull(), "command")
        .when(call & file.isNotNull(), "edit")
        .when(call & (F.col("name") != ""), "command")
    )
    text = (
        F.when(F.col("type") == "function_call", F.coalesce(command, file, F.col("name")))
        .when(F.col("type") == "function_call_output", F.coalesce(_get("v", "$.payload.output"), F.lit("")))
        .otherwise(F.col("said"))
    )
    return q.select("session_id", "line_no", F.lit(0).alias("part"), kind.alias("kind"), text.alias("text"), F.when(F.col("type") == "function_call", F.col("name")).otherwise("").alias("detail")).where("kind IS NOT NULL")


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"claude": claude_turns, "codex": codex_turns}


def folders_of(parsed: DataFrame) -> DataFrame:
    """session_id, cwd: the first folder that a transcript names, in either format."""
    named = parsed.select("session_id", "line_no", F.coalesce(F.nullif(_get("v", "$.cwd"), F.lit("")), F.nullif(_get("v", "$.payload.cwd"), F.lit(""))).alias("cwd"))
    return named.where("cwd IS NOT NULL").groupBy("session_id").agg(F.min_by("cwd", "line_no").alias("cwd"))


def numbered(turns: DataFrame, client: str) -> DataFrame:
    """client, session_id, seq, kind, text, detail: turns in the order of their lines and parts, counted in blocks."""
    from skriva.operators.blocked import running_sum

    counted = running_sum(turns, ["session_id"], ["line_no", "part"], F.lit(1), "nth")
    return counted.select(F.lit(client).alias("client"), "session_id", (F.col("nth") - 1).cast("int").alias("seq"), "kind", "text", "detail")


def available(spark: SparkSession, roots: dict[str, list[str]]) -> dict[str, list[str]]:
    """Of each known format the folders that exist; formats without any are left out."""
    from skriva.sources.markdown import exists

    there = {client: [f for f in folders if exists(spark, f, "")] for client, folders in roots.items() if client in FORMATS}
    return {client: folders for client, folders in there.items() if folders}


def discover(spark: SparkSession, folders: list[str]) -> DataFrame:
    """session_id, modified of all transcripts below the folders; no file is opened. Of files with one name the last counts."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(list(folders))
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", ""), "^rollout-", "")
    files = raw.select(F.lower(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).alias("session_id"), (F.unix_micros("modificationTime") / 1e6).alias("modified"))
    return files.groupBy("session_id").agg(F.max("modified").alias("modified"))


def import_sessions(spark: SparkSession, client: str, folders: list[str], fresh: DataFrame, limit: int | None = None) -> DataFrame:
    """session_id, modified, readable, worth, cwd, title, body of the `fresh` sessions (session_id, modified), oldest first up
    to the one that makes `limit` episodes. A file none of whose lines is JSON isn't readable."""
    from skriva.operators import sessions

    lines = read_lines(spark, folders).withColumn("session_id", F.lower("session_id")).join(fresh.select("session_id"), "session_id", "left_semi")
    lines = lines.select("session_id", "line_no", "value")
    parsed = cut(parsed_lines(lines))
    said = lines.where(F.trim("value") != "").select("session_id").distinct().join(parsed.select("session_id").distinct(), "session_id", "left_anti")
    turns = cut(numbered(FORMATS[client](parsed), client).withColumn("seq", F.col("seq").cast("long")).withColumn("turn_id", F.col("seq")))
    judged = sessions.worth_recording(turns).select("session_id", "worth")
    out = (
        fresh.select("session_id", "modified")
        .join(judged, "session_id", "left")
        .join(said.withColumn("bad", F.lit(True)), "session_id", "left")
        .select("session_id", "modified", F.col("bad").isNull().alias("readable"), F.coalesce("worth", F.lit(False)).alias("worth"))
    )
    out = cut(out)
    if limit is not None:
        last = out.where("worth").orderBy("modified", "session_id").limit(limit).collect()
        if len(last) == limit:
            end = F.struct(F.lit(last[-1]["modified"]).alias("modified"), F.lit(last[-1]["session_id"]).alias("session_id")) if last else None
            out = out.where(F.struct("modified", "session_id") <= end) if last else out.limit(0)
    texts = sessions.episodes(turns.join(out.where("worth").select("session_id"), "session_id", "left_semi"))
    return out.join(folders_of(parsed), "session_id", "left").join(texts, "session_id", "left")
