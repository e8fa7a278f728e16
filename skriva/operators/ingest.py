"""From a folder of notes to a state of tables, and from one state to the next.

A state has the tables notes (path, title, tags, mtime, digest, project, tier), chunks (chunk_id, path, seq, breadcrumb,
body, tokens), links (path, target) and vectors (chunk_id, embedding). A note and what is derived from it change together: all
four tables are written as one new version and the pointer is swapped once, so a reader sees the old or the new state.

The listing reads no contents. Files whose time is the stored one are left alone; of the others the digest decides. A file
that can't be read as UTF-8 is as if it hadn't changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.operators.snapshots import Store, classify_changes
from skriva.operators.vectors import encode_texts
from skriva.session import cut
from skriva.sources import markdown
from skriva.sources.state import Settings

SCHEMA_VERSION = 1
NOTES = "path string, title string, tags array<string>, mtime double, digest string, project string, tier string"
CHUNKS = "chunk_id bigint, path string, seq int, breadcrumb string, body string, tokens int"
LINKS = "path string, target string"
VECTORS = "chunk_id bigint, embedding array<float>"
SCHEMAS = {"notes": NOTES, "chunks": CHUNKS, "links": LINKS, "vectors": VECTORS}
#: So many changed files are read by name; more are read with the whole folder.
BY_NAME = 1000

Encoder = Callable[[DataFrame, str, str], DataFrame]


@dataclass
class Report:
    scanned: int = 0
    added: int = 0
    updated: int = 0
    unchanged: int = 0
    removed: int = 0


def derive(raw: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """The tables of the notes in `raw` (path, mtime, text)."""
    parsed = markdown.parse_notes(raw, list(settings.include))
    bodies = markdown.chunk_notes(parsed, "path", settings.chunk_tokens, settings.overlap)
    # Another text of the same note has other ids, so no vector of the old one can be taken for it.
    ids = F.xxhash64("path", "digest", "seq").alias("chunk_id")
    chunks = bodies.join(parsed.select("path", "digest"), "path").select(ids, "path", "seq", "breadcrumb", "body", "tokens")
    return {
        "notes": parsed.select("path", "title", "tags", "mtime", "digest", "project", "tier"),
        "chunks": chunks,
        "links": parsed.select("path", F.explode("links").alias("target")),
    }


def table_of(store: Store, name: str) -> DataFrame:
    """A table of the current state, an empty one where it has none."""
    stored = store.read(name)
    return store.spark.createDataFrame([], SCHEMAS[name]) if stored is None else stored


def with_vectors(store: Store, chunks: DataFrame, vectors: DataFrame, encoder: Encoder | None) -> DataFrame:
    """`vectors` of the chunks that are still there, and new ones for the chunks without; an encoder's failure loses none."""
    kept = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    if encoder is None:
        return kept
    bare = chunks.join(kept.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.trim(F.concat_ws("\n", "breadcrumb", "body")).alias("t"))
    try:
        made = cut(encoder(bare, "chunk_id", "t"))
    except Exception:  # noqa: BLE001 - whatever the encoder raises, notes and chunks must be kept
        return kept
    return kept.unionByName(made.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")))


def _commit(store: Store, new: dict[str, DataFrame], gone: DataFrame, encoder: Encoder | None) -> None:
    """Replace the notes in `new` and drop those in `gone` (path), with all that is derived from them."""
    tables = {}
    for name in ("notes", "chunks", "links"):
        old = table_of(store, name)
        dropped = new["notes"].select("path").unionByName(gone.select("path")).distinct()
        tables[name] = old.join(dropped, "path", "left_anti").unionByName(new[name].select(*old.columns), allowMissingColumns=True)
    tables["vectors"] = with_vectors(store, cut(tables["chunks"]), table_of(store, "vectors"), encoder)
    store.commit(tables, {"schema_version": SCHEMA_VERSION})


def reindex(store: Store, settings: Settings, force: bool = False, encoder: Encoder | None = encode_texts) -> Report:
    """Bring the state in line with the folder; `force` makes every note anew."""
    spark, root = store.spark, settings.root
    known = table_of(store, "notes").select("path", "mtime", "digest")
    rebuild = force or bool(store.current()["meta"].get("rebuild_required"))
    listed = cut(markdown.list_notes(spark, root, list(settings.include), list(settings.exclude)))
    same = known.select("path", F.col("mtime").alias("seen"))
    maybe = listed if rebuild else listed.join(same, "path", "left").where("seen IS NULL OR seen <> mtime").select("path", "mtime")
    names = [r["path"] for r in maybe.select("path").limit(BY_NAME + 1).collect()]
    if not names:
        read = spark.createDataFrame([], "path string, mtime double, text string")
    elif len(names) <= BY_NAME:
        read = markdown.read_notes(spark, root, names)
    else:
        read = markdown.scan_notes(spark, root, list(settings.include), list(settings.exclude)).join(maybe.select("path"), "path", "left_semi")
    read = cut(read.where(markdown.is_readable(F.col("text"))))
    fresh = read.select("path", "mtime", F.sha2(F.coalesce("text", F.lit("")), 256).substr(1, 32).alias("digest"))
    # Files that weren't read, or can't be, stand for what is stored of them.
    stays = listed.join(fresh.select("path"), "path", "left_anti").join(known, "path", "left_semi").select("path").join(known, "path")
    changes = cut(classify_changes(known, fresh.unionByName(stays), rebuild))
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    report = Report(listed.count(), *(counts.get(k, 0) for k in ("added", "updated", "unchanged", "removed")))
    touched = changes.where("touched").select("path")
    if report.added + report.updated + report.removed == 0:
        times = fresh.join(touched, "path", "left_semi").select("path", F.col("mtime").alias("now"))
        if touched.limit(1).count():
            notes = table_of(store, "notes")
            store.commit({"notes": notes.join(times, "path", "left").withColumn("mtime", F.coalesce("now", "mtime")).drop("now")})
    else:
        again = changes.where("change IN ('added', 'updated') OR touched").select("path")
        new = {k: cut(v) for k, v in derive(read.join(again, "path", "left_semi"), settings).items()}
        _commit(store, new, changes.where("change = 'removed'").select("path"), encoder)
    if store.current()["meta"].get("rebuild_required"):
        store.set_meta(rebuild_required=None)
    return report


def index_path(store: Store, settings: Settings, rel: str, force: bool = False, encoder: Encoder | None = encode_texts) -> Report:
    """Bring one note's part of the state in line with its file: a missing file deletes it, an unreadable one does nothing."""
    spark, root = store.spark, settings.root
    known = table_of(store, "notes").where(F.col("path") == rel).select("path", "digest").first()
    report = Report(scanned=1)
    if not markdown.is_inside(rel, list(settings.include), list(settings.exclude)):
        return Report()
    read = markdown.read_notes(spark, root, [rel]) if markdown.exists(spark, root, rel) else None
    if read is None:
        if known:
            none = {k: spark.createDataFrame([], SCHEMAS[k]) for k in ("notes", "chunks", "links")}
            _commit(store, none, spark.createDataFrame([(rel,)], "path string"), encoder)
            report.removed = 1
        return report
    read = cut(read.where(markdown.is_readable(F.col("text"))))
    parsed = read.select(F.sha2(F.coalesce("text", F.lit("")), 256).substr(1, 32).alias("digest")).first()
    if parsed is None:
        return report
    if known and known["digest"] == parsed["digest"] and not force:
        report.unchanged = 1
        return report
    new = {k: cut(v) for k, v in derive(read, settings).items()}
    _commit(store, new, spark.createDataFrame([], "path string"), encoder)
    report.updated, report.added = (1, 0) if known else (0, 1)
    return report


def passages_of(store: Store) -> DataFrame:
    """Chunks with the columns of their note, as the search operators take them."""
    notes = table_of(store, "notes").select("path", "project", "tier", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.array_join("tags", " "), F.lit("")).alias("tags"))
    chunks = table_of(store, "chunks")
    return chunks.select("chunk_id", "path", "seq", F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"), F.coalesce("body", F.lit("")).alias("body"), "tokens").join(notes, "path")
