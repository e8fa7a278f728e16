"""Queries on the state of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skriva.operators import orphans
from skriva.plans.registry import query
from skriva.sources.tables import table

#: White space in RE2's spelling, for DuckDB.
WS_SQL = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _name(x: str) -> str:
    cut = rf"regexp_extract({x}, '^([^#|]*)', 1)"
    last = rf"regexp_replace(regexp_extract({cut}, '([^/]*)$', 1), '\.md$', '')"
    return rf"lower(regexp_replace(regexp_replace({last}, '^[{WS_SQL}]+|[{WS_SQL}]+$', '', 'g'), '[{WS_SQL}]+', ' ', 'g'))"


_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.md$', '')"
_ORPHANS = rf"""
WITH l AS (SELECT *, {_name("target")} AS name FROM links WHERE src_note_id IS NOT NULL AND target IS NOT NULL),
names AS (SELECT {_name("title")} AS name FROM notes UNION SELECT {_name(_STEM)} FROM notes),
o AS (SELECT *, 'src' AS side, src_note_id::VARCHAR AS k FROM l WHERE src_note_id NOT IN (SELECT note_id FROM notes)
      UNION ALL SELECT *, 'target', name FROM l WHERE name <> '' AND name NOT IN (SELECT name FROM names WHERE name IS NOT NULL))
"""


@query(_ORPHANS + "SELECT DISTINCT src_note_id, target, side FROM o")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.link_orphans(table(spark, d, "links"), table(spark, d, "notes"))


@query(
    _ORPHANS
    + "SELECT side, strftime(seen_at, '%Y-%m') AS month, sum(1)::BIGINT AS orphan_rows, count(DISTINCT k) AS orphan_keys FROM o GROUP BY ALL"
)
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.link_orphan_report(table(spark, d, "links"), table(spark, d, "notes"))
