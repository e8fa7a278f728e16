"""What changed between two states of the notes, and replacing a state as a whole.

A state is a folder of Parquet tables; a pointer file names the current one and is replaced by a rename, so readers see
the old or the new state and never a mixture. There is one writer.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def classify_changes(previous: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """path, change, touched: 'added', 'updated', 'unchanged' or 'removed' for each path of either side.

    Both have path, mtime, digest. An equal mtime or digest means unchanged; with equal digests and another mtime the
    note is `touched`: only its time is stored anew. With `force`, every present note is updated.
    """
    p = previous.select("path", F.col("mtime").alias("pm"), F.col("digest").alias("pd"), F.lit(1).alias("in_p"))
    c = current.select("path", F.col("mtime").alias("cm"), F.col("digest").alias("cd"), F.lit(1).alias("in_c"))
    same_time, same_text = F.col("pm") == F.col("cm"), F.col("pd") == F.col("cd")
    same = F.coalesce(same_time, F.lit(False)) | F.coalesce(same_text, F.lit(False))
    change = (
        F.when(F.col("in_p").isNull(), "added")
        .when(F.col("in_c").isNull(), "removed")
        .when(~same | F.lit(force), "updated")
        .otherwise("unchanged")
    )
    touched = (change == "unchanged") & ~F.coalesce(same_time, F.lit(False))
    return p.join(c, "path", "full_outer").select("path", change.alias("change"), touched.alias("touched"))


def change_report(changes: DataFrame) -> DataFrame:
    """One row: how many paths were added, updated, unchanged, removed, touched."""
    kinds = ("added", "updated", "unchanged", "removed")
    return changes.agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds), F.count_if("touched").alias("touched"))


def replace_rows(table: DataFrame, new: DataFrame, keys: list[str], removed: DataFrame | None = None) -> DataFrame:
    """`table` without the rows whose keys are in `new` or `removed`, and with `new`. Columns may differ."""
    gone = new.select(*keys).distinct()
    if removed is not None:
        gone = gone.unionByName(removed.select(*keys)).distinct()
    return table.join(gone, keys, "left_anti").unionByName(new, allowMissingColumns=True)


class Store:
    """Versioned tables under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @property
    def _pointer(self) -> str:
        return os.path.join(self.root, "CURRENT.json")

    def current(self) -> dict:
        try:
            with open(self._pointer, encoding="utf-8") as f:
                state = json.load(f)
            return state if isinstance(state, dict) and "tables" in state else {"tables": {}, "meta": {}}
        except (OSError, ValueError):
            return {"tables": {}, "meta": {}}

    def read(self, name: str) -> DataFrame | None:
        """A table of the current state, columns added in later versions included, or None."""
        path = self.current()["tables"].get(name)
        return self.spark.read.option("mergeSchema", "true").parquet(path) if path else None

    def commit(self, tables: dict[str, DataFrame], meta: dict | None = None) -> str:
        """Write the given tables as a new version; the others stay as they are. Returns the version."""
        version = f"v{time.time_ns()}"
        state = self.current()
        for name, df in tables.items():
            path = os.path.join(self.root, version, name)
            df.write.mode("error").parquet(path)
            state["tables"][name] = path
        state["meta"] = {**state.get("meta", {}), **(meta or {})}
        self._swap(state)
        return version

    def set_meta(self, **values: object) -> None:
        state = self.current()
        state["meta"] = {k: v for k, v in {**state.get("meta", {}), **values}.items() if v is not None}
        self._swap(state)

    def migrate(self, version: int, derived: list[str]) -> bool:
        """Where the stored schema version differs, forget the derived tables, keep what was learned, ask for a rebuild."""
        state = self.current()
        if state.get("meta", {}).get("schema_version") == version:
            return False
        state["tables"] = {k: v for k, v in state["tables"].items() if k not in derived}
        state["meta"] = {**state.get("meta", {}), "schema_version": version, "rebuild_required": True}
        self._swap(state)
        return True

    def update(self, name: str, change: Callable[[DataFrame | None], DataFrame]) -> str:
        return self.commit({name: change(self.read(name))})

    def _swap(self, state: dict) -> None:
        os.makedirs(self.root, exist_ok=True)
        temporary = f"{self._pointer}.{os.getpid()}"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(state, f, ensure_ascii=False, indent=1)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, self._pointer)
