"""Which project a folder belongs to.

Folders meet registered paths and markers through their ancestors: each folder is one row per ancestor, an equi-join, and
the deepest match wins. So nothing is compared by prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """The path and every folder above it, without the root, `/a/b` -> `/a`, `/a/b`."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    many = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(F.size(parts) > 0, many).otherwise(F.array().cast("array<string>"))


def deepest(folders: DataFrame, marks: DataFrame, path: str = "path", mark: str = "mark", name: str = "name") -> DataFrame:
    """path, name, mark: the deepest mark that is the folder or above it; `folders` has path, `marks` has mark and name."""
    up = folders.select(path).where(F.col(path).isNotNull()).distinct().select(path, F.explode(ancestors(F.col(path))).alias(mark))
    normal = marks.select(F.regexp_replace(mark, "(?<=.)/+$", "").alias(mark), name).where(F.col(mark).isNotNull())
    found = up.join(normal, mark)
    best = found.groupBy(path).agg(F.max_by(F.struct(name, mark), F.struct(F.length(mark), F.col(name))).alias("b"))
    return best.select(path, f"b.{name}", f"b.{mark}")


def resolve(folders: DataFrame, markers: DataFrame, registry: DataFrame, home: str, forced: str | None = None, repositories: DataFrame | None = None) -> DataFrame:
    """path, project, origin: a forced name, else a marker above, else the registry, else the
    git repository (root as mark, and name), else the folder's own name; home is ''."""
    own = folders.select("path").where("path IS NOT NULL").distinct()
    if forced:
        return own.select("path", F.lit(forced).alias("project"), F.lit("environment").alias("origin"))
    m = deepest(own, markers).select("path", F.col("name").alias("m"))
    r = deepest(own, registry).select("path", F.col("name").alias("r"))
    g = own.select("path", F.lit(None).cast("string").alias("g")) if repositories is None else deepest(own, repositories).select("path", F.col("name").alias("g"))
    last = F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1)
    project = F.coalesce("m", "r", "g", F.when(F.regexp_replace("path", "/+$", "") == home.rstrip("/"), "").otherwise(last))
    origin = F.when(F.col("m").isNotNull(), "marker").when(F.col("r").isNotNull(), "registry").when(F.col("g").isNotNull(), "git").otherwise("folder")
    return own.join(m, "path", "left").join(r, "path", "left").join(g, "path", "left").select("path", project.alias("project"), origin.alias("origin"))
