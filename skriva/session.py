"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every plan of this library relies on; none of them depends on data size.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "skriva", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; `master` only for local use and tests."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    The folder is the one the cluster names in `spark.checkpoint.dir`. Only where that is unset, as in
    local tests, a temporary folder of this machine is used.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="skriva-checkpoint-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and continue from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's switch that removes a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, row: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder, by columns and compressed, and continue from the files.

    What was shuffled for it is removed when it is written. `row`: the name of a number that each row gets.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    if row:
        df = df.withColumn(row, F.monotonically_increasing_id())
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)
