"""The streaming operators, started as streams over files that arrive in two runs."""

import datetime
import json

import pytest

from skriva.operators import telemetry as batch
from skriva.streaming import telemetry as streams


def at(minute):
    return datetime.datetime(2025, 1, 1, 10) + datetime.timedelta(minutes=minute)


class Source:
    """Parquet files that a stream reads, a new one for each call."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.n}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/in")

    def all(self):
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/in")


def run(df, folder, mode, empty_batches=True):
    """Runs what is there now, and gives the rows of all batches so far, by batch."""
    out = f"{folder}/out"
    # A timeout by processing time would ask for empty batches for ever.
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(empty_batches).lower())

    def write(rows, number):
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    ended = q.awaitTermination(120)
    q.stop()
    assert ended and q.exception() is None
    return df.sparkSession.read.parquet(out)


def test_session_records_come_out_once(spark, tmp_path):
    source = Source(spark, tmp_path, "session_id string, ts timestamp, kind string, what string")
    source.add([("a", at(0), "unanswered", "x"), ("a", at(1), "unanswered", "x"), ("a", at(2), "written", "n.md"), ("b", at(0), "learned", None), ("c", at(3), "learned", None), ("c", at(4), "learned", None)])
    run(streams.session_records(source.stream()), tmp_path, "append")
    source.add([("z", at(600), "learned", None)])
    got = run(streams.session_records(source.stream()), tmp_path, "append").select("session_id", "unanswered", "written", "learned", "signals")
    want = [("a", 1, 1, 0, 2), ("c", 0, 0, 2, 2)]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(tuple(r) for r in streams.session_records(source.all()).select(*got.columns).collect()) == want


def test_usage_counters_run_on(spark, tmp_path):
    source = Source(spark, tmp_path, "path string, kind string, ts double, pinned int")
    source.add([("a", "shown", 1.0, None), ("a", "used", 2.0, None), ("b", "pin", 3.0, 1), (None, "shown", 3.0, None)])
    run(streams.usage_counters(source.stream()), tmp_path, "complete")
    source.add([("a", "used", 9.0, None), ("b", "pin", 4.0, 0)])
    last = run(streams.usage_counters(source.stream()), tmp_path, "complete")
    newest = max(r["batch"] for r in last.select("batch").distinct().collect())
    rows = lambda df: sorted(map(tuple, df.select("path", "impressions", "uses", "last_shown", "last_used", "pinned").collect()))
    assert rows(last.where(f"batch = {newest}")) == rows(streams.usage_counters(source.all())) == [("a", 1, 2, 1.0, 9.0, 0), ("b", 0, 0, 0.0, 0.0, 0)]


@pytest.mark.parametrize("keep", [200, 1])
def test_reads_are_attributed_across_batches(spark, tmp_path, keep):
    source = Source(spark, tmp_path, "session_id string, path string, kind string, ts timestamp, event_id bigint")
    source.add([("a", "x", "offer", at(0), 1), ("a", "y", "offer", at(1), 2), ("b", "x", "read", at(1), 3)])
    run(streams.attributed_reads(source.stream(), keep), tmp_path, "append", empty_batches=False)
    source.add([("a", "x", "read", at(2), 4), ("a", "x", "read", at(3), 5), ("a", "y", "read", at(4), 6), ("b", "y", "offer", at(5), 7), ("b", "y", "read", at(6), 8)])
    got = run(streams.attributed_reads(source.stream(), keep), tmp_path, "append", empty_batches=False)
    want = {("a", "x", at(2)), ("a", "y", at(4)), ("b", "y", at(6))} if keep == 200 else {("a", "y", at(4)), ("b", "y", at(6))}
    assert {(r.session_id, r.path, r.ts) for r in got.collect()} == want
    if keep == 200:
        assert {(r.session_id, r.path, r.ts) for r in batch.attributed_reads(source.all()).collect()} == want


def test_files_are_imported_once_and_bad_lines_set_apart(spark, tmp_path):
    schema = "session_id string, value string"
    source = Source(spark, tmp_path, schema)
    source.add([("a", json.dumps({"x": 1})), ("a", "not json"), ("a", ""), ("old", json.dumps({"x": 9}))])
    old = spark.createDataFrame([("old",)], "session_id string")
    start = lambda: streams.import_new_files(source.stream(), lambda df: df.where("value <> ''"), f"{tmp_path}/rows", f"{tmp_path}/bad", f"{tmp_path}/cp", old).awaitTermination(120)
    start()
    source.add([("b", json.dumps({"x": 2}))])
    start()
    start()
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert sorted((r.session_id, r.value) for r in rows.collect()) == [("a", '{"x": 1}'), ("b", '{"x": 2}')]
    assert [(r.session_id, r.value) for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == [("a", "not json")]
