"""Streams in several micro-batches give the state of one load."""

import datetime

from graphmill.operators import orphans
from graphmill.streaming import maintain

CHANGES = "table_name string, record_key string, scope string, ref string, at timestamp, key string, created timestamp, deleted boolean"


def _t(n):
    return datetime.datetime(2026, 1, n)


def test_orphan_stream_equals_one_load(spark, tmp_path):
    data = [("t", f"r{i}", "s", f"p{i % 5}", _t(10), None, None, None) for i in range(8)] + [(None, None, "s", None, None, f"p{i}", _t(3 + 4 * i), i == 1) for i in range(4)]
    for k in range(6):
        spark.createDataFrame(data[k::6], CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    maintain.maintain_orphans(stream, f"{tmp_path}/state", f"{tmp_path}/cp", compact_every=2).awaitTermination(120)
    got = maintain.orphan_state(spark, f"{tmp_path}/state")
    assert {n for _, n in maintain._entries(spark, f"{tmp_path}/state/refs")} == {"base-3", "delta-4", "base-5", "delta-5"}
    df = spark.createDataFrame(data, CHANGES)
    want, _ = orphans.apply(None, None, df.where("record_key is not null").select(*orphans.REF_COLS), df.where("record_key is null").select("scope", "key", "created", "deleted"))
    rows = lambda x: sorted((r.record_key, r.reason) for r in x.collect())
    assert rows(got) == rows(want) and ("r0", None) in rows(got) and ("r1", "deleted") in rows(got) and ("r4", "absent") in rows(got) and ("r3", "late") in rows(got)


def test_file_stream_keeps_the_last_scan(spark, tmp_path):
    schema = "repo string, path string, sha string, scanned_at timestamp"
    for k, rows in enumerate([[("r", "a", "1", _t(1))], [("r", "a", "2", _t(5)), ("r", "b", "1", _t(1))], [("r", "a", "3", _t(2))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    maintain.maintain_files(stream, f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted((r.path, r.sha) for r in maintain.latest_version(spark, f"{tmp_path}/state", schema).collect()) == [("a", "2"), ("b", "1")]
