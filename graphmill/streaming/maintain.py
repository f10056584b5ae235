"""Structured Streaming around the incremental operators: each micro-batch is one increment of a state kept in a folder.

Orphan state is a log: a batch writes only the rows it changes (`delta-N`), and every so many batches the log is written anew as one
table (`base-N`); what an older base covers is then deleted. The state of files is one table per batch, of which the last two stay. A
replayed batch reads the same older tables and writes its own again, so restarts are exact. The folder must be shared by all executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphmill.operators import orphans, upserts

REF_SCHEMA = "table_name string, record_key string, scope string, ref string, at timestamp, version timestamp, reason string"
PARENT_SCHEMA = "scope string, key string, created timestamp, deleted boolean, version timestamp"
COMPACT_EVERY = 16


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, name) of the tables in a folder, oldest first."""
    path, fs = _fs(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted((int(n.rsplit("-", 1)[-1]), n) for n in names if n.rsplit("-", 1)[-1].isdigit())


def _delete(spark: SparkSession, folder: str, names: list[str]) -> None:
    for n in names:
        path, fs = _fs(spark, f"{folder}/{n}")
        fs.delete(path, True)


def _log(spark: SparkSession, folder: str, before: int | None, schema: str) -> DataFrame | None:
    """The newest base and the deltas after it, with the batch as `seq`, of batches before one (all where None)."""
    every = [(k, n) for k, n in _entries(spark, folder) if before is None or k < before]
    base = max((k for k, n in every if n.startswith("base")), default=-1)
    read = [(k, n) for k, n in every if n == f"base-{base}" or n.startswith("delta") and k > base]
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{folder}/{n}").withColumn("seq", F.lit(k)) for k, n in read]) if read else None


def _compact(spark: SparkSession, folder: str, batch_id: int, whole: DataFrame) -> None:
    """Writes the log as one table and deletes what the base before it covers; that base and its deltas stay for a replay."""
    whole.write.mode("overwrite").parquet(f"{folder}/base-{batch_id}")
    last = max((k for k, n in _entries(spark, folder) if n.startswith("base") and k < batch_id), default=-1)
    _delete(spark, folder, [n for k, n in _entries(spark, folder) if k < last or k == last and n.startswith("delta")])


def orphan_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The reference state that `maintain_orphans` keeps in a folder; None before its first batch."""
    log = _log(spark, f"{folder}/refs", None, REF_SCHEMA)
    return None if log is None else orphans.current(log).drop("seq")


def maintain_orphans(changes: DataFrame, folder: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keeps the orphan state of a stream of changes: rows of (table_name, record_key, scope, ref, at) that refer, and rows of (scope, key,
    created, deleted) that can be referred to, told apart by whether `record_key` is null; both may have a `version`."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = orphans._versioned(batch).persist()
        log = _log(spark, f"{folder}/refs", batch_id, REF_SCHEMA)
        older = _log(spark, f"{folder}/parents", batch_id, PARENT_SCHEMA)
        refs = batch.where("record_key is not null").select(*orphans.REF_COLS, "version")
        arrived = orphans.numbered(batch.where("record_key is null and key is not null"), batch_id)
        index = orphans.merge_parents(arrived if older is None else older.unionByName(arrived))
        orphans.changes(log, index, refs, batch_id).drop("seq").write.mode("overwrite").parquet(f"{folder}/refs/delta-{batch_id}")
        arrived.drop("seq").write.mode("overwrite").parquet(f"{folder}/parents/delta-{batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _compact(spark, f"{folder}/refs", batch_id, orphans.current(_log(spark, f"{folder}/refs", batch_id + 1, REF_SCHEMA)).drop("seq"))
            _compact(spark, f"{folder}/parents", batch_id, index.drop("seq"))
        batch.unpersist()

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_files(files: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps one row per (repo, path) of a stream of scanned files (repo, path, sha, scanned_at), the last scanned."""
    schema = "repo string, path string, sha string, scanned_at timestamp"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(schema).parquet(f"{folder}/{batch_id - 1}") if batch_id else None
        rows = batch.select("repo", "path", "sha", "scanned_at")
        upserts.upsert(rows.limit(0) if old is None else old, rows, ["repo", "path"], ["scanned_at"]).select("repo", "path", "sha", "scanned_at").write.mode("overwrite").parquet(f"{folder}/{batch_id}")
        _delete(spark, folder, [n for k, n in _entries(spark, folder) if k < batch_id - 1])

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest version of a state table."""
    return spark.read.schema(schema).parquet(f"{folder}/{_entries(spark, folder)[-1][1]}")
