"""Cutting lineage through tables written to the folder all executors share.

The folder is the session's `spark.checkpoint.dir`. Where it is unset, as in tests, one under the system's
temporary folder is set; on a cluster that setting has to be there, since executors do not share local disks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_BASES: list[str] = []


def _delete(path: str) -> None:
    context = SparkContext._active_spark_context
    if context is not None:
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    """Removes the tables of all runs of this driver, which results read until it ends; best effort, as the session may be gone."""
    for base in _BASES:
        try:
            _delete(base)
        except Exception:  # noqa: BLE001
            return


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that `spark.checkpoint.dir` names."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="graphmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Tables of one operator run. `save` writes a frame and reads it back, `drop` removes it once superseded."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/graphmill-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _BASES.append(self.base)

    def save(self, df: DataFrame, *by: str) -> DataFrame:
        """The frame, written and read back; `by` names columns that divide it into folders, read one by one where filtered."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.partitionBy(*by).parquet(path)
        # the written schema is known, so no job is spent on reading footers
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(path)
