"""Reading file_node: one row per (repo, path), and running a function over files in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.sources.tables import table

BATCH = "__n_batch"


def file_rows(spark: SparkSession, d: str) -> DataFrame:
    """All scans of all files with a repo and a path: repo, path, language, content, scanned_at."""
    return table(spark, d, "file_node").select("repo", "path", "language", "content", "scanned_at").where("repo is not null and path is not null")


def map_files(rows: DataFrame, judge: Callable[[str, str | None], dict], schema: str) -> DataFrame:
    """`judge(path, content)` for every scan, in the scan's own partition, then the latest scan's row per file.

    Only the small results are shuffled, never the contents. A null content counts as an empty text.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            out = [judge(path, content or "") for path, content in zip(p["path"], p["content"])]
            yield pd.DataFrame({"repo": p["repo"], "path": p["path"], "scanned_at": p["scanned_at"], **{n: [o[n] for o in out] for n in names}})

    judged = rows.select("repo", "path", "content", "scanned_at").mapInPandas(run, f"repo string, path string, scanned_at timestamp, {schema}")
    last = judged.groupBy("repo", "path").agg(F.max(F.struct("scanned_at", *names)).alias("m"))
    return last.select("repo", "path", *[F.col(f"m.{n}").alias(n) for n in names])
