"""Scanning source trees: reading files, skipping folders and ignored paths, languages, and what imports and includes mean."""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.lexing import LANGUAGE_OF
from graphmill.functions.types import plain_type

MAX_BYTES = 2 * 1024 * 1024
# Folders that are never scanned.
SKIPPED_DIRS = [".cache", ".env", ".git", ".hg", ".idea", ".mypy_cache", ".next", ".nox", ".nyc_output", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv", ".vscode", "__pycache__", "build", "coverage", "dist", "egg-info", "env", "node_modules", "out", "target", "venv"]
SUFFIX_ORDER = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def language(path: str | Column) -> Column:
    """The language that a path's suffix stands for, in any case; null for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1)))


def read_tree(spark: SparkSession, root: str, repo: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(repo, path, language, sha, content) of the source files below a folder; larger files and skipped folders are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(base)}/", "")
    f = f.select(F.lit(repo).alias("repo"), rel.alias("path"), "content").withColumn("language", language("path")).where("language is not null")
    return pruned(f).select("repo", "path", "language", F.sha2("content", 256).alias("sha"), F.decode("content", "UTF-8").alias("content"))


def pruned(files: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Files of which neither a folder nor the file itself has a skipped name."""
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in [*SKIPPED_DIRS, *(extra or [])]])))


def without_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files that no ignore pattern meets: a shell pattern (`*`, `?`, `[...]`) matches the whole path or one part of it, and `*` crosses
    folders; one leading and one trailing slash are dropped, comments and blank lines are no patterns."""
    out = files
    for line in patterns:
        p = line.strip().removeprefix("/").removesuffix("/") if not line.strip().startswith("#") else ""
        if p:
            body = "^" + fnmatch.translate(p)
            out = out.where(~(F.col("path").rlike(body) | F.exists(F.split("path", "/"), lambda x: x.rlike(body))))  # noqa: B023
    return out


def relative_target(folder: Column, spec: Column) -> Column:
    """The path that a relative import names from a folder (with its last slash): `.` stays, `..` goes up, beyond the top it stays there."""
    walk = F.filter(F.split(F.concat(folder, spec), "/"), lambda x: ~x.isin("", "."))
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(walk, F.array().cast("array<string>"), step), "/")


def script_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, spec, target): the file behind a relative import, the first that exists in the order of suffixes; null if none does."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    stem = F.regexp_replace(relative_target(folder, F.col("spec")), r"\.(ts|tsx|js|jsx)$", "")
    i = imports.select("repo", "path", "spec").distinct()
    tries = i.select("*", F.posexplode(F.array(*[F.concat(stem, F.lit(x)) for x in SUFFIX_ORDER])).alias("rank", "target"))
    known = files.select("repo", F.col("path").alias("target")).distinct()
    best = tries.join(known, ["repo", "target"], "left_semi").groupBy("repo", "path", "spec").agg(F.min_by("target", "rank").alias("target"))
    return i.join(best, ["repo", "path", "spec"], "left").select("repo", "path", "spec", "target")


def includes(inc: DataFrame, headers: DataFrame) -> DataFrame:
    """(repo, path, include, header): the header whose path ends in the include; of several the one that shares most leading folders, the
    first by name among equals; null if there is none. Joined on the file name, so that no pair of unrelated files is compared."""
    base = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    i = inc.select("repo", "path", "include").distinct()
    h = headers.select("repo", "header", base("header").alias("__b")).distinct()
    j = i.withColumn("__b", base("include")).join(h, ["repo", "__b"]).where((F.col("header") == F.col("include")) | F.endswith("header", F.concat(F.lit("/"), "include")))
    same = F.zip_with(F.split("path", "/"), F.split("header", "/"), lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct((acc["n"] + F.when(acc["on"] & x, 1).otherwise(0)).alias("n"), (acc["on"] & x).alias("on")), lambda acc: acc["n"])
    best = j.groupBy("repo", "path", "include").agg(F.min(F.struct((-shared).alias("n"), "header")).alias("b"))
    return i.join(best, ["repo", "path", "include"], "left").select("repo", "path", "include", F.col("b.header").alias("header"))


def return_type(raw: str | Column) -> Column:
    """`plain_type` of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def plain(x: pd.Series) -> pd.Series:
        return x.map(plain_type)

    return plain(_c(raw))
