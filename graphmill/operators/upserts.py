"""Keyed tables without a table format: upserts, edges with existing ends, hashes, pruning, duplicate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The last written row per key: greatest version, rows of `new` after those of `existing`. Applying `new` twice changes nothing."""
    cols = [c for c in existing.columns if c not in key]
    both = existing.withColumn("__batch", F.lit(0)).unionByName(new.select(*existing.columns).withColumn("__batch", F.lit(1)))
    m = both.where(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(F.max(F.struct(*version, "__batch", *[c for c in cols if c not in version])).alias("m"))
    return m.select(*key, *[F.col(f"m.{c}").alias(c) for c in cols])


def edges_with_ends(edges: DataFrame, sources: DataFrame, targets: DataFrame, identity: list[str]) -> DataFrame:
    """Edges (repo, source, target, ...) whose both ends exist, once per identity. sources/targets: (repo, qn)."""
    s = sources.select("repo", F.col("qn").alias("source")).distinct()
    t = targets.select("repo", F.col("qn").alias("target")).distinct()
    return edges.join(s, ["repo", "source"], "left_semi").join(t, ["repo", "target"], "left_semi").dropDuplicates(identity)


def pick_target(edges: DataFrame, candidates: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each edge's (repo, target) with the kind of the first candidate table that knows it; null if none does.

    The tables are unioned with their order, so it costs one join however many there are.
    """
    known = None
    for i, (kind, df) in enumerate(candidates):
        one = df.select("repo", F.col("qn").alias("target"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"))
        known = one if known is None else known.unionByName(one)
    best = known.groupBy("repo", "target").agg(F.min(F.struct("rank", "kind")).alias("b")).select("repo", "target", F.col("b.kind").alias("target_kind"))
    return edges.join(best, ["repo", "target"], "left")


def changed_files(current: DataFrame, prior: DataFrame, force: bool = False) -> DataFrame:
    """Files (repo, path, sha) to process again: those whose prior hash for the same path differs or is missing."""
    return current if force else current.join(prior.select("repo", "path", "sha").distinct(), ["repo", "path", "sha"], "left_anti")


def update_where_present(base: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """`base` with `column` replaced where `new` (key, column) has a value; rows of `new` without a match have no effect."""
    n = new.where(F.col(column).isNotNull()).groupBy(key).agg(F.max(column).alias("__new"))
    return base.join(n, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that several different rows share, with their number; exact copies are no violation."""
    return df.distinct().groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def prune_stale(df: DataFrame, repo: str, stored_sha: str | None, sha: str) -> DataFrame:
    """`df` without the rows of a repo that was scanned at another commit. Unchanged if the hash is blank, unknown or the same."""
    return df if not sha or stored_sha is None or stored_sha == sha else df.where(~F.col("repo").eqNullSafe(F.lit(repo)))
