"""References to records that do not exist, kept as incremental keyed state.

State is two tables. The *parent index* has per (scope, key) the creation time and whether it is deleted. The *reference
state* has one row per referring record with its reference, its time and its present reason: null (resolved), `absent`,
`deleted` or `late` (the parent was created after the record).

`apply` takes one increment of references and parents. New references probe the parent index; parents that arrive
settle the orphans waiting for them; deletions reopen references that were resolved. Only references whose
key is touched by the increment are judged again (`changes`); all others are carried over. `fold` runs many increments over
a log of such changes, so an increment writes what it changes and not the state.

Order: a record's `version` decides between its rows, so an older row that arrives late loses, and one without version loses to
one with it; between equal versions, or without any, the later increment wins. A parent with versions has the creation time of its greatest one, a parent without has its earliest.

Nulls and blanks: a null or blank reference refers to nothing; with a version it is kept, since it ends what an older row
referred to, but never is an orphan. A record without key is not kept; a null time never counts as too early or too late.
Of rows of one record with equal versions the one with the greatest (at, scope, ref) holds. Empty tables give empty state.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.scratch import Scratch

RECORD, REF_COLS = ["table_name", "record_key"], ["table_name", "record_key", "scope", "ref", "at"]


def latest(df: DataFrame, key: str, version: str, cols: list[str]) -> DataFrame:
    """The valid row per key: the greatest version; among equal versions the greatest of `cols`, so reruns agree.

    An aggregate over a struct, hence combined before the shuffle: a key that repeats often costs one row per task.
    """
    picked = F.max(F.struct(F.col(version).alias("__v"), *[F.col(c).alias(f"__{c}") for c in cols])).alias("__m")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(picked).select(key, F.col("__m.__v").alias(version), *[F.col(f"__m.__{c}").alias(c) for c in cols])


def _versioned(df: DataFrame) -> DataFrame:
    return df if "version" in df.columns else df.withColumn("version", F.lit(None).cast("timestamp"))


def merge_parents(arrivals: DataFrame) -> DataFrame:
    """Parent index (scope, key, created, deleted, version, seq) of all arrivals (scope, key, created, deleted, version, seq): deleted if
    ever deleted, `seq` the last increment that named the parent."""
    last = F.max(F.when(F.col("version").isNotNull(), F.struct("version", "created")))
    merged = arrivals.where("key is not null").groupBy("scope", "key").agg(F.min("created").alias("created"), F.max("deleted").alias("deleted"), last.alias("m"), F.max("seq").alias("seq"))
    return merged.select("scope", "key", F.when(F.col("m").isNull(), F.col("created")).otherwise(F.col("m.created")).alias("created"), "deleted", F.col("m.version").alias("version"), "seq")


def current(log: DataFrame) -> DataFrame:
    """The reference state that a log of rows amounts to: of each record the row of the greatest version, of the latest increment."""
    m = log.groupBy(*RECORD).agg(F.max(F.struct("version", "seq", "at", "scope", "ref", "reason")).alias("m"))
    return m.select(*RECORD, *[F.col(f"m.{c}").alias(c) for c in ("scope", "ref", "at", "version", "reason", "seq")])


def changes(log: DataFrame | None, index: DataFrame, new_refs: DataFrame, seq: int) -> DataFrame:
    """The rows that increment `seq` adds to the log: its own references, and those whose parent it names, judged against the index.

    Old and new rows of a record meet in one aggregation, and references meet their parent in one join, which AQE
    splits where one parent is named by a large share of all rows.
    """
    fresh = _versioned(new_refs).where("record_key is not null and (ref is not null or version is not null)")
    fresh = fresh.select(*REF_COLS, "version", F.lit(None).cast("string").alias("reason"), F.lit(seq).alias("seq"))
    now = current(fresh if log is None else log.select(*REF_COLS, "version", "reason", "seq").unionByName(fresh))
    idx = index.select(F.col("scope").alias("__s"), F.col("key").alias("__k"), "created", "deleted", F.col("seq").alias("__seq"))
    joined = now.join(idx, (F.col("scope") == F.col("__s")) & (F.col("ref") == F.col("__k")), "left").where((F.col("seq") == seq) | (F.col("__seq") == seq))
    reason = F.when(F.col("ref").isNull(), None).when(F.col("__k").isNull(), "absent").when(F.col("deleted"), "deleted").when(F.col("created") > F.col("at"), "late")
    return joined.select(*REF_COLS, "version", reason.alias("reason"), F.lit(seq).alias("seq"))


def numbered(arrived: DataFrame, seq: int) -> DataFrame:
    return _versioned(arrived).select("scope", "key", "created", "deleted", "version", F.lit(seq).alias("seq"))


def apply(state: DataFrame | None, index: DataFrame | None, new_refs: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One increment: returns the new reference state and the new parent index, both written so that plans do not grow from
    increment to increment. `state`/`index` are None at first."""
    scratch = Scratch(new_refs.sparkSession, "orphans")
    new = numbered(arrived, 1)
    new_index = scratch.save(merge_parents(new if index is None else index.withColumn("seq", F.lit(0)).unionByName(new)))
    log = None if state is None else state.withColumn("seq", F.lit(0))
    changed = scratch.save(changes(log, new_index, new_refs, 1))
    whole = changed if log is None else scratch.save(current(log.unionByName(changed)))
    return whole.drop("seq"), new_index.drop("seq")


def fold(increments: Iterable[tuple[DataFrame, DataFrame]], scratch: Scratch) -> DataFrame | None:
    """The reference state after increments of (new_refs, arrived) in their order; each writes its changes only."""
    log: list[DataFrame] = []
    arrivals: list[DataFrame] = []
    both = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    for seq, (refs, arrived) in enumerate(increments):
        arrivals.append(numbered(arrived, seq))
        log.append(scratch.save(changes(both(log), merge_parents(both(arrivals)), refs, seq)))
    return current(both(log)).drop("seq") if log else None


def snapshot(state: DataFrame) -> DataFrame:
    """Orphans per table, month of the record and reason, from the current state."""
    return (
        state.where("reason is not null")
        .groupBy("table_name", F.date_format("at", "yyyy-MM").alias("period"), "reason")
        .agg(F.count("*").alias("n_orphans"))
    )
