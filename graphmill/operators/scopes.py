"""Nested intervals: each scope's innermost enclosing scope, and the innermost scope at a position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scope_at(scopes: DataFrame, positions: DataFrame, key: list[str]) -> DataFrame:
    """positions (key..., pos) with the innermost scope (start, end, id) that holds the position, half open; null where none does.

    An equi-join on the file with the interval as a condition, then an aggregate: the work per file is its scopes times its positions.
    """
    s = scopes.select(*[F.col(k).alias(f"__{k}") for k in key], "start", "end", "id")
    on = [F.col(k) == F.col(f"__{k}") for k in key] + [(F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end"))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    j = positions.select(*key, "pos").distinct().join(s, cond, "left")
    m = j.groupBy(*key, "pos").agg(F.min(F.when(F.col("id").isNotNull(), F.struct((F.col("end") - F.col("start")).alias("width"), "id"))).alias("m"))
    return m.select(*key, "pos", F.col("m.id").alias("id"))


def scope_parents(scopes: DataFrame, key: list[str]) -> DataFrame:
    """scopes (key..., start, end, id) with the id of the innermost scope that strictly holds them; null at the top.

    Two scopes of one file with the same span are no order; the smaller id then counts as the outer one.
    """
    a = scopes.select(*key, "start", "end", "id").distinct()
    b = a.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("id").alias("id2"))
    cond = (F.col("s2") <= F.col("start")) & (F.col("end") <= F.col("e2")) & ((F.col("e2") - F.col("s2") > F.col("end") - F.col("start")) | ((F.col("e2") == F.col("end")) & (F.col("s2") == F.col("start")) & (F.col("id2") < F.col("id"))))
    for k in key:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    m = a.join(b, cond, "left").groupBy(*key, "start", "end", "id").agg(F.min(F.when(F.col("id2").isNotNull(), F.struct((F.col("e2") - F.col("s2")).alias("width"), F.expr("0").alias("z"), "id2"))).alias("m"))
    return m.select(*key, "start", "end", "id", F.col("m.id2").alias("parent_id"))


def overlapping_pairs(scopes: DataFrame, key: list[str]) -> DataFrame:
    """Scopes that begin inside the scope before them and end after it, hence are not nested."""
    w = W.partitionBy(*key).orderBy("start", F.desc("end"), "id")
    x = scopes.withColumn("prev_end", F.lag("end").over(w)).withColumn("prev_id", F.lag("id").over(w))
    return x.where("start < prev_end and end > prev_end").select(*key, "id", "prev_id")
