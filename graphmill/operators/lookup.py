"""Typed lookups over the code graph: definitions, symbols, callers, closures, members, accessors, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmill.functions.scratch import Scratch


def first_rows(df: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """One row per key: the least by (cols), so duplicates and reruns agree. Rows with a null key are dropped."""
    m = df.where(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(F.min(F.struct(*cols)).alias("m"))
    return m.select(*key, *[F.col(f"m.{c}").alias(c) for c in cols])


def definitions(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(repo, qualified_name, kind, name, file_path, line_start, line_end), one per (repo, name, kind)."""
    cols = ["file_path", "line_start", "line_end", "name"]
    f = first_rows(functions, ["repo", "qualified_name"], cols).withColumn("kind", F.lit("function"))
    return f.unionByName(first_rows(classes, ["repo", "qualified_name"], cols).withColumn("kind", F.lit("class")))


def find_definition(defs: DataFrame, repo: str, qualified_name: str) -> DataFrame:
    """The definition of a name, a function before a class; no row if there is none."""
    return defs.where((F.col("repo") == repo) & (F.col("qualified_name") == qualified_name)).orderBy(F.desc("kind")).limit(1)


def find_symbol(defs: DataFrame, needle: str, repo: str | None = None, limit: int | None = None) -> DataFrame:
    """Names that contain a text, in any case; shortest first. A blank text finds nothing."""
    if not needle.strip():
        return defs.limit(0)
    hit = F.contains(F.lower(F.coalesce("name", "qualified_name")), F.lit(needle.lower()))
    out = defs.where(hit if repo is None else hit & (F.col("repo") == repo))
    return out.orderBy(F.length("qualified_name"), "qualified_name").limit(limit) if limit else out


def is_test_path(path: str | Column) -> Column:
    """Whether a path is a test's: it begins with, or holds a folder or file that begins with, a test prefix."""
    return F.coalesce((F.col(path) if isinstance(path, str) else path).rlike(r"^(tests/|test/|test_)|/tests/|/test/|/test_"), F.lit(False))


def callers(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Every call with the file of its caller, whatever is called; the same call on two lines counts twice, copies once."""
    f = functions.select("repo", F.col("qualified_name").alias("caller_qn"), F.col("file_path").alias("caller_file"))
    return calls.where("callee_qn is not null and caller_qn is not null").select("repo", "caller_qn", "callee_qn", "line").distinct().join(f, ["repo", "caller_qn"])


def callees(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """Calls per caller whose callee is a definition of the same repo."""
    d = defs.where("kind = 'function'").select("repo", F.col("qualified_name").alias("callee_qn"))
    return calls.where("caller_qn is not null").select("repo", "caller_qn", "callee_qn", "line").distinct().join(d, ["repo", "callee_qn"], "left_semi")


def closure(edges: DataFrame, roots: DataFrame, name: str = "closure", max_rounds: int = 1000) -> DataFrame:
    """(root, node) for every node reachable from each root over edges (parent, child), the root itself included.

    A frontier loop: a pair leads on only in the round it is new, so cycles end and diamonds are met once.
    """
    scratch = Scratch(edges.sparkSession, name)
    edges = scratch.save(edges.where("parent is not null and child is not null").select("parent", "child").distinct())
    seen = scratch.save(roots.select("root", F.col("root").alias("node")).distinct())
    frontier = seen
    for _ in range(max_rounds):
        step = frontier.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        frontier = scratch.save(step.join(seen, ["root", "node"], "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError(f"no closure after {max_rounds} rounds")


def ordered_members(steps: DataFrame, key: str, order: list[str], member: str) -> DataFrame:
    """(key, step_count, members) with the members in their order; a step of a process of bounded length."""
    return steps.groupBy(key).agg(F.count("*").alias("step_count"), F.array_sort(F.collect_list(F.struct(*order, member))).alias("m")).select(key, "step_count", F.transform("m", lambda x: x[member]).alias("members"))


def modules(members: DataFrame, sample: int = 5) -> DataFrame:
    """(repo, label, size, sample) of groups (repo, label, member, path) with more than one member and one outside tests.

    The sample is ranked by a window that keeps `sample` rows per group early, so no group is collected as a whole.
    """
    per = members.groupBy("repo", "label").agg(F.countDistinct("member").alias("size"), F.max(~is_test_path("path")).alias("real")).where("size > 1 and real")
    w = W.partitionBy("repo", "label").orderBy("member")
    top = members.select("repo", "label", "member").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample)
    firsts = top.groupBy("repo", "label").agg(F.array_sort(F.collect_list("member")).alias("sample"))
    return per.join(firsts, ["repo", "label"]).select("repo", "label", "size", F.array_join("sample", ",").alias("sample"))


def accessors(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Reads and writes as one set (function, table, op_kind, line); one that does both comes out twice."""
    cols = ["function", "table_name", "line"]
    return reads.select(*cols, F.lit("read").alias("op_kind")).unionByName(writes.select(*cols, F.lit("write").alias("op_kind"))).distinct()


def repo_stats(parts: dict[str, DataFrame]) -> DataFrame:
    """Distinct records per repo and kind; parts: kind -> (repo, key)."""
    out = None
    for kind, df in parts.items():
        one = df.select("repo", "key").distinct().groupBy("repo").agg(F.count("*").alias("n")).select("repo", F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out
