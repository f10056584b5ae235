"""p3: task trees of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.keys import BLANKS, norm_id
from graphmill.operators import hierarchy as h
from graphmill.operators.orphans import latest
from graphmill.sources.tables import table


def task_links(spark: SparkSession, d: str) -> DataFrame:
    """(id, parent) of the valid row per task; blank references are null."""
    t = table(spark, d, "tasks").select(norm_id("id").alias("id"), norm_id("parent_task_id").alias("parent"), "updated_at")
    return latest(t, "id", "updated_at", ["parent"]).select("id", "parent")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every task with its root, depth and number of descendants."""
    return h.hierarchy(task_links(spark, d)).select(F.col("id").alias("task_id"), "root_id", "depth", "n_descendants")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every task outside cycles with its path from the root."""
    return h.paths(h.hierarchy(task_links(spark, d))).select(F.col("id").alias("task_id"), F.array_join("path", "/").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a task and one below it."""
    return h.descendants(h.hierarchy(task_links(spark, d)))


def p3_spliced(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p3_found with a small last step, so that the contraction by splicing runs on small tables too."""
    return h.hierarchy(task_links(spark, d), base_rows=SMALL_BASE).select(F.col("id").alias("task_id"), "root_id", "depth", "n_descendants")


def p3_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Every cycle: its smallest id and the number of tasks on it and below it."""
    t = h.hierarchy(task_links(spark, d)).where("depth < 0")
    return t.groupBy("root_id").agg(F.sum(F.col("on_cycle").cast("long")).alias("n_on_cycle"), F.count("*").alias("n_tasks"))


SMALL_BASE = 1024
_B = BLANKS
_N = lambda c: f"nullif(lower(trim({c}, '{_B}')), '')"
_CTE = f"""
with recursive v as (select {_N('id')} id, arg_max(struct_pack(p := {_N('parent_task_id')}), updated_at).p par from tasks where {_N('id')} is not null group by 1),
l as (select a.id, b.id par from v a left join v b on b.id = a.par),
up as (select id, id as anc, 0::bigint as dist, [id] as path, false as looped from l
union all select up.id, l.par, up.dist + 1, list_prepend(l.par, up.path), list_contains(up.path, l.par) from up join l on l.id = up.anc where l.par is not null and not up.looped),
bad as (select distinct id from up where looped),
cyc as (select distinct a.id, a.anc, a.dist from up a join bad using (id)),
oncyc as (select distinct anc id from up where looped),
top as (select id, max(dist) depth from up where id not in (select id from bad) group by 1),
root as (select u.id, u.anc root_id, t.depth from up u join top t on t.id = u.id and t.depth = u.dist),
n as (select anc id, count(*) - 1 n from up where id not in (select id from bad) group by 1)
"""

QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_cycles": p3_cycles, "p3_spliced": p3_spliced}
_LOOPS = """, loops as (select u.id, u.anc entry_id from up u where u.looped),
ring as (select l0.entry_id, min(u.anc) root_id from (select distinct entry_id from loops) l0 join up u on u.id = l0.entry_id group by 1)
"""
SQL = {
    "p3_found": _CTE
    + _LOOPS
    + """select root.id task_id, root.root_id, root.depth, cast(n.n as bigint) n_descendants from root join n on n.id = root.id
union all select loops.id, ring.root_id, -1, -1 from loops join ring using (entry_id)""",
    "p3_paths": _CTE + "select u.id task_id, array_to_string(u.path, '/') path from up u join top t on t.id = u.id and t.depth = u.dist",
    "p3_cycles": _CTE + _LOOPS + "select ring.root_id, count(*) filter (loops.id = loops.entry_id) n_on_cycle, count(*) n_tasks from loops join ring using (entry_id) group by 1",
    "p3_descendants": _CTE + "select anc ancestor, id descendant, dist distance from up where dist > 0 and id not in (select id from bad)",
}
SQL["p3_spliced"] = SQL["p3_found"]
