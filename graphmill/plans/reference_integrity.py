"""p2: orphan references of the ledger and the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.keys import BLANKS, nonblank, norm_id
from graphmill.functions.scratch import Scratch
from graphmill.operators import orphans
from graphmill.sources.tables import table

_NO_TIME = "cast(null as timestamp)"
INCREMENT_MONTHS = 12


def references(spark: SparkSession, d: str) -> DataFrame:
    """All rows that refer, in the three tables, as (table_name, record_key, scope, ref, at, version), older states included."""
    cols = lambda name, key, scope, ref, at, version: (F.lit(name).alias("table_name"), key.alias("record_key"), scope.alias("scope"), ref.alias("ref"), F.col(at).alias("at"), F.coalesce(version, F.lit("0001-01-01").cast("timestamp")).alias("version"))
    tasks = table(spark, d, "tasks").select(*cols("tasks", norm_id("id"), F.lit("project"), norm_id("project_id"), "created_at", "updated_at"))
    emb = table(spark, d, "task_embeddings").select(*cols("task_embeddings", norm_id("task_id"), F.lit("task"), norm_id("task_id"), "created_at", "created_at"))
    calls = table(spark, d, "call_site").select(*cols("call_site", F.col("call_id").cast("string"), F.concat(F.lit("qn:"), F.col("repo")), nonblank("callee_qn"), "scanned_at", "scanned_at"))
    return tasks.unionByName(emb).unionByName(calls.where("ref is not null"))


def parents(spark: SparkSession, d: str) -> DataFrame:
    """All events of records that can be referred to as (scope, key, created, deleted, version, since): a project arrives when it is
    created and again, as a deletion, when it is deleted; a task with each of its states; names of code are there from the start."""
    none = F.expr(_NO_TIME)
    p = table(spark, d, "projects").select(norm_id("id").alias("key"), "created_at", "deleted_at")
    made = p.select(F.lit("project").alias("scope"), "key", F.col("created_at").alias("created"), F.lit(False).alias("deleted"), none.alias("version"), F.col("created_at").alias("since"))
    gone = p.where("deleted_at is not null").select(F.lit("project").alias("scope"), "key", none.alias("created"), F.lit(True).alias("deleted"), none.alias("version"), F.col("deleted_at").alias("since"))
    t = table(spark, d, "tasks").select(norm_id("id").alias("key"), "created_at", F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp")).alias("version"))
    t = t.select(F.lit("task").alias("scope"), "key", F.col("created_at").alias("created"), F.lit(False).alias("deleted"), "version", F.col("version").alias("since"))
    out = made.unionByName(gone).unionByName(t)
    for name in ("function_node", "class_node", "symbol_node"):
        out = out.unionByName(table(spark, d, name).select(F.concat(F.lit("qn:"), F.col("repo")).alias("scope"), F.col("qualified_name").alias("key"), none.alias("created"), F.lit(False).alias("deleted"), none.alias("version"), none.alias("since")).distinct())
    return out


def _state(spark: SparkSession, d: str, months: int = INCREMENT_MONTHS) -> DataFrame:
    """The reference state after all increments of `months` calendar months, each with the rows and parents dated in it."""
    scratch = Scratch(spark, "orphans")
    slot = lambda c: F.greatest(F.coalesce(F.floor((F.year(c) * 12 + F.month(c)) / months).cast("int"), F.lit(0)), F.lit(0)).alias("slot")
    refs = scratch.save(references(spark, d).where("record_key is not null").select("*", slot("version")), "slot")
    arrived = scratch.save(parents(spark, d).where("key is not null").select("scope", "key", "created", "deleted", "version", slot("since")), "slot")
    slots = sorted({r.slot for r in refs.select("slot").unionByName(arrived.select("slot")).distinct().collect()})  # one per `months` of the calendar
    at = lambda df, n: df.where(F.col("slot") == n).drop("slot")
    state = orphans.fold(((at(refs, n), at(arrived, n)) for n in slots or [0]), scratch)
    return state


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record whose reference does not resolve, from the state after all increments."""
    return _state(spark, d).where("reason is not null").select("table_name", "record_key")


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot of that state: orphans per table, month and reason."""
    return orphans.snapshot(_state(spark, d))


_B = BLANKS.replace("'", "''")
_N = lambda c: f"nullif(lower(trim({c}, '{_B}')), '')"
_CTE = f"""
with t as (select {_N('id')} k, arg_max(struct_pack(p := {_N('project_id')}, c := created_at), updated_at) v from tasks where {_N('id')} is not null group by 1),
p as (select {_N('id')} k, min(created_at) c, bool_or(deleted_at is not null) del from projects group by 1),
e as (select {_N('task_id')} k, max(created_at) c from task_embeddings where {_N('task_id')} is not null group by 1),
q as (select repo, qualified_name qn from function_node union select repo, qualified_name from class_node union select repo, qualified_name from symbol_node),
c as (select distinct call_id, repo, callee_qn, scanned_at from call_site where trim(callee_qn, '{_B}') <> ''),
o as (
select 'tasks' table_name, t.k record_key, t.v.c as ts, case when p.k is null then 'absent' when p.del then 'deleted' when p.c > t.v.c then 'late' end reason
from t left join p on p.k = t.v.p where t.v.p is not null
union all select 'task_embeddings', e.k, e.c, case when t.k is null then 'absent' when t.v.c > e.c then 'late' end from e left join t on t.k = e.k
union all select 'call_site', cast(c.call_id as varchar), c.scanned_at, case when q.qn is null then 'absent' end from c left join q on q.repo = c.repo and q.qn = c.callee_qn)
"""

QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods}
SQL = {
    "p2_found": _CTE + "select table_name, record_key from o where reason is not null",
    "p2_periods": _CTE + "select table_name, strftime(ts at time zone 'UTC', '%Y-%m') period, reason, count(*) n_orphans from o where reason is not null group by 1, 2, 3",
}
