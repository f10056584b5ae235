"""Queries over projects, tasks and their embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.keys import BLANKS
from graphmill.operators import hierarchy, ledger
from graphmill.plans.task_trees import _CTE as TREE_CTE
from graphmill.plans.task_trees import task_links
from graphmill.sources.tables import table


def _tasks(s: SparkSession, d: str, cols: list[str] | None = None) -> DataFrame:
    return ledger.valid_tasks(table(s, d, "tasks"), cols)


def _sized_tasks(s: SparkSession, d: str, cols: list[str]) -> DataFrame:
    """Valid tasks with the length of their output in its place, so that the texts are not shuffled."""
    return ledger.valid_tasks(table(s, d, "tasks").withColumn("output", F.length("output").cast("long")), cols)


def project_rollup(s: SparkSession, d: str) -> DataFrame:
    return ledger.project_rollup(ledger.valid_projects(table(s, d, "projects")), _tasks(s, d, ["project_id", "status", "cost_usd"]))


def cost_breakdown(s: SparkSession, d: str) -> DataFrame:
    return ledger.cost_breakdown(_tasks(s, d, ["project_id", "role", "provider", "model_used", "status", "tokens_in", "tokens_out", "cost_usd"]))


def latest_output(s: SparkSession, d: str) -> DataFrame:
    return ledger.latest_output(_sized_tasks(s, d, ["project_id", "role", "output", "created_at"]), "coder").select("project_id", "task_id", F.col("output").alias("n_chars"))


def backfill_anti(s: SparkSession, d: str) -> DataFrame:
    return ledger.without_embedding(_sized_tasks(s, d, ["status", "output", "created_at"]), table(s, d, "task_embeddings")).select("id", "created_at")


def ledger_reads(s: SparkSession, d: str) -> DataFrame:
    """All tasks of one project, oldest first."""
    t = _tasks(s, d, ["project_id", "role", "title", "status", "created_at"])
    biggest = t.where("project_id is not null").groupBy("project_id").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "project_id")).alias("m")).select(F.col("m.project_id").alias("project_id"))
    return t.join(F.broadcast(biggest), "project_id").select("id", "role", "title", "status", "created_at").orderBy("created_at", "id")  # one row is broadcast


def ancestors(s: SparkSession, d: str) -> DataFrame:
    pairs = hierarchy.descendants(hierarchy.hierarchy(task_links(s, d)))
    # whether there is an output is all that is asked, so the texts are not shuffled
    flagged = table(s, d, "tasks").withColumn("output", F.when(F.col("output").isNotNull(), "yes"))
    return ledger.ancestor_outputs(pairs, ledger.valid_tasks(flagged, ["role", "title", "output"]))


def status_latest(s: SparkSession, d: str) -> DataFrame:
    """Tasks per last status and role."""
    return _tasks(s, d, ["status", "role"]).groupBy("status", "role").agg(F.count("*").alias("n_tasks"))


def event_counters(s: SparkSession, d: str) -> DataFrame:
    """Count, sum and extremes of events per type and day."""
    return table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"))


_N = lambda c: f"nullif(lower(trim({c}, '{BLANKS}')), '')"
VALID = f"""
vt as (select id, m.* from (select {_N('id')} id, max(struct_pack(updated_at := updated_at, project_id := {_N('project_id')}, role := role, title := title, status := status, output := output, provider := provider, model_used := model_used, tokens_in := tokens_in, tokens_out := tokens_out, cost_usd := cost_usd, created_at := created_at)) m from tasks where {_N('id')} is not null group by 1)),
vp as (select {_N('id')} id, max(name) name, max(workflow_id) workflow_id, max(status) status, min(created_at) created_at from projects where {_N('id')} is not null group by 1)
"""

QUERIES = {f.__name__: f for f in (project_rollup, cost_breakdown, latest_output, backfill_anti, ledger_reads, ancestors, status_latest, event_counters)}
SQL = {
    "project_rollup": f"with {VALID}, n as (select project_id, count(*) task_count, count(*) filter (status = 'done') done_count, count(*) filter (status = 'failed') failed_count, sum(cost_usd) cost from vt where project_id is not null group by 1) select vp.id, workflow_id, name, upper(vp.status) status, created_at, coalesce(task_count, 0) task_count, coalesce(done_count, 0) done_count, coalesce(failed_count, 0) failed_count, coalesce(cast(cost as double), 0.0) total_cost_usd from vp left join n on n.project_id = vp.id",
    "cost_breakdown": f"with {VALID} select project_id, role, provider, model_used, cast(coalesce(sum(tokens_in), 0) as bigint) tokens_in, cast(coalesce(sum(tokens_out), 0) as bigint) tokens_out, cast(round(sum(cost_usd), 4) as double) cost_usd, count(*) calls from vt where status = 'done' group by 1, 2, 3, 4",
    "latest_output": f"with {VALID}, m as (select project_id, max(struct_pack(c := created_at, i := id, o := output)) m from vt where role = 'coder' and output is not null and project_id is not null group by 1) select project_id, m.i task_id, cast(length(m.o) as bigint) n_chars from m",
    "backfill_anti": f"with {VALID} select id, created_at from vt where status = 'done' and output is not null and id not in (select {_N('task_id')} from task_embeddings where {_N('task_id')} is not null)",
    "ledger_reads": f"with {VALID} select id, role, title, status, created_at from vt where project_id = (select max(struct_pack(n := n, p := project_id)).p from (select project_id, count(*) n from vt where project_id is not null group by 1))",
    "ancestors": TREE_CTE.replace("with recursive", f"with recursive {VALID},") + "select u.id task_id, u.anc ancestor_id, u.dist distance, vt.role, vt.title from up u join vt on vt.id = u.anc where u.dist > 0 and vt.output is not null and u.id not in (select id from bad)",
    "status_latest": f"with {VALID} select status, role, count(*) n_tasks from vt group by 1, 2",
    "event_counters": "select event_type, cast(ts as date) as day, count(*) n, round(sum(value), 6) total, min(value) least, max(value) greatest from events group by 1, 2",
}
