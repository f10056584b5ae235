"""The task ledger: valid rows, rollups, costs, outputs still without embedding, and context of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.keys import norm_id

TASK_COLS = ["project_id", "parent_task_id", "role", "title", "status", "output", "provider", "model_used", "tokens_in", "tokens_out", "cost_usd", "created_at"]


def valid_tasks(tasks: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per task id, the latest; among equally late rows the greatest by content. Ids come out trimmed, in lower case."""
    cols = cols or TASK_COLS
    row = F.struct("updated_at", *[norm_id(c).alias(c) if c in ("project_id", "parent_task_id") else F.col(c) for c in cols])
    m = tasks.where(norm_id("id").isNotNull()).groupBy(norm_id("id").alias("id")).agg(F.max(row).alias("m"))
    return m.select("id", F.col("m.updated_at").alias("updated_at"), *[F.col(f"m.{c}").alias(c) for c in cols])


def valid_projects(projects: DataFrame) -> DataFrame:
    """One row per project id: earliest creation, deleted if any row says so, else the greatest of each column."""
    return projects.where(norm_id("id").isNotNull()).groupBy(norm_id("id").alias("id")).agg(
        F.max("tenant_id").alias("tenant_id"), F.max("name").alias("name"), F.max("workflow_id").alias("workflow_id"), F.max("status").alias("status"),
        F.min("created_at").alias("created_at"), F.max(F.col("deleted_at").isNotNull()).alias("deleted"),
    )


def project_rollup(projects: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks, done, failed and cost per project; a project without tasks has zeros. Tasks are aggregated before the join, so the join
    meets one row per project however many tasks it has."""
    done, failed = F.col("status") == "done", F.col("status") == "failed"
    per = tasks.where("project_id is not null").groupBy("project_id").agg(F.count("*").alias("task_count"), F.count(F.when(done, 1)).alias("done_count"), F.count(F.when(failed, 1)).alias("failed_count"), F.sum("cost_usd").alias("cost"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    joined = projects.join(per, projects["id"] == per["project_id"], "left")
    return joined.select("id", "workflow_id", "name", F.upper("status").alias("status"), "created_at", zero("task_count"), zero("done_count"), zero("failed_count"), F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("total_cost_usd"))


def cost_breakdown(tasks: DataFrame) -> DataFrame:
    """Tokens, cost and calls of done tasks per project, role, provider and model; a null provider is a group of its own."""
    g = tasks.where("status = 'done'").groupBy("project_id", "role", "provider", "model_used")
    return g.agg(F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.round(F.sum("cost_usd"), 4).cast("double").alias("cost_usd"), F.count("*").alias("calls"))


def latest_output(tasks: DataFrame, role: str) -> DataFrame:
    """Per project the output of its last created task of a role that has one."""
    m = tasks.where((F.col("role") == role) & F.col("output").isNotNull() & F.col("project_id").isNotNull()).groupBy("project_id").agg(F.max(F.struct("created_at", "id", "output")).alias("m"))
    return m.select("project_id", F.col("m.id").alias("task_id"), F.col("m.output").alias("output"))


def without_embedding(tasks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Done tasks with an output that have no embedding."""
    have = embeddings.select(norm_id("task_id").alias("id")).where("id is not null").distinct()
    return tasks.where("status = 'done' and output is not null").join(have, "id", "left_anti")


def ancestor_outputs(pairs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, ancestor_id, distance, role, title) of ancestors with an output; pairs as of `hierarchy.descendants`."""
    have = tasks.where("output is not null").select(F.col("id").alias("ancestor"), "role", "title")
    return pairs.join(have, "ancestor").select(F.col("descendant").alias("task_id"), F.col("ancestor").alias("ancestor_id"), "distance", "role", "title")
