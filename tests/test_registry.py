"""The driver contract: names, schemas, and the flagship query on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p3_found"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")
def test_queries_are_lazy_and_prune_columns(spark):
    plan = entry.queries()["find_symbol"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "docstring" not in plan.split("ReadSchema")[1].split(">")[0]
