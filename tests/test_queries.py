"""Registered queries against their SQL, with whole and with split series."""

import pytest
from check import difference, tables

import __spark_entry__ as job
from sensorlab.plans import batch_queries, model_queries, stream_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(FOLDER)


@pytest.mark.parametrize("name", list(batch_queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    rows = job.queries()[name](spark, FOLDER).toPandas()
    assert difference(rows, con.execute(job.oracle_sql()[name]).df()) == ""


@pytest.mark.parametrize("name", list(batch_queries.QUERIES))
def test_split_query_equals_sql(spark, con, split, name):
    with split(40):
        rows = job.queries()[name](spark, FOLDER).toPandas()
    assert difference(rows, con.execute(job.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert job.entry(spark).count() > 0


def test_every_query_but_models_has_sql():
    models = {"train_trees"}
    own = {**batch_queries.QUERIES, **stream_queries.QUERIES, **model_queries.QUERIES}
    assert set(own) - set(job.oracle_sql()) == models


def test_catalog_is_broadcast(spark):
    plan = job.queries()["catalog_extract"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["asof_nearest", "match_and_label", "fused_rates", "fused_means", "lag_features"])
def test_one_exchange(spark, name):
    plan = job.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_scans_read_only_what_is_needed(spark):
    plan = job.queries()["time_bounds"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan
    plan = job.queries()["filter_range"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
