"""Exact percentiles by rounds of counting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlab.operators import profile

POINTS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p77": 0.77, "p100": 1.0}
rng = random.Random(1)
SHAPES = {
    "even": [rng.uniform(-5, 5) for _ in range(900)],
    "one far off": [rng.uniform(0, 1) for _ in range(900)] + [1e12, -1e200],
    "heavy tail": [rng.lognormvariate(0, 30) for _ in range(700)] + [-rng.lognormvariate(0, 30) for _ in range(200)],
    "few values": [rng.choice([0.0, 0.0, 0.0, 1.5, -2.0]) for _ in range(900)],
    "equal": [3.25] * 500,
    "neighbours": [1.0 + i * 2.0**-52 for i in range(800)],
    "one": [4.0],
}


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_equals_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(profile, "FEW_VALUES", few)
    rows = [(name, v) for name, values in SHAPES.items() for v in values]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "name string, v double").repartition(5)
    found = {r["name"]: r for r in profile.exact_percentiles(df, ["name"], "v", POINTS).collect()}
    for name, values in SHAPES.items():
        want = np.percentile(values, [100 * p for p in POINTS.values()])
        assert [found[name][p] for p in POINTS] == pytest.approx(want, rel=1e-12), name


def test_no_window_over_values(spark, monkeypatch):
    """Bins are ordered, values are not."""
    monkeypatch.setattr(profile, "FEW_VALUES", 50)
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("v"))
    plan = profile.exact_percentiles(df, ["k"], "v", {"p50": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_missing_values_null_keys_and_integers(spark):
    rows = [(1, None), (1, 4), (1, 9), (None, 7), (None, 8), (2, None)]
    df = spark.createDataFrame(rows, "k long, v long")
    found = {r["k"]: r["p50"] for r in profile.exact_percentiles(df, ["k"], "v", {"p50": 0.5}).collect()}
    assert found == {1: 6.5, None: 7.5}
    assert profile.exact_percentiles(df, [], "v", {"p50": 0.5}).first()[0] == 7.5
    assert profile.exact_percentiles(df.filter("false"), [], "v", {"p50": 0.5}).count() == 0
    nan = spark.createDataFrame([(1, float("nan")), (1, 2.0), (1, float("inf"))], "k long, v double")
    assert profile.exact_percentiles(nan, ["k"], "v", {"p0": 0.0}).first()["p0"] == 2.0
