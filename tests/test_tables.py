"""Set operators, rolling filter, profiles, resampling and splits."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from helpers import T0, at, series, values
from pyspark.sql import functions as F

from sensorlab.operators import profile, resample, rolling, sets, split as splits


def test_dedup_keeps_the_first_arrival(spark):
    rows = series(spark, [(0, 1), (0, 2), (5, 3)])
    once = sets.dedup_first(rows, ["site"], seq="seq")
    assert values(once, "value") == [1, 3]
    assert values(sets.dedup_first(once, ["site"], seq="seq"), "value") == [1, 3]


def test_copies_shrink_before_the_exchange(spark):
    rows = series(spark, [(0, 1), (0, 2), (5, 3)])
    plan = sets.dedup_first(rows, ["site"], seq="seq")._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_keep_unique_drops_all_members(spark):
    assert values(sets.keep_unique(series(spark, [(0, 1), (0, 1), (5, 3)]), ["site"]), "value") == [3]


def test_merge_prefers_the_first_table(spark):
    first, second = series(spark, [(0, 1), (9, 2)]), series(spark, [(0, 10), (5, 20)])
    assert values(sets.merge_first([first, second], ["site"], seq="seq"), "value") == [1, 20, 2]


def test_late_rows(spark, mode):
    rows = series(spark, [(0, 0), (100, 1), (50, 2), (39, 3), (101, 4), (102, 5), (103, 6), (30, 7)])
    done = sets.drop_late(rows, ["site"], "seq", delay_seconds=60)
    assert values(done, "value", order=("seq",)) == [0, 1, 2, 4, 5, 6]


def test_flat_stretch_is_dropped(spark, mode):
    assert rolling.mad_filter(series(spark, [(i, 5) for i in range(25)]), ["site"], seq="seq").count() == 0


def test_too_few_samples(spark, mode):
    rows = series(spark, [(i, i) for i in range(4)])
    assert values(rolling.rolling_mean(rows, ["site"], seq="seq"), "rolling_mean") == [None] * 4
    assert rolling.mad_filter(rows, ["site"], seq="seq").count() == 0


@pytest.mark.parametrize("rows_per_slice", [10**6, 60, 7])
def test_filter_equals_pandas(spark, split, rows_per_slice):
    rng = random.Random(4)
    data = [(i * 60, rng.gauss(10, 1) + (50 if i % 41 == 0 else 0)) for i in range(300)]
    v = pd.Series([x for _, x in data])
    m = v.rolling(25, center=True, min_periods=5).mean()
    d = (v - m).abs().rolling(25, center=True, min_periods=5).mean()
    with split(rows_per_slice):
        stats = rolling.rolling_mad(series(spark, data), ["site"], seq="seq")
        got = values(stats, "rolling_mean", "rolling_mad")
        kept = values(rolling.mad_filter(series(spark, data), ["site"], seq="seq"), "seq")
    assert np.allclose(np.array(got, dtype=float), np.column_stack([m, d]))
    assert kept == list(np.flatnonzero((v - m).abs() < 3 * 1.4826 * d))


def test_resample_fills_empty_hours(spark):
    rows = series(spark, [(0, 60), (7200, 120), (7260, 60)])
    hourly = resample.hourly_energy(rows, ["site"])
    assert values(hourly, "kwh") == [1.0, 0.0, 3.0]
    assert values(resample.daily_energy(rows, ["site"]), "kwh") == [4.0]


def test_total_over_series(spark):
    rows = spark.createDataFrame(
        [(T0, "a", 1.0), (T0, "b", 2.0), (at(60), "b", 5.0)], "ts timestamp, series string, value double"
    )
    done = resample.total_power(rows, "series", ["a", "b"])
    assert values(done, "a", "b", "total_value") == [(1.0, 2.0, 3.0), (0.0, 5.0, 5.0)]


def test_percentiles_equal_numpy(spark, mode):
    rng = random.Random(9)
    data = [(i, rng.choice([0, 0, 0, rng.randrange(50)])) for i in range(101)]
    rows = series(spark, data).unionByName(series(spark, [(0, 4), (1, 8)], site=2))
    done = {r.site: r for r in profile.describe_series(rows, ["site"]).collect()}
    v = [x for _, x in data]
    one = done[1]
    assert [one.p25, one.p50, one.p75] == list(np.percentile(v, [25, 50, 75]))
    assert abs(one["std"] - statistics.stdev(v)) < 1e-9 and one.n == 101
    assert (done[2].p25, done[2].p50) == (5.0, 6.0)
    whole = profile.describe_series(rows, []).first()
    assert whole.p50 == np.percentile(v + [4, 8], 50)


def test_interval_statistics(spark, mode):
    row = profile.interval_stats(series(spark, [(s, 0) for s in (0, 10, 30, 90, 100)]), ["site"], seq="seq").first()
    assert tuple(row)[1:] == (25.0, 15.0, 10.0, 60.0)


def test_gaps(spark, mode):
    rows = series(spark, [(0, 1), (72000, 2), (144001, 3), (144002, 4)])
    assert values(profile.find_gaps(rows, ["site"], seq="seq"), "value") == [3]


def test_histogram_holds_the_greatest_value(spark):
    done = profile.histogram(series(spark, [(0, 0), (1, 100), (2, 99.9), (3, 1)]))
    assert done.count() == 50
    assert {r.bin: r.n for r in done.filter("n > 0").collect()} == {1: 2, 50: 2}
    flat = profile.histogram(series(spark, [(0, 3), (1, 3)]))
    assert flat.filter("n > 0").count() == 1


def test_nulls_and_copies(spark):
    rows = series(spark, [(0, 1), (0, 2), (5, 3), (5, 4), (5, 5), (9, 6)])
    assert tuple(profile.duplicate_profile(rows, ["site"]).first())[1:] == (6, 5, 2)
    holed = rows.withColumn("value", F.when(F.col("seq") > 2, F.col("value")))
    assert tuple(profile.null_profile(holed, ["value", "seq"]).first()) == ("value", 6, 3, 50.0)


def test_metrics(spark):
    rows = series(spark, [(0, 3), (1, -4)])
    row = profile.regression_metrics(rows, F.col("value")).first()
    assert (row.mae, row.rmse) == (3.5, 12.5**0.5)


def test_newest_rows_are_held_out(spark, mode):
    rows = series(spark, [(i * 7 % 101, i) for i in range(14)])
    done = splits.time_split(rows, (), seq="seq")
    assert values(done, "is_test") == [False] * 12 + [True] * 2
    per_site = splits.time_split(rows.unionByName(series(spark, [(i, i) for i in range(5)], 2)), ["site"], seq="seq")
    assert per_site.filter("is_test").groupBy("site").count().orderBy("site").collect() == [(1, 2), (2, 1)]


def test_folds_grow_in_time(spark, mode):
    done = splits.time_series_folds(series(spark, [(i, i) for i in range(20)]), 5, (), seq="seq")
    assert values(done, "fold") == [0] * 5 + [1] * 3 + [2] * 3 + [3] * 3 + [4] * 3 + [5] * 3


def test_numeric_columns(spark):
    assert profile.numeric_columns(series(spark, [(0, 1)])) == ["site", "value", "seq", "produced_at"]


def test_hot_series_is_spread_over_tasks(spark, split):
    """No task of the split gate sees much more than the row limit."""
    from sensorlab.operators.slices import SLICE, micros, plan_slices

    rows = series(spark, [(i * i % 7919, i) for i in range(900)]).unionByName(series(spark, [(1, 1)], site=2))
    with split(50):
        plan = plan_slices(rows, ["site"], micros("ts"))
        sizes = plan.assign(plan.mark_hot(rows), micros("ts")).groupBy("site", SLICE).count().collect()
    assert len(sizes) > 15 and max(r["count"] for r in sizes) <= 75
    assert sum(r["count"] for r in sizes) == 901
