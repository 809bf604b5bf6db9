"""Nulls, NaN, single readings, extreme values and uneven series."""

import pytest
from helpers import at, base_rows, pump_rows, series, values
from pyspark.sql import functions as F

from sensorlab.functions.wire import parse_time
from sensorlab.operators import profile
from sensorlab.operators.asof import asof_join
from sensorlab.operators.features import Feature, fused_features
from sensorlab.operators.gate import rate_gate
from sensorlab.operators.slices import micros, plan_slices
from sensorlab.sources import catalog


def test_a_series_with_one_reading_has_statistics(spark):
    df = series(spark, [(0, 1), (10, 2)]).union(series(spark, [(5, 3)], site=2))
    found = profile.interval_stats(df, ["site"]).orderBy("site").collect()
    assert [(r["site"], r["mean_interval"], r["median_interval"]) for r in found] == [(1, 10.0, 10.0), (2, None, None)]


def test_histogram_ignores_what_is_not_finite(spark):
    df = series(spark, [(0, 0), (1, 1), (2, 10), (3, float("nan")), (4, float("inf"))])
    found = values(profile.histogram(df, bins=10), "bin", "n", order=("bin",))
    assert found == [(1, 1), (2, 1)] + [(b, 0) for b in range(3, 10)] + [(10, 1)]


def test_zoneless_time_is_utc_in_any_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Prague")
    try:
        texts = spark.createDataFrame([("2025-01-01T00:00:00",), ("2025-01-01",), ("2025-01-01T02:00:00+02:00",)], "t string")
        assert {r[0] for r in texts.select(F.unix_seconds(parse_time(F.col("t")))).collect()} == {1735689600}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_a_row_without_time_has_no_neighbour(spark, direction):
    left = spark.createDataFrame([(1, None, 0), (1, at(5), 1)], "site long, ts timestamp, seq long")
    right = series(spark, [(4, 1), (6, 2)]).select("site", "ts", "value")
    done = asof_join(left, right, ["site"], ["value"], direction=direction)
    assert done.filter("ts is null").select("value").first()[0] is None
    assert done.filter("ts is not null").select("value").first()[0] is not None


@pytest.mark.parametrize("rows_per_slice", [2, 1000])
def test_the_gate_lets_missing_values_pass(spark, split, rows_per_slice):
    rows = [(0, float("nan")), (60, 1), (120, 2), (180, 50), (240, float("nan")), (300, 3)]
    with split(rows_per_slice):
        found = values(rate_gate(series(spark, rows), ["site"]), "gated_value", "rejected")
    assert [str(v) for v, _ in found] == ["nan", "1.0", "2.0", "2.0", "nan", "3.0"]
    assert [r for _, r in found] == [False, False, False, True, False, False]


@pytest.mark.parametrize(("a", "b", "mean"), [(4e18, 2e18, 3e18), (2e-10, 4e-10, 3e-10)])
def test_means_of_very_large_and_small_values(spark, a, b, mean):
    read = pump_rows(spark, [(0, "tl", 0, a), (1, "tl", 0, b)])
    done = fused_features(base_rows(spark, [2]), read, ["site"], [Feature("tl", "mean")]).first().asDict()
    assert pytest.approx(mean) in [v for k, v in done.items() if "tl" in k and isinstance(v, float)]


def test_slices_follow_each_series(spark, split):
    """Series just above the limit get about two slices, one with dense and sparse times is cut by rows."""
    rows = [(s, 10_000 * s + i, i) for s in range(20) for i in range(60)] + [(99, i if i < 900 else i * 10_000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "site long, t long, seq long").withColumn("ts", F.timestamp_seconds("t"))
    with split(50):
        plan = plan_slices(df, ["site"], micros("ts"))
        sizes = plan.assign(df, micros("ts")).groupBy("site", "_slice").count()
        assert sizes.filter("site < 99").count() == 40


def test_each_sensor_has_its_own_days(spark):
    sensors = catalog.sensor_catalog(spark).withColumn("days", F.when(F.col("name") == "xcc_tcstav0_tl", 1).otherwise(5))
    points = spark.createDataFrame(
        [("°C", f"xcc_tcstav{p}_tl", at(-86400 * d), 1.0) for p in (0, 1) for d in (0.5, 3, 9)],
        "measurement string, entity_id string, time timestamp, value double",
    )
    found = catalog.extract_catalog(points, sensors, until=str(at(0))).groupBy("entity_id").count()
    assert values(found, "entity_id", "count", order=("entity_id",)) == [("xcc_tcstav0_tl", 1), ("xcc_tcstav1_tl", 2)]
