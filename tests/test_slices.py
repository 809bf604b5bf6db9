"""Slices hold at most the limit whatever the distribution; windows copy no readings."""

import random

import pytest
from helpers import base_rows, pump_rows, series, values
from pyspark.sql import functions as F

from sensorlab.operators import features
from sensorlab.operators.asof import asof_join
from sensorlab.operators.features import Feature, fused_features
from sensorlab.operators.gate import rate_gate
from sensorlab.operators.slices import SLICE, micros, number_rows, plan_slices

LIMIT = 50


def sizes(df, *by, key=("site",)):
    """Rows per slice; slices must follow the order of the numbers."""
    plan = plan_slices(df, key, *by)
    rows = plan.assign(plan.mark_hot(df), *by)
    ends = rows.groupBy(*key, SLICE).agg(F.count("*").alias("n"), F.min(F.struct(*by)).alias("low"), F.max(F.struct(*by)).alias("high"))
    found = ends.orderBy(*key, SLICE).collect()
    for a, b in zip(found, found[1:], strict=False):
        if all(a[k] == b[k] for k in key):
            assert tuple(a["high"]) <= tuple(b["low"])
    return [r["n"] for r in found]


def times(spark, seconds):
    return spark.createDataFrame([(1, s, i) for i, s in enumerate(seconds)], "site long, t double, seq long").withColumn(
        "ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))
    )


def numbers(spark, found):
    return spark.createDataFrame([(1, float(v)) for v in found], "site long, v double")


NOW = 1.75e9


@pytest.mark.parametrize(
    "seconds",
    [
        [NOW + i for i in range(2000)] + [0.0],
        [NOW + i for i in range(2000)] + [0.0, 4e9, -2e9],
        [NOW + 1.5**i for i in range(30)] * 20 + [NOW + i * 1e-6 for i in range(1000)],
        [NOW + (i if i < 1900 else i * 10_000) for i in range(2000)],
    ],
    ids=["epoch zero", "outliers on both sides", "dense start", "sparse end"],
)
def test_outlying_times(spark, split, seconds):
    with split(LIMIT):
        found = sizes(times(spark, seconds), micros("ts"), F.col("seq"))
    assert sum(found) == len(seconds) and max(found) <= LIMIT
    assert len(found) <= 4 * len(seconds) / LIMIT


@pytest.mark.parametrize(
    "found",
    [
        list(range(2000)) + [1e12],
        [10.0**e for e in range(-200, 200)] + [-(10.0**e) for e in range(-200, 200)],
        list(map(random.Random(1).lognormvariate, [0] * 2000, [40] * 2000)) + [float("inf"), float("-inf"), float("nan")],
        [5e-324 * i for i in range(500)] + [1.7e308, -1.7e308],
    ],
    ids=["one large value", "all magnitudes", "heavy tail", "smallest numbers"],
)
def test_outlying_values(spark, split, found):
    with split(LIMIT):
        n = sizes(numbers(spark, found), F.col("v"))
    assert sum(n) == len(found) and max(n) <= LIMIT


def test_one_instant_is_split_by_arrival(spark, split):
    with split(LIMIT):
        found = sizes(times(spark, [NOW] * 1000 + [NOW + 1 + i for i in range(30)]), micros("ts"), F.col("seq"))
        same = sizes(times(spark, [NOW] * 1000), micros("ts"))
    assert sum(found) == 1030 and max(found) <= LIMIT
    assert same == [1000]  # nothing tells the rows apart


@pytest.mark.parametrize("limit", [1, 3])
def test_small_limits(spark, split, limit):
    rng = random.Random(limit)
    with split(limit):
        found = sizes(times(spark, [NOW + rng.randrange(60) for _ in range(120)]), micros("ts"), F.col("seq"))
    assert sum(found) == 120 and max(found) <= limit


def test_null_key_and_no_key(spark, split):
    df = times(spark, [NOW + i for i in range(200)])
    with split(LIMIT):
        assert max(sizes(df.withColumn("site", F.lit(None).cast("long")), micros("ts"))) <= LIMIT
        assert max(sizes(df, micros("ts"), key=())) <= LIMIT
        empty = plan_slices(df.filter("false"), ["site"], micros("ts"))
        assert empty.single and plan_slices(df.filter("false"), [], micros("ts")).single


def test_planning_writes_nothing_if_nothing_is_split(spark, monkeypatch):
    from sensorlab.operators import slices

    monkeypatch.setattr(slices, "stored", None)
    assert plan_slices(times(spark, [NOW, NOW + 1]), ["site"], micros("ts")).single


def test_row_numbers_within_an_instant(spark, split):
    df = times(spark, [NOW] * 300 + [0.0] + [NOW + 1] * 100)
    with split(LIMIT):
        found = values(number_rows(df, ["site"], ["ts", "seq"], total="n"), "seq", "_row", "n")
    assert found == [(seq, i, 401) for i, seq in enumerate([300, *range(300), *range(301, 401)])]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_neighbours_at_a_split_instant(spark, split, direction):
    """Of 200 readings at one time, backward finds the last arrival and forward the first, in whatever slice they are."""
    right = series(spark, [(-5, -1)] + [(0, i) for i in range(200)] + [(7, 900)])
    left = series(spark, [(0, 0)] * 120 + [(1, 0), (6, 0), (-4, 0)]).select("site", "ts", "seq")
    whole = values(asof_join(left, right, ["site"], ["value"], seq="seq", direction=direction), "seq", "value")
    with split(20):
        assert values(asof_join(left, right, ["site"], ["value"], seq="seq", direction=direction), "seq", "value") == whole
    assert dict(whole)[0] == (0 if direction == "forward" else 199)


def test_gate_within_an_instant_and_with_an_outlier(spark, split):
    rng = random.Random(5)
    rows = [(-1.7e9, 3.0)] + [(60 * (i // 40), rng.gauss(0, 3)) for i in range(400)]
    df = series(spark, rows)
    whole = values(rate_gate(df, ["site"], seq="seq"), "seq", "gated_value", "rejected")
    with split(30):
        assert values(rate_gate(df, ["site"], seq="seq"), "seq", "gated_value", "rejected") == whole


ALL = [Feature("prikon", "mean"), Feature("fanh", "latest"), Feature("tl", "rate", True)]


def mixed(spark, n=400, sites=(1, 2)):
    rng = random.Random(8)
    rows = [(rng.choice([0, 0, rng.randrange(3000)]), rng.choice(["prikon", "fanh", "tl"]), rng.randrange(4), rng.uniform(0, 9)) for _ in range(n)]
    read = pump_rows(spark, rows, sites[0]).unionByName(pump_rows(spark, rows[:9], sites[1]))
    base = base_rows(spark, [rng.choice([0, 300, rng.randrange(4000)]) for _ in range(90)])
    return base.unionByName(base_rows(spark, [0, 5, 900], sites[1])), read


@pytest.mark.parametrize(("window", "limit"), [(1, 60), (300, 10), (10**6, 60)])
def test_split_features_equal_whole_ones(spark, split, window, limit):
    base, read = mixed(spark)

    def run():
        done = fused_features(base, read, ["site"], ALL, seq="seq", window_seconds=window)
        return values(done, *[c for c in done.columns if c != "ts"], order=("site", "ts", "seq"))

    whole = run()
    with split(limit):
        for a, b in zip(run(), whole, strict=True):
            assert a == pytest.approx(b)


def test_a_long_window_places_no_reading_twice(spark, split, monkeypatch):
    """A window as long as the series: two rows more for each (slice, channel), none for the window."""
    rows = [(i, "prikon", i % 2, float(i)) for i in range(2000)]
    placed = []
    states = features._channel_states

    def counted(df, plan, stats):
        placed.append((df.filter(~F.col("_base")).count(), df.filter("_base").count(), plan.every_slice().count()))
        return states(df, plan, stats)

    monkeypatch.setattr(features, "_channel_states", counted)
    base = base_rows(spark, list(range(0, 2000, 10)))
    with split(LIMIT):
        done = fused_features(base, pump_rows(spark, rows), ["site"], [Feature("prikon", "mean")], seq="seq", window_seconds=2000, pumps=(0, 1))
        assert values(done, "prikon_tc0", "prikon_tc1")[-1] == (995.0, 995.0)
    assert len(placed) == 2
    for readings, rows_, slices in placed:
        assert rows_ == 200
        assert slices >= 2200 / LIMIT and readings <= 2000 + 2 * 2 * slices


def test_a_station_time_far_off(spark, split):
    """One wrong clock changes no result of a split as-of join."""
    left = series(spark, [(i, 0) for i in range(300)]).select("site", "ts", "seq")
    right = series(spark, [(i + 0.5, i) for i in range(300)] + [(-1.7e9, -1)])
    whole = values(asof_join(left, right, ["site"], ["value"], seq="seq"), "value")
    with split(25):
        assert values(asof_join(left, right, ["site"], ["value"], seq="seq"), "value") == whole
    assert whole[:3] == [-1, 0, 1]
