import random

from helpers import at, base_rows, pump_rows, series, values
from pyspark.sql import functions as F

from sensorlab.operators.features import (
    Feature,
    exact_join,
    fused_features,
    lag_features,
    latest_values,
    rolling_features,
    window_features,
)
from sensorlab.operators.slices import micros, plan_slices


def features(spark, base, rows, stat="mean", **options):
    return window_features(
        base_rows(spark, base), pump_rows(spark, rows), ["site"], "prikon", stat, seq="seq", **options
    )


def test_window_mean_includes_its_lower_edge(spark, mode):
    done = features(spark, [300], [(0, "prikon", 0, 4), (-1, "prikon", 0, 100), (10, "prikon", 1, 3)])
    assert values(done, "prikon_tc0", "prikon_tc1", "prikon_tc2") == [(4.0, 3.0, 0.0)]


def test_window_mean_leaves_out_later_and_unknown(spark, mode):
    done = features(spark, [300], [(301, "prikon", 0, 4), (300, "prikon", 0, 2), (300, "tl", 0, 50)])
    assert values(done, "prikon_tc0") == [2.0]


def test_window_rate(spark, mode):
    done = features(spark, [300], [(0, "prikon", 0, 2), (100, "prikon", 0, 4), (100, "prikon", 1, 4)], "rate")
    assert values(done, "prikon_tc0_rate", "prikon_tc0_value", "prikon_tc0_n") == [(0.02, 2.0, 2)]
    assert values(done, "prikon_tc1_rate", "prikon_tc1_value", "prikon_tc1_n") == [(0.0, 0.0, 1)]


def test_rate_of_equal_times_is_none(spark, mode):
    done = features(spark, [300], [(100, "prikon", 0, 2), (100, "prikon", 0, 4)], "rate")
    assert values(done, "prikon_tc0_rate", "prikon_tc0_value") == [(0.0, 0.0)]


def test_carry_forward_per_pump(spark, mode):
    rows = [(100, "prikon", 0, 4), (150, "prikon", 1, 7)]
    done = features(spark, [300, 1000], rows, "rate", carry_forward=True)
    assert values(done, "prikon_tc0_value") == [4.0, 4.0]
    assert values(done, "prikon_tc1_value", "prikon_tc2_value") == [(7.0, 0.0), (7.0, 0.0)]


def test_latest_value(spark, mode):
    rows = pump_rows(spark, [(0, "fanh", 0, 3), (500, "fanh", 0, 8), (2000, "fanh", 0, 9)])
    done = latest_values(base_rows(spark, [-5, 1000, 1500, 5000]), rows, ["site"], seq="seq")
    assert values(done, "fanh_tc0") == [0.0, 3.0 + 5, 8.0, 9.0]


def brute(base, rows, width):
    out = []
    for b in sorted(base):
        row = {}
        for p in range(4):
            for q in ("prikon", "tl", "fanh"):
                seen = sorted((s, i, v) for i, (s, qq, pp, v) in enumerate(rows) if (qq, pp) == (q, p) and s <= b)
                inside = [r for r in seen if r[0] >= b - width]
                row[q, p] = (seen, inside)
        out.append(row)
    return out


def check_against_brute(done, base, rows, width):
    columns = [f"prikon_tc{p}" for p in range(4)]
    columns += [f"tl_tc{p}_{x}" for p in range(4) for x in ("rate", "value", "n")]
    columns += [f"fanh_tc{p}" for p in range(4)]
    got = done.orderBy("ts", "seq").select(*columns).collect()
    assert len(got) == len(base)
    for row, want in zip(got, brute(base, rows, width)):
        for p in range(4):
            inside = [v for _, _, v in want["prikon", p][1]]
            assert abs(row[f"prikon_tc{p}"] - (sum(inside) / len(inside) if inside else 0.0)) < 1e-8
            seen, inside = want["tl", p]
            rate, value = 0.0, float(seen[-1][2]) if seen else 0.0
            if len(inside) > 1 and inside[-1][0] > inside[0][0]:
                rate = (inside[-1][2] - inside[0][2]) / (inside[-1][0] - inside[0][0])
                value = inside[0][2]
            assert abs(row[f"tl_tc{p}_rate"] - rate) < 1e-9
            assert row[f"tl_tc{p}_value"] == value
            assert row[f"tl_tc{p}_n"] == len(inside)
            seen = want["fanh", p][0]
            assert row[f"fanh_tc{p}"] == (float(seen[-1][2]) if seen else 0.0)


ALL = [Feature("prikon", "mean"), Feature("tl", "rate", carry_forward=True), Feature("fanh", "latest")]


def random_rows(n, span, seed):
    rng = random.Random(seed)
    kinds = ["prikon", "tl", "fanh"]
    return [(rng.randrange(span), rng.choice(kinds), rng.choice([0, 0, 0, 1, 2]), rng.randrange(100) / 4) for _ in range(n)]


def test_fused_equals_brute_force(spark):
    rows, base = random_rows(500, 4000, 1), list(range(0, 4500, 61))
    done = fused_features(base_rows(spark, base), pump_rows(spark, rows), ["site"], ALL, seq="seq", window_seconds=300)
    check_against_brute(done, base, rows, 300)


def test_split_series_equals_brute_force(spark, split):
    rows, base = random_rows(600, 9000, 2), list(range(0, 9500, 97))
    with split(40):
        done = fused_features(
            base_rows(spark, base), pump_rows(spark, rows), ["site"], ALL, seq="seq", window_seconds=300
        )
        check_against_brute(done, base, rows, 300)


def test_split_readings_are_made_once(spark, split):
    """However many passes follow, what the readings come from runs once."""
    rows, base = random_rows(200, 4000, 4), list(range(0, 4500, 500))
    read, first = pump_rows(spark, rows).coalesce(2), base_rows(spark, base)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    with split(50):
        plan = plan_slices(read.select("site", "ts").unionByName(first.select("site", "ts")), ["site"], micros("ts"))
        done = fused_features(first, read.mapInArrow(counted, read.schema), ["site"], ALL, seq="seq", window_seconds=300, plan=plan)
        check_against_brute(done, base, rows, 300)
    assert not plan.single and made.value == len(rows)


def test_dense_readings_in_one_window(spark, split):
    """All readings within one window: slices are at least a window wide."""
    rows, base = random_rows(800, 200, 3), list(range(0, 200, 7))
    with split(50):
        done = fused_features(
            base_rows(spark, base), pump_rows(spark, rows), ["site"], ALL, seq="seq", window_seconds=300
        )
        check_against_brute(done, base, rows, 300)


def test_exact_join_pairs_each_time_once(spark):
    left = series(spark, [(0, 1), (0, 2), (60, 3)]).select("site", "ts", "seq", "value")
    right = series(spark, [(0, 10), (0, 20), (90, 30)]).select("site", "ts", "seq", F.col("value").alias("other"))
    done = exact_join(left, right, ["site"], seq="seq")
    assert values(done, "value", "other") == [(1.0, 10.0)]


def test_rolling_feature_needs_a_full_window(spark, mode):
    done = rolling_features(series(spark, [(i, i) for i in range(4)]), ["site"], ["value"], windows=(3,), seq="seq")
    assert values(done, "value_roll3_mean") == [None, None, None, 1.0]


def test_lags_over_slices(spark, split):
    rows = [(i * 10, i) for i in range(100)]
    with split(9):
        done = lag_features(series(spark, rows), ["site"], ["value", "absent"], seq="seq")
        got = values(done, "value_lag1", "value_lag2", "value_roll3_mean", "value_roll6_mean")
    for i, row in enumerate(got):
        assert row[0] == (i - 1 if i >= 1 else None) and row[1] == (i - 2 if i >= 2 else None)
        assert row[2] == (i - 2 if i >= 3 else None) and row[3] == (i - 3.5 if i >= 6 else None)


def test_incomplete_rows_can_be_dropped(spark, mode):
    done = lag_features(series(spark, [(i, i) for i in range(9)]), ["site"], ["value"], seq="seq", drop_incomplete=True)
    assert done.count() == 3 and at(6) == values(done, "ts")[0]
