import pandas as pd
import pytest
from helpers import at, series, values
from pyspark.sql import functions as F

from sensorlab.operators.asof import asof_correct, asof_join, impute_two_sided, match_and_impute


def corrected(spark, device, meteo):
    done = asof_correct(series(spark, device), series(spark, meteo), ["site"], seq="seq")
    return values(done, "suggested_temperature", "time_difference", "meteo_used", "produced_at_meteo")


@pytest.mark.parametrize(
    "device, meteo, expected",
    [
        ((0, 5), [], (5, 0, False, 0)),
        ((100, 5), [(100, 6)], (6, 0, True, 1.5)),
        ((1200, 5), [(0, 6)], (6, 1200, True, 1.5)),
        ((1201, 5), [(0, 6)], (5, 1201, False, 0)),
        ((0, 5), [(1, 6)], (5, 0, False, 0)),
    ],
)
def test_correction_edges(spark, mode, device, meteo, expected):
    assert [tuple(r) for r in corrected(spark, [device], meteo)] == [expected]


def test_device_rows_of_one_millisecond_count_once(spark, mode):
    done = corrected(spark, [(1.0001, 5), (1.0002, 7), (1.5, 8)], [])
    assert [r[0] for r in done] == [7, 8]


def test_equal_station_times_take_the_last(spark, mode):
    assert corrected(spark, [(10, 5)], [(10, 1), (10, 2)])[0][0] == 2


def joined(spark, left, right, direction, tolerance=None):
    done = asof_join(
        series(spark, [(s, 0) for s in left]),
        series(spark, right).withColumnRenamed("value", "found"),
        ["site"],
        ["found"],
        seq="seq",
        direction=direction,
        tolerance_seconds=tolerance,
    )
    return values(done, "found")


def test_nearest_tie_takes_the_earlier(spark, mode):
    assert joined(spark, [100], [(90, 1), (110, 2)], "nearest") == [1]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_directions_equal_pandas(spark, mode, direction):
    left = [0, 7, 50, 50, 51, 120, 300, 1000]
    right = [(3, 1), (50, 2), (50, 3), (60, 4), (119, 5), (180, 6), (420, 7)]
    expected = pd.merge_asof(
        pd.DataFrame({"t": [at(s) for s in left]}),
        pd.DataFrame({"t": [at(s) for s, _ in right], "v": [float(v) for _, v in right]}),
        on="t",
        direction=direction,
        tolerance=pd.Timedelta(seconds=120),
    )["v"]
    got = joined(spark, left, right, direction, 120)
    assert got == [None if pd.isna(v) else v for v in expected]


def test_key_is_respected_and_missing_key_matches_itself(spark, mode):
    left = series(spark, [(10, 0)]).withColumn("site", F.lit(None).cast("long"))
    right = series(spark, [(5, 3)]).withColumn("site", F.lit(None).cast("long"))
    other = series(spark, [(9, 4)], site=2)
    done = asof_join(left, right.unionByName(other), ["site"], ["value"], seq="seq")
    assert done.count() == 1


def test_hot_series_equals_brute_force(spark, split):
    left = [(i * 37 % 5000, i) for i in range(400)]
    right = [(i * 91 % 5000, i) for i in range(300)]
    with split(20):
        got = joined(spark, [s for s, _ in left], right, "backward")
    ordered = sorted(((s, i, v) for i, (s, v) in enumerate(right)))
    expected = []
    for _, s in sorted((s, i) for i, (s, _) in enumerate(left)):
        pass
    for s in sorted(s for s, _ in left):
        before = [v for t, _, v in ordered if t <= s]
        expected.append(float(before[-1]) if before else None)
    assert got == expected


def test_imputation_needs_both_sides(spark, mode):
    rows = series(spark, [(100, 0)]).withColumn("value", F.lit(None).cast("double"))

    def filled(right):
        return values(impute_two_sided(rows, series(spark, right), ["site"], "value", seq="seq", gap_seconds=60), "value")

    assert filled([(50, 2), (150, 4)]) == [3.0]
    assert filled([(50, 2)]) == [None]
    assert filled([(50, 2), (161, 4)]) == [None]


def test_imputation_keeps_rows_of_equal_time(spark, mode):
    rows = series(spark, [(100, 0), (100, 1)]).withColumn("value", F.lit(None).cast("double"))
    done = impute_two_sided(rows, series(spark, [(90, 1), (110, 3)]), ["site"], "value", seq="seq")
    assert values(done, "value") == [2.0, 2.0]


def test_match_and_impute_is_both_steps(spark, mode):
    left = series(spark, [(s, 0) for s in (0, 100, 4000, 5000, 9000)])
    right = series(spark, [(90, 1), (3000, 2), (6000, 4), (20000, 9)])
    one = match_and_impute(left, right, ["site"], seq="seq", tolerance_seconds=60, gap_seconds=2000)
    nearest = asof_join(
        left, right.withColumnRenamed("value", "outdoor_temperature"), ["site"], ["outdoor_temperature"],
        seq="seq", direction="nearest", tolerance_seconds=60,
    )
    two = impute_two_sided(nearest, right, ["site"], "outdoor_temperature", seq="seq", gap_seconds=2000)
    assert values(one, "outdoor_temperature") == values(two, "outdoor_temperature") == [None, 1, 3, 3, None]
