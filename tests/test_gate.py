import random

import numpy as np
import pytest
from helpers import series, values
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorlab.operators.gate import fold_gate, gate_report, rate_gate


def by_hand(us, v, limit, reset_us=None):
    """The rule row by row."""
    out, held = [], None
    for i in range(len(us)):
        if held is None:
            held = i
        else:
            gap = abs(us[i] - us[held])
            ok = gap == 0 or abs((v[i] - v[held]) / (gap / 1e6 / 60.0)) <= limit
            if ok or (reset_us is not None and gap > reset_us):
                held = i
        out.append(held)
    return out


@given(
    st.lists(st.tuples(st.integers(0, 300), st.integers(-40, 40)), max_size=80),
    st.sampled_from([None, 120_000_000]),
)
@settings(max_examples=300, deadline=None)
def test_fold_equals_rule(rows, reset_us):
    rows.sort(key=lambda r: r[0])
    us = np.array([r[0] * 1_000_000 for r in rows], dtype="int64")
    v = np.array([r[1] / 2 for r in rows], dtype="float64")
    stands = fold_gate(us, v, 1.5, reset_us)
    assert stands.tolist() == by_hand(us, v, 1.5, reset_us)


def test_boundary_rate_is_accepted(spark, mode):
    done = rate_gate(series(spark, [(0, 10.0), (60, 11.5), (120, 13.0625)]), ["site"], seq="seq", max_rate=1.5)
    assert values(done, "gated_value", "rejected") == [(10.0, False), (11.5, False), (11.5, True)]


def test_reject_then_recover(spark, mode):
    done = rate_gate(series(spark, [(0, 10), (60, 20), (900, 20)]), ["site"], seq="seq")
    assert values(done, "gated_value") == [10, 10, 20]
    assert gate_report(done, ["site"]).select("n", "n_rejected").first() == (3, 1)


def test_same_time_is_accepted(spark, mode):
    done = rate_gate(series(spark, [(0, 10), (0, 99)]), ["site"], seq="seq")
    assert values(done, "gated_value") == [10, 99]


def test_reset_after_a_long_silence(spark, mode):
    rows = series(spark, [(0, 10), (60, 500), (601, 500)])
    assert values(rate_gate(rows, ["site"], seq="seq"), "gated_value") == [10, 10, 10]
    done = rate_gate(rows, ["site"], seq="seq", reset_after_seconds=600)
    assert values(done, "gated_value") == [10, 10, 500]


@pytest.mark.parametrize("jump", [3, 400])
def test_split_series_equals_rule(spark, split, jump):
    """A series cut into many slices; with large jumps a rejection lasts over slices."""
    rng = random.Random(jump)
    rows, value = [], 0.0
    for i in range(600):
        value = value + rng.choice([-1, 0, 1]) if rng.random() < 0.9 else rng.uniform(-jump, jump)
        rows.append((i * 20, round(value, 1)))
    with split(15):
        done = rate_gate(series(spark, rows).unionByName(series(spark, rows[:10], site=2)), ["site"], seq="seq")
        got = values(done.filter("site = 1"), "gated_value")
        assert done.filter("site = 2").count() == 10
    us = np.array([r[0] * 1_000_000 for r in rows])
    v = np.array([r[1] for r in rows])
    assert got == [v[i] for i in by_hand(us, v, 1.6)]


def test_one_value_all_others_rejected_over_all_slices(spark, split):
    rows = [(0, 0.0)] + [(i, 1e6 + i * i) for i in range(1, 100)]
    with split(10):
        done = rate_gate(series(spark, rows), ["site"], seq="seq")
        assert set(values(done, "gated_value")) == {0.0}


def test_series_without_key_value_is_one_series(spark, split):
    rows = series(spark, [(i * 60, i % 2 * 5) for i in range(40)]).selectExpr(
        "cast(null as long) site", "ts", "value", "seq", "produced_at"
    )
    with split(6):
        done = rate_gate(rows, ["site"], seq="seq")
        assert set(values(done, "gated_value")) == {0.0, 5.0} or done.count() == 40
        assert done.count() == 40
