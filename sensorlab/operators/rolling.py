"""Centred rolling statistics and the outlier filter built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sensorlab.operators.sets import observed_filter
from sensorlab.operators.slices import BLOCK, SlicePlan, drop_margin, row_blocks, tie_order

# Scales a mean absolute deviation to a standard deviation (fixed value).
MAD_SCALE = 1.4826


def _reach(k: int) -> tuple[int, int]:
    """Rows before and after the current one in a centred frame of ``k`` rows."""
    return k // 2, (k - 1) // 2


def _mean(column: str, w, min_periods: int) -> Column:
    return F.when(F.count(column).over(w) >= min_periods, F.avg(column).over(w))


def rolling_mean(
    df: DataFrame,
    key: Sequence[str],
    value: str = "value",
    k: int = 25,
    min_periods: int = 5,
    ts: str = "ts",
    seq: str | None = None,
    name: str = "rolling_mean",
    plan: SlicePlan | None = None,
) -> DataFrame:
    """Mean of ``k`` rows around each row; null with too few values."""
    before, after = _reach(k)
    order = tie_order(df, key, ts, seq)
    blocked = row_blocks(df, key, order, before, after, plan)
    w = Window.partitionBy(*key, BLOCK).orderBy(*order).rowsBetween(-before, after)
    return drop_margin(blocked.withColumn(name, _mean(value, w, min_periods)))


def rolling_mad(
    df: DataFrame,
    key: Sequence[str],
    value: str = "value",
    k: int = 25,
    min_periods: int = 5,
    ts: str = "ts",
    seq: str | None = None,
    plan: SlicePlan | None = None,
) -> DataFrame:
    """Adds ``rolling_mean`` and ``rolling_mad``, the rolling mean of the
    absolute deviation from it. The second window sees first-window results up
    to one frame away, so blocks get a margin of two frames."""
    before, after = _reach(k)
    order = tie_order(df, key, ts, seq)
    blocked = row_blocks(df, key, order, 2 * before, 2 * after, plan)
    w = Window.partitionBy(*key, BLOCK).orderBy(*order).rowsBetween(-before, after)
    first = blocked.withColumn("rolling_mean", _mean(value, w, min_periods)).withColumn(
        "_off", F.abs(F.col(value) - F.col("rolling_mean"))
    )
    return drop_margin(first.withColumn("rolling_mad", _mean("_off", w, min_periods))).drop("_off")


def mad_filter(
    df: DataFrame,
    key: Sequence[str],
    value: str = "value",
    k: int = 25,
    min_periods: int = 5,
    n_sigma: float = 3,
    ts: str = "ts",
    seq: str | None = None,
    plan: SlicePlan | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Keep rows strictly closer to the rolling mean than ``n_sigma`` scaled
    deviations; rows without statistics, and flat stretches, are dropped.
    ``observation`` counts the rows that come in and stay."""
    stats = rolling_mad(df, key, value, k, min_periods, ts, seq, plan)
    off = F.abs(F.col(value) - F.col("rolling_mean"))
    return observed_filter(stats, off < F.lit(n_sigma * MAD_SCALE) * F.col("rolling_mad"), observation).select(*df.columns)
