"""Chronological hold-out and expanding-window folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.operators.slices import number_rows, tie_order


def time_split(
    df: DataFrame,
    key: Sequence[str] = (),
    ts: str = "ts",
    seq: str | None = None,
    test_fraction: float = 0.2,
    name: str = "is_test",
) -> DataFrame:
    """Mark the newest ``int(test_fraction * n)`` rows of each series as test."""
    placed = number_rows(df, key, tie_order(df, key, ts, seq), "_row", total="_size")
    held_out = F.floor(F.col("_size") * F.lit(test_fraction))
    return placed.withColumn(name, F.col("_row") >= F.col("_size") - held_out).drop("_row", "_size")


def time_series_folds(
    df: DataFrame,
    n_splits: int = 5,
    key: Sequence[str] = (),
    ts: str = "ts",
    seq: str | None = None,
    name: str = "fold",
) -> DataFrame:
    """Number the validation folds ``1..n_splits`` in time order.

    A fold holds ``n // (n_splits + 1)`` rows; fold 0 is what comes before the
    first. Split ``i`` trains on all rows with a lower number than ``i``.
    """
    placed = number_rows(df, key, tie_order(df, key, ts, seq), "_row", total="_size")
    size = F.floor(F.col("_size") / (n_splits + 1))
    into = F.col("_row") - (F.col("_size") - n_splits * size)
    fold = F.when(into < 0, F.lit(0)).otherwise(F.floor(into / size) + 1).cast("int")
    return placed.withColumn(name, fold).drop("_row", "_size")
