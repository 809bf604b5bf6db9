"""Hourly and daily sums on a dense time grid, and totals over series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEP = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}


def resample(
    df: DataFrame,
    key: Sequence[str],
    unit: str = "hour",
    ts: str = "ts",
    value: Column | str = "value",
    scale: float = 1.0,
    name: str = "value",
) -> DataFrame:
    """Sum per unit for every unit between the first and last one of a series.

    Units without rows get 0. The readings are aggregated once; the holes are
    then filled on the far smaller result, from each unit to the next one.
    """
    value = F.col(value) if isinstance(value, str) else value
    step = F.expr(_STEP[unit])
    sums = df.groupBy(*key, F.date_trunc(unit, ts).alias(ts)).agg(F.sum(value).alias("_sum"))
    following = F.lead(ts).over(Window.partitionBy(*key).orderBy(ts))
    until = F.coalesce(following - step, F.col(ts))
    filled = sums.withColumn("_until", until).withColumn(
        "_unit", F.explode(F.sequence(F.col(ts), F.col("_until"), step))
    )
    real = F.col("_unit") == F.col(ts)
    total = F.when(real, F.coalesce(F.col("_sum").cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
    return filled.select(*key, F.col("_unit").alias(ts), (total / F.lit(scale)).alias(name))


def hourly_energy(df, key, ts="ts", value="value") -> DataFrame:
    """kWh per hour from one power sample (kW) per minute."""
    return resample(df, key, "hour", ts, value, scale=60.0, name="kwh")


def daily_energy(df, key, ts="ts", value="value") -> DataFrame:
    """kWh per day, summed from the hourly result."""
    return resample(hourly_energy(df, key, ts, value), key, "day", ts, "kwh", name="kwh")


def date_hour_sum(df, key, ts="ts", value: Column | str = "value", name="value") -> DataFrame:
    """Sum per (date, hour), with the start of the hour rebuilt as a time."""
    value = F.col(value) if isinstance(value, str) else value
    day, hour = F.to_date(ts), F.hour(ts)
    grouped = df.groupBy(*key, day.alias("date"), hour.alias("hour")).agg(F.sum(value).alias(name))
    rebuilt = F.make_timestamp(
        F.year("date"), F.month("date"), F.day("date"), "hour", F.lit(0), F.lit(0).cast("double")
    )
    return grouped.withColumn("hour_ts", rebuilt)


def total_power(
    df: DataFrame,
    series: str,
    names: Sequence[str],
    key: Sequence[str] = (),
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """One row per time with a column per series (0 if absent) and their total.

    One aggregate instead of a join per series; ``names`` is the catalog's list.
    """
    parts = [
        F.coalesce(F.sum(F.when(F.col(series) == n, F.col(value))), F.lit(0)).alias(n) for n in names
    ]
    wide = df.filter(F.col(series).isin(*names)).groupBy(*key, ts).agg(*parts)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return wide.withColumn("total_value", total)
