"""Union, de-duplication and distinct times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sensorlab.operators.slices import (
    HOT,
    SLICE,
    micros,
    order_number,
    plan_slices,
    tie_order,
)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all inputs, copies kept; missing columns become null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def dedup_first(
    df: DataFrame, key: Sequence[str], ts: str = "ts", seq: str | None = None
) -> DataFrame:
    """First arrival of each (series, time).

    Catalyst turns ``row_number() = 1`` into a limit per group that already
    runs before the exchange, so a large group of copies never travels.
    """
    order = tie_order(df, [*key, ts], ts, seq)[1:] or [ts]
    w = Window.partitionBy(*key, ts).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merge_first(
    tables: Sequence[DataFrame], key: Sequence[str], ts: str = "ts", seq: str | None = None
) -> DataFrame:
    """Concatenate tables; per (series, time) the row of the first table stays."""
    marked = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    rows = union_all(*marked)
    order = ["_table", *tie_order(rows.drop("_table"), [*key, ts], ts, seq)[1:]]
    w = Window.partitionBy(*key, ts).orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_table")
    )


def keep_unique(df: DataFrame, key: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows whose (series, time) occurs once; all members of larger groups go.

    Written as an aggregate, which shrinks groups of copies before the exchange.
    """
    others = [c for c in df.columns if c not in {*key, ts}]
    row = F.struct(*others) if others else F.struct(F.lit(1).alias("one"))
    once = (
        df.groupBy(*key, ts)
        .agg(F.count("*").alias("_n"), F.min(row).alias("_row"))
        .filter("_n = 1")
    )
    return once.select(*[F.col(f"_row.{c}").alias(c) if c in others else F.col(c) for c in df.columns])


def observed_filter(df: DataFrame, keep: Column, observation: Observation | None = None) -> DataFrame:
    """The rows to keep; ``observation`` gets ``n_rows`` and ``n_kept`` as they pass, without a second look."""
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("n_rows"), F.count_if(keep).alias("n_kept"))
    return df.filter(keep)


def distinct_times(df: DataFrame, key: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return df.select(*key, ts).distinct()


def drop_late(
    df: DataFrame, key: Sequence[str], arrival: str, ts: str = "ts", delay_seconds: float = 0
) -> DataFrame:
    """Drop rows older than the watermark when they arrived.

    The watermark of a series is the greatest time of all earlier arrivals
    minus the delay. The streaming jobs get the same from ``withWatermark``.
    """
    rows = df.withColumn("_us", micros(ts))
    at = order_number(rows, arrival)
    plan = plan_slices(rows, key, at)
    sliced = plan.assign(plan.mark_hot(rows), at).withColumn("_first", F.lit(1))
    earlier = Window.partitionBy(*plan.group).orderBy("_first", arrival)
    if not plan.single:
        by_slice = Window.partitionBy(*plan.key).orderBy(SLICE)
        tops = (
            sliced.filter(HOT)
            .groupBy(*plan.group)
            .agg(F.max("_us").alias("_us"))
            .select(
                *plan.group,
                F.max("_us").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("_us"),
            )
            .withColumn("_first", F.lit(0))
        )
        sliced = sliced.unionByName(tops, allowMissingColumns=True)
    top = F.max("_us").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    kept = sliced.withColumn("_top", top).filter(
        (F.col("_first") == 1)
        & (F.col("_top").isNull() | (F.col("_us") >= F.col("_top") - F.lit(int(delay_seconds * 1e6))))
    )
    return kept.select(*df.columns)
