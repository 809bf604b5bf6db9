"""Profiles of series: intervals, statistics, gaps, nulls, copies, histogram."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlab.operators.slices import (
    BLOCK,
    bin_of,
    drop_margin,
    finite_number,
    histogram_of,
    micros,
    null_safe_join,
    row_blocks,
    tie_order,
)
from sensorlab.session import stored


#: So many values of one series and bin are sorted on the spot.
FEW_VALUES = 10_000


def exact_percentiles(
    df: DataFrame, key: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per series.

    All wanted ranks of all series are narrowed together: values are counted in
    histograms, and only the bins that hold a wanted rank are divided again,
    over their own range, until a bin holds one value or few enough to sort.
    Nothing is ordered as a whole, and a value far off costs a round at most.
    NaN counts as missing; series without a value have no row. Values beyond
    1e300 count as equal.
    """
    kind = df.schema[value].dataType.typeName()
    values = df.select(*key, F.col(value).alias("_x"), F.array().cast("array<int>").alias("_path")).filter(F.col("_x").isNotNull())
    if kind in ("double", "float"):
        values = values.filter(~F.isnan("_x"))
    stats = [F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")]
    spot = [*key, "_path"]
    whole = stored(values.groupBy(*spot).agg(*stats), "series")
    ranks = [f(F.lit(p) * (F.col("_n") - 1)).cast("long") for p in points.values() for f in (F.floor, F.ceil)]
    # A cell is a bin with the number of values below it; a wanted rank knows its cell.
    cells = whole.withColumn("_before", F.lit(0).cast("long"))
    wanted = whole.select(*spot, F.explode(F.array_distinct(F.array(*ranks))).alias("_rank"))
    rows, found = values, []
    while True:
        hit = null_safe_join(wanted, cells, spot)
        one = finite_number(F.col("_low")) == finite_number(F.col("_high"))
        few = ~one & (F.col("_n") <= FEW_VALUES)
        found.append(hit.filter(one).select(*key, "_rank", F.col("_low").alias("_value")))
        listed = null_safe_join(rows, hit.filter(few).select(*spot).distinct(), spot).groupBy(*spot).agg(F.array_sort(F.collect_list("_x")).alias("_list"))
        picked = null_safe_join(hit.filter(few), listed, spot)
        found.append(picked.select(*key, "_rank", F.get("_list", (F.col("_rank") - F.col("_before")).cast("int")).alias("_value")))
        many = hit.filter(~one & ~few)
        if many.isEmpty():
            break
        spec = F.struct(*histogram_of(finite_number(F.col("_low")), finite_number(F.col("_high")), F.col("_n") / FEW_VALUES)).alias("_spec")
        open_ = stored(many.select(*spot, "_before", spec).distinct(), "open")
        binned = null_safe_join(rows, open_.drop("_before"), spot)
        bin_ = bin_of(finite_number(F.col("_x")), *(F.col(f"_spec.{c}") for c in ("log", "low", "width", "bins")))
        binned = binned.withColumn("_bin", bin_).drop("_spec")
        counts = stored(binned.groupBy(*spot, "_bin").agg(*stats), "counts")
        counts = null_safe_join(counts, open_.drop("_spec"), spot)
        earlier = Window.partitionBy(*spot).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
        chosen = null_safe_join(many.select(*spot, "_rank"), counts, spot).filter(inside)
        below = F.concat("_path", F.array("_bin"))
        chosen = stored(chosen.select(*key, below.alias("_path"), "_rank", "_n", "_low", "_high", "_before"), "chosen")
        wanted, cells = chosen.select(*spot, "_rank"), chosen.drop("_rank").distinct()
        rows = null_safe_join(binned.select(*key, "_x", below.alias("_path")), chosen.select(*spot).distinct(), spot)
    known = null_safe_join(reduce(DataFrame.unionByName, found), whole.select(*key, "_n"), key)
    edges, made = [], []
    for name, p in points.items():
        at = F.lit(p) * (F.col("_n") - 1)
        for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            edges.append(F.max(F.when(F.col("_rank") == rank, F.col("_value"))).alias(f"_{end}_{name}"))
        edges.append(F.max(at - F.floor(at)).alias(f"_part_{name}"))
        low, high, part = (F.col(f"_{end}_{name}") for end in ("low", "high", "part"))
        made.append((low * (1 - part) + high * part).alias(name))
    return known.groupBy(*key).agg(*edges).select(*key, *made) if key else known.agg(*edges).filter(F.col(f"_part_{next(iter(points))}").isNotNull()).select(*made)


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe_series(df: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max per series."""
    moments = [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    order = [*key, "n", "mean", "std", "min", "p25", "p50", "p75", "max"]
    basic = df.groupBy(*key).agg(*moments)
    return with_percentiles(basic, exact_percentiles(df, key, value, QUARTILES), key).select(*order)


def with_percentiles(basic: DataFrame, percentiles: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add percentiles to the rows of all series; null for those without a value."""
    return null_safe_join(basic, percentiles, key, "left")


def with_interval(
    df: DataFrame,
    key: Sequence[str],
    ts: str = "ts",
    seq: str | None = None,
    name: str = "interval_seconds",
) -> DataFrame:
    """Seconds since the previous row of the series."""
    order = tie_order(df, key, ts, seq)
    blocked = row_blocks(df, key, order, before=1)
    w = Window.partitionBy(*key, BLOCK).orderBy(*order)
    gap = (micros(ts) - F.lag(micros(ts)).over(w)) / F.lit(1e6)
    return drop_margin(blocked.withColumn(name, gap))


def interval_stats(
    df: DataFrame, key: Sequence[str], ts: str = "ts", seq: str | None = None
) -> DataFrame:
    """Mean, median, least and greatest sampling interval per series."""
    gaps = with_interval(df.select(*key, ts, *([seq] if seq else [])), key, ts, seq)
    gaps = stored(gaps.select(*key, "interval_seconds"), "gaps")  # read in every round of counting
    x = F.col("interval_seconds")
    order = [*key, "mean_interval", "median_interval", "min_interval", "max_interval"]
    basic = gaps.groupBy(*key).agg(
        F.avg(x).alias("mean_interval"), F.min(x).alias("min_interval"), F.max(x).alias("max_interval")
    )
    medians = exact_percentiles(gaps, key, "interval_seconds", {"median_interval": 0.5})
    return with_percentiles(basic, medians, key).select(*order)


def find_gaps(
    df: DataFrame,
    key: Sequence[str],
    ts: str = "ts",
    seq: str | None = None,
    longer_than_seconds: float = 20 * 3600,
) -> DataFrame:
    """Rows that follow a silence longer than the limit."""
    return with_interval(df, key, ts, seq).filter(
        F.col("interval_seconds") > F.lit(float(longer_than_seconds))
    )


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, nulls, percentage of nulls. One scan for all columns."""
    counted = df.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_null"))
            for i, c in enumerate(columns)
        ]
    )
    return counted.select("n", F.inline(pairs)).select(
        "column_name",
        "n",
        "n_null",
        (F.col("n_null") / F.nullif(F.col("n"), F.lit(0)) * 100).alias("pct_null"),
    )


def duplicate_profile(df: DataFrame, key: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows, and rows that share their (series, time) with another row."""
    per_time = df.groupBy(*key, ts).agg(F.count("*").alias("_n"))
    return per_time.groupBy(*key).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("n_in_duplicates"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated_times"),
    )


def time_bounds(df: DataFrame, key: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return df.groupBy(*key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def histogram(df: DataFrame, value: str = "value", bins: int = 50) -> DataFrame:
    """Equal-width bins over the range of the finite values, empty ones too.

    The last bin includes its end; NaN and infinite values are in no bin. Two
    scalars (least and greatest value) pass through the driver.
    """
    x = F.col("_x")
    values = df.select(F.col(value).cast("double").alias("_x"))
    values = values.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    low, high = values.agg(F.min("_x"), F.max("_x")).first()
    if low is None:
        low, high = 0.0, 0.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    raw = F.width_bucket(x, F.lit(low), F.lit(high), F.lit(bins))
    width = (high - low) / bins
    counts = values.groupBy(F.least(raw, F.lit(bins).cast("long")).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start")
    )


def regression_metrics(
    df: DataFrame, actual: Column, predicted: Column | None = None, key: Sequence[str] = ()
) -> DataFrame:
    """MAE and RMSE, by default against predicting zero."""
    error = actual - predicted if predicted is not None else actual
    return df.groupBy(*key).agg(
        F.count(error).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns a numeric selection by type would keep."""
    return [c for c, kind in df.dtypes if kind in ("double", "bigint")]
