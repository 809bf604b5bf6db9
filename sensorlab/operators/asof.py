"""As-of joins on time: backward, forward and nearest, with tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlab.operators.slices import (
    HOT,
    SLICE,
    SlicePlan,
    carry_around,
    micros,
    plan_slices,
)

_LEFT = "_is_left"


def _reading(df: DataFrame, ts: str, seq: str | None, columns: Sequence[str]) -> Column:
    """Orderable struct: time, arrival, carried columns."""
    fields = [micros(ts).alias("us")]
    fields.append((F.col(seq) if seq else F.lit(0)).cast("long").alias("seq"))
    fields += [F.col(c).alias(c) for c in columns]
    return F.when(F.col(ts).isNotNull(), F.struct(*fields))


def neighbours(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    ts: str,
    columns: Sequence[str],
    seq: str | None = None,
    sides: Sequence[str] = ("backward",),
    plan: SlicePlan | None = None,
) -> DataFrame:
    """Add structs ``_backward`` / ``_forward``: the closest right rows in time.

    Both inputs go into one exchange on the series; a running maximum in time
    order gives the last row at or before, a running minimum in reverse order
    the first row at or after. Every frame grows from its start, so the work
    per row is constant.
    """
    read = right.select(*key, ts, _reading(right, ts, seq, columns).alias("_r"))
    rows = left.withColumn(_LEFT, F.lit(True)).unionByName(
        read.withColumn(_LEFT, F.lit(False)), allowMissingColumns=True
    )
    rows = rows.withColumn("_us", micros(ts))
    # Within an instant the readings come first, so a left row's neighbours are in its slice or among the carried ones.
    own = F.col(seq).cast("long") if seq and seq in left.columns else F.lit(0)
    by = [F.col("_us"), F.col(_LEFT).cast("int"), F.coalesce("_r.seq", own)]
    plan = plan or plan_slices(rows, key, *by)
    sliced = plan.assign(plan.mark_hot(rows), *by)
    if not plan.single:
        around = carry_around(sliced, plan, "_r").withColumns(
            {_LEFT: F.lit(False), "_us": F.col("_r.us")}
        )
        sliced = sliced.unionByName(around, allowMissingColumns=True)
    for side in sides:
        down = side == "forward"
        # Right rows come before left rows of the same time.
        order = F.col("_us").desc() if down else F.col("_us").asc()
        w = Window.partitionBy(*plan.group).orderBy(order, _LEFT)
        pick = F.min if down else F.max
        so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sliced = sliced.withColumn(f"_{side}", pick(F.col("_r")).over(so_far))
    return sliced.filter(F.col(_LEFT)).drop(_LEFT, HOT, SLICE, "_r")


def _seconds(gap: Column) -> Column:
    return gap / F.lit(1e6)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    ts: str = "ts",
    seq: str | None = None,
    direction: str = "backward",
    tolerance_seconds: float | None = None,
    plan: SlicePlan | None = None,
) -> DataFrame:
    """Every left row with the right ``columns`` of the closest row in time.

    Exact times match and the tolerance is inclusive. Among equal right times
    ``backward`` takes the last arrival and ``forward`` the first; ``nearest``
    prefers the earlier row when both gaps are equal. Adds ``gap_seconds``.
    """
    sides = ("backward", "forward") if direction == "nearest" else (direction,)
    near = neighbours(left, right, key, ts, columns, seq, sides, plan)
    before = F.col("_us") - F.col("_backward.us") if "backward" in sides else F.lit(None)
    after = F.col("_forward.us") - F.col("_us") if "forward" in sides else F.lit(None)
    if direction == "nearest":
        near = near.withColumn(
            "_hit",
            F.when(
                F.col("_backward").isNotNull() & (F.col("_forward").isNull() | (before <= after)),
                F.col("_backward"),
            ).otherwise(F.col("_forward")),
        )
    else:
        near = near.withColumn("_hit", F.col(f"_{direction}"))
    # A left row without a time has no neighbours.
    near = near.withColumn("_hit", F.when(F.col("_us").isNotNull(), F.col("_hit")))
    near = near.withColumn("_gap", F.abs(F.col("_us") - F.col("_hit.us")))
    if tolerance_seconds is not None:
        near = near.withColumn(
            "_hit", F.when(F.col("_gap") <= F.lit(int(tolerance_seconds * 1e6)), F.col("_hit"))
        )
    return near.select(
        *left.columns,
        *[F.col(f"_hit.{c}").alias(c) for c in columns],
        F.when(F.col("_hit").isNotNull(), _seconds(F.col("_gap"))).alias("gap_seconds"),
    )


def asof_correct(
    device: DataFrame,
    meteo: DataFrame,
    key: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    produced: str = "produced_at",
    latency: str | None = None,
    seq: str | None = None,
    tolerance_seconds: float = 20 * 60,
    plan: SlicePlan | None = None,
    forget_after_seconds: float | None = None,
) -> DataFrame:
    """Suggest for each device reading the latest station reading not after it.

    Skew within the tolerance: the station value. Older: the device value, with
    the skew kept. None: the device value and zeros. Device readings of one
    millisecond count once, the last arrival stands. With
    ``forget_after_seconds`` an older station reading counts as none.
    """
    ms = F.floor(micros(ts) / 1000)
    newest = Window.partitionBy(*key, "_ms").orderBy(
        *[F.col(c).desc() for c in ([seq, ts] if seq else [ts, value])]
    )
    device = (
        device.withColumn("_ms", ms)
        .withColumn("_rn", F.row_number().over(newest))
        .filter("_rn = 1")
        .select(*key, ts, F.col(value).alias("temperature"), F.col(produced).alias("produced_at"))
    )
    columns = [value, produced] + ([latency] if latency else [])
    near = neighbours(device, meteo, key, ts, columns, seq, plan=plan)
    hit = F.col("_backward")
    if forget_after_seconds is not None:
        hit = F.when(F.col("_us") - hit["us"] <= F.lit(int(forget_after_seconds * 1e6)), hit)
    skew = _seconds(F.col("_us") - hit["us"])
    inside = hit.isNotNull() & (skew <= F.lit(float(tolerance_seconds)))
    stage = hit[latency] if latency else F.lit(0.0)
    return near.select(
        *key,
        ts,
        "temperature",
        F.when(inside, hit[value]).otherwise(F.col("temperature")).alias("suggested_temperature"),
        "produced_at",
        F.when(inside, hit[produced]).otherwise(F.lit(0.0)).alias("produced_at_meteo"),
        F.coalesce(skew, F.lit(0.0)).alias("time_difference"),
        F.coalesce(stage, F.lit(0.0)).alias("meteo_stage"),
        inside.alias("meteo_used"),
    )


def impute_two_sided(
    rows: DataFrame,
    readings: DataFrame,
    key: Sequence[str],
    target: str,
    value: str = "value",
    ts: str = "ts",
    seq: str | None = None,
    gap_seconds: float = 45 * 60,
    plan: SlicePlan | None = None,
) -> DataFrame:
    """Fill null ``target`` with the mean of both neighbours within the gap.

    If only one neighbour is close enough the value stays null. Never changes
    the number of rows.
    """
    near = neighbours(rows, readings, key, ts, [value], seq, ("backward", "forward"), plan)
    limit = F.lit(int(gap_seconds * 1e6))
    before = F.when(F.col("_us") - F.col("_backward.us") <= limit, F.col(f"_backward.{value}"))
    after = F.when(F.col("_forward.us") - F.col("_us") <= limit, F.col(f"_forward.{value}"))
    filled = F.coalesce(F.col(target), (before + after) / 2)
    return near.select(*[filled.alias(c) if c == target else F.col(c) for c in rows.columns])


def match_and_impute(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    value: str = "value",
    name: str = "outdoor_temperature",
    ts: str = "ts",
    seq: str | None = None,
    tolerance_seconds: float = 20 * 60,
    gap_seconds: float = 45 * 60,
    plan: SlicePlan | None = None,
) -> DataFrame:
    """Nearest match and, where there is none, two-sided imputation.

    Same result as ``asof_join`` (nearest) followed by ``impute_two_sided`` on
    the same readings, from one exchange and one pair of windows.
    """
    near = neighbours(left, right, key, ts, [value], seq, ("backward", "forward"), plan)
    before, after = F.col("_us") - F.col("_backward.us"), F.col("_forward.us") - F.col("_us")
    low, high = F.col(f"_backward.{value}"), F.col(f"_forward.{value}")
    earlier = before.isNotNull() & (after.isNull() | (before <= after))
    reach = F.lit(int(tolerance_seconds * 1e6))
    nearest = F.when(F.when(earlier, before).otherwise(after) <= reach, F.when(earlier, low).otherwise(high))
    gap = F.lit(int(gap_seconds * 1e6))
    imputed = (F.when(before <= gap, low) + F.when(after <= gap, high)) / 2
    return near.select(*left.columns, F.coalesce(nearest, imputed).alias(name))
