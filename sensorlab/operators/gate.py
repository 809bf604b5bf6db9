"""Rate-of-change gate: replace readings that move too fast.

Each reading is compared with the last *accepted* one, so the outcome is a fold
over the series and not a window function. Series within the row limit are
folded whole, one task each. Longer ones are folded slice by slice in parallel:

1. every slice is folded as if its first row were accepted,
2. each slice is folded again from the reading its predecessor ended with,
   until no slice ends differently than before; as runs that once accept the
   same row never part again, this settles after a round or two,
3. the rows are produced from the settled starting points.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlab.operators.slices import HOT, SLICE, SlicePlan, micros, plan_slices, same_key
from sensorlab.session import durable

# Largest accepted change per minute (fixed value).
MAX_RATE_PER_MINUTE = 1.6


def fold_gate(us: np.ndarray, v: np.ndarray, limit: float, reset_us: int | None) -> np.ndarray:
    """Index of the accepted reading each row stands for.

    The first row is accepted. Stretches in which every row is close enough to
    the one before it are taken in one step; only after a rejection are rows
    compared one by one with the held reading, until one fits.
    """
    n = len(us)
    stands = np.arange(n)
    known = np.flatnonzero(~np.isnan(v))
    if len(known) < n:
        # Rows without a value pass through, neither accepted nor held.
        stands[known] = known[fold_gate(us[known], v[known], limit, reset_us)]
        return stands
    gap = np.abs(np.diff(us))
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.abs(np.diff(v) / (gap / 1e6 / 60.0))
    fits = (gap == 0) | (rate <= limit)
    if reset_us is not None:
        fits |= gap > reset_us
    breaks = (np.flatnonzero(~fits) + 1).tolist()
    if not breaks:
        return stands
    times, heights = us.tolist(), v.tolist()
    forever = float("inf") if reset_us is None else reset_us
    at = 0
    while at < len(breaks):
        k = first = breaks[at]
        t, h = times[first - 1], heights[first - 1]
        while k < n:
            waited = abs(times[k] - t)
            if waited == 0 or abs((heights[k] - h) / (waited / 1e6 / 60.0)) <= limit or waited > forever:
                break
            k += 1
        stands[first:k] = first - 1
        at = bisect.bisect_right(breaks, k, at)
    return stands


def _fold_slice(
    group: list[str], value: str, limit: float, reset_us: int | None, ends_only: bool
):
    """Function over the rows of one (series, slice), a carried start in front."""

    def run(rows: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("_start", "_us", "_seq")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        us = rows["_us"].to_numpy().astype("int64")
        v = rows[value].to_numpy().astype("float64")
        carried = int((rows["_start"].to_numpy() == 0).sum())
        stands = fold_gate(us, v, limit, reset_us)
        if ends_only:
            last = rows.slice(len(us) - 1).select(group)
            known = np.flatnonzero(~np.isnan(v))
            end = stands[known[-1]] if len(known) else None
            ends = {"_end_us": us[end] if len(known) else None, "_end_v": v[end] if len(known) else None}
            ends |= {"_from_us": us[0] if carried else None, "_from_v": v[0] if carried else None}
            kinds = {"us": pa.int64(), "_v": pa.float64()}
            for name, at in ends.items():
                last = last.append_column(name, pa.array([at], kinds[name[-2:]]))
            return last
        done = rows.append_column("gated_value", pa.array(v[stands]))
        done = done.append_column("rejected", pa.array(stands != np.arange(len(us))))
        return done.slice(carried)

    return run


def _starts(slim: DataFrame, plan: SlicePlan, value: str, limit: float, reset_us) -> DataFrame:
    """Settled starting reading of every later slice of the split series."""
    ends = T.StructType([T.StructField(c, slim.schema[c].dataType) for c in plan.group])
    for name, kind in (("us", T.LongType()), ("v", T.DoubleType())):
        ends = ends.add(f"_end_{name}", kind).add(f"_from_{name}", kind)
    fold = _fold_slice(plan.group, value, limit, reset_us, ends_only=True)
    order = Window.partitionBy(*plan.key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    newest = Window.partitionBy(*plan.group).orderBy(F.col("_round").desc())
    rows = slim.withColumn("_start", F.lit(1))

    def refold(part: DataFrame, number: int) -> DataFrame:
        folded = part.groupBy(*plan.group).applyInArrow(fold, ends)
        return folded.withColumn("_round", F.lit(number))

    ended = durable(refold(rows, 0))
    for number in itertools.count(1):
        starts = ended.withColumns(
            {"_us": F.last("_end_us", True).over(order), "_v": F.last("_end_v", True).over(order)}
        )
        moved = ~(
            F.col("_us").eqNullSafe(F.col("_from_us")) & F.col("_v").eqNullSafe(F.col("_from_v"))
        )
        todo = durable(
            starts.filter(moved).select(*plan.group, "_us", F.col("_v").alias(value))
        )
        if todo.isEmpty():
            return starts.filter(F.col("_us").isNotNull()).select(
                *plan.group, "_us", F.col("_v").alias(value)
            )
        part = rows.join(todo, same_key(rows, todo, plan.group), "left_semi").unionByName(
            todo.withColumns({"_start": F.lit(0), "_seq": F.lit(0).cast("long")})
        )
        both = ended.unionByName(refold(part, number))
        ended = durable(
            both.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")
        )


def rate_gate(
    df: DataFrame,
    key: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    seq: str | None = None,
    max_rate: float = MAX_RATE_PER_MINUTE,
    reset_after_seconds: float | None = None,
    plan: SlicePlan | None = None,
) -> DataFrame:
    """Add ``gated_value`` and ``rejected``.

    Rows without a value pass through unchanged. The first reading is accepted,
    one at the same time as the held reading too. A change of at most ``max_rate`` per minute is accepted and becomes the
    held reading; otherwise the held value is repeated. With
    ``reset_after_seconds`` a held reading older than that no longer counts.
    """
    arrival = F.col(seq).cast("long") if seq else F.xxhash64(F.col(value))
    rows = df.withColumns({"_us": micros(ts), "_seq": arrival})
    reset_us = None if reset_after_seconds is None else int(reset_after_seconds * 1e6)
    by = [F.col("_us"), F.lit(0), F.col("_seq")]
    plan = plan or plan_slices(rows, key, *by)
    sliced = plan.assign(plan.mark_hot(rows), *by)
    placed = sliced.drop(HOT).withColumn("_start", F.lit(1))
    if not plan.single:
        # Read several times below, so its three narrow columns are stored once.
        slim = durable(sliced.filter(HOT).select(*plan.group, "_us", "_seq", value))
        starts = _starts(slim, plan, value, max_rate, reset_us)
        placed = placed.unionByName(
            starts.withColumns({"_start": F.lit(0), "_seq": F.lit(0).cast("long")}),
            allowMissingColumns=True,
        )
    schema = T.StructType(
        [
            *[f for f in placed.schema.fields],
            T.StructField("gated_value", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    fold = _fold_slice(plan.group, value, max_rate, reset_us, ends_only=False)
    gated = placed.groupBy(*plan.group).applyInArrow(fold, schema)
    return gated.select(*df.columns, "gated_value", "rejected")


def gate_report(gated: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows and rejections per series."""
    return gated.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum(F.col("rejected").cast("long")).alias("n_rejected")
    )
