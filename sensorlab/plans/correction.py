"""Batch twin of the correction job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.operators.asof import asof_correct
from sensorlab.operators.gate import MAX_RATE_PER_MINUTE, rate_gate
from sensorlab.operators.sets import dedup_first
from sensorlab.operators.slices import micros, plan_slices
from sensorlab.session import durable

COLUMNS = ("ts", "value", "seq", "produced_at")


def correct_device(
    device: DataFrame,
    station: DataFrame,
    key: Sequence[str],
    tolerance_seconds: float = 20 * 60,
    max_rate: float = MAX_RATE_PER_MINUTE,
    forget_after_seconds: float | None = None,
) -> DataFrame:
    """De-duplicate both by time, gate the station, correct the device.

    The slices are planned once, on the raw times: no later step adds rows. A
    station's ``stage`` (seconds its reading took to get here) is carried along.
    """
    stage = F.col("stage").cast("double") if "stage" in station.columns else F.lit(0.0)
    device, station = device.select(*key, *COLUMNS), station.select(*key, *COLUMNS, stage.alias("stage"))
    sides = [df.select(*key, "ts", F.lit(n).alias("_left"), "seq") for n, df in enumerate((station, device))]
    plan = plan_slices(sides[0].unionByName(sides[1]), key, micros("ts"), F.col("_left"), F.col("seq"))
    once = dedup_first(station, key, seq="seq")
    gated = rate_gate(once, key, seq="seq", max_rate=max_rate, reset_after_seconds=forget_after_seconds, plan=plan)
    gated = gated.withColumn("value", F.col("gated_value")).select(*key, *COLUMNS, "stage")
    if not plan.single:
        # The join reads it twice, and the gate is the costly part.
        gated = durable(gated)
    return asof_correct(
        dedup_first(device, key, seq="seq"),
        gated,
        key,
        latency="stage",
        seq="seq",
        tolerance_seconds=tolerance_seconds,
        plan=plan,
        forget_after_seconds=forget_after_seconds,
    )
