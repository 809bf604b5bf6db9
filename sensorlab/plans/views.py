"""The ``events`` table seen as sensor data.

Site is ``user_id mod 8``; ``view`` rows are the device's readings, ``click``
rows the weather station's; ``click, purchase, error, signup`` are pumps 0-3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlab.session import use_utc

SITES = 8
PUMP_OF = {"click": 0, "purchase": 1, "error": 2, "signup": 3}
QUANTITIES = ["prikon", "tl", "fanh"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """``site, ts, value, source, seq, produced_at`` of all events."""
    return table(spark, folder, "events").select(
        F.pmod("user_id", F.lit(SITES)).cast("long").alias("site"),
        "ts",
        "value",
        F.col("event_type").alias("source"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") / F.lit(1000.0)).alias("produced_at"),
    )


def of_type(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return readings(spark, folder).filter(F.col("source") == kind)


def pump_of(source: Column) -> Column:
    pump = F.lit(None).cast("int")
    for kind, number in PUMP_OF.items():
        pump = F.when(source == kind, number).otherwise(pump)
    return pump


def channels(spark: SparkSession, folder: str, quantity: str | None = None) -> DataFrame:
    """Pump readings; the quantity goes by ``event_id mod 3`` unless given."""
    rows = readings(spark, folder).withColumn("pump", pump_of(F.col("source")))
    kind = F.lit(quantity) if quantity else F.element_at(
        F.array(*[F.lit(q) for q in QUANTITIES]), (F.col("seq") % 3 + 1).cast("int")
    )
    return rows.filter(F.col("pump").isNotNull()).select(
        "site", "ts", "value", "seq", "pump", kind.alias("quantity")
    )


def base(spark: SparkSession, folder: str) -> DataFrame:
    """Device readings the features are computed for."""
    return of_type(spark, folder, "view").select(
        "site", "ts", F.col("value").alias("temperature"), "seq"
    )


POINT_NAMES = {
    "click": ("xcc_tcstav0_tl", "°C"),
    "purchase": ("xcc_tcstav1_tl", "°C"),
    "error": ("xcc_tcstav0_prikon", "kW"),
    "signup": ("xcc_tcstav2_fanh", "RPM"),
    "view": ("gw1100a_outdoor_temperature", "°C"),
}


def entity_of(source: Column) -> Column:
    """The series name of an event type; null if it has none."""
    entity = F.lit(None).cast("string")
    for kind, (name, _) in POINT_NAMES.items():
        entity = F.when(source == kind, F.lit(name)).otherwise(entity)
    return entity


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Database points ``measurement, entity_id, time, value``."""
    entity, unit = entity_of(F.col("source")), F.lit(None).cast("string")
    for kind, (_, measurement) in POINT_NAMES.items():
        unit = F.when(F.col("source") == kind, F.lit(measurement)).otherwise(unit)
    return readings(spark, folder).select(
        unit.alias("measurement"), entity.alias("entity_id"), F.col("ts").alias("time"), "value"
    )


def minutely(df: DataFrame) -> DataFrame:
    """Times cut to minutes, so that copies of a time exist."""
    return df.withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))


def naive(df: DataFrame) -> DataFrame:
    """UTC times without zone, as the checked results carry them."""
    return df.select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes]
    )


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
