"""Sensor catalog and extracts driven by it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlab.operators.slices import estimated_bytes
from sensorlab.schemas import SENSOR
from sensorlab.sources.files import write_csv

# Sensors outside the pumps: name, description (fixed values).
OUTDOOR_SENSORS = [
    ("xcc_venkovni_teplota_nefiltrovana", "TCE unfiltered outdoor temperature"),
    ("gw1100a_outdoor_temperature", "JOM outdoor temperature"),
    ("xcc_venkovni_teplota", "XCC filtered outdoor temperature"),
    ("gw1100a_indoor_temperature", "JOM indoor temperature"),
]
# Quantities of each pump: suffix, description, measurement, ignored (fixed values).
PUMP_QUANTITIES = [
    ("tl", "teplota na horním výparníku", "°C", False),
    ("fanh", "rychlost vetraku", "RPM", True),
    ("prikon", "výkon, čerpadla", "kW", True),
]
PUMP_COUNT = 4
DEFAULT_DAYS = 5

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def sensor_catalog(spark: SparkSession, output_dir: str = "") -> DataFrame:
    """All configured sensors: the fixed ones, and each pump's quantities."""
    fixed = [
        (name, "°C", text, DEFAULT_DAYS, f"{output_dir}teplota/", True)
        for name, text in OUTDOOR_SENSORS
    ]
    pumps = [
        (
            f"xcc_tcstav{pump}_{suffix}",
            unit,
            f"XCC heat‑pump {pump} – {text}",
            DEFAULT_DAYS,
            f"{output_dir}tepelna_cerpadla/{suffix}/",
            ignore,
        )
        for suffix, text, unit, ignore in PUMP_QUANTITIES
        for pump in range(PUMP_COUNT)
    ]
    # Literals, so that Catalyst knows the size.
    def sensor(row: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(SENSOR, row, strict=True)])

    return spark.range(1).select(F.inline(F.array(*[sensor(row) for row in fixed + pumps])))


def scan_range(
    points: DataFrame,
    entity: str | None = None,
    start: Column | str | None = None,
    end: Column | str | None = None,
    days: int = DEFAULT_DAYS,
    ts: str = "time",
    entity_column: str = "entity_id",
    inclusive: bool = False,
) -> DataFrame:
    """Rows of one series in a time range, both bounds excluded by default.

    ``end`` defaults to now and ``start`` to ``days`` before it. The filters
    reach the scan; on a table partitioned by entity they prune folders.
    """

    kind = dict(points.dtypes)[ts]

    def moment(bound: Column | str) -> Column:
        return (F.lit(bound) if isinstance(bound, str) else bound).cast(kind)

    end = moment(F.current_timestamp() if end is None else end)
    start = moment(start) if start is not None else end - F.make_dt_interval(F.lit(days))
    t = F.col(ts)
    rows = points.filter((t >= start) & (t <= end) if inclusive else (t > start) & (t < end))
    return rows if entity is None else rows.filter(F.col(entity_column) == entity)


def filter_range(df: DataFrame, ts: str = "ts", start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with ``start <= ts <= end``; either bound may be left out."""
    kind = dict(df.dtypes)[ts]
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast(kind))
    return df


def extract_catalog(
    points: DataFrame, catalog: DataFrame, start: str | None = None, end: str | None = None, until: str | None = None
) -> DataFrame:
    """Points of all sensors that are not ignored, in one job.

    With ``until``, of each sensor those of its own last ``days`` before then.
    """
    wanted = catalog.filter(~F.col("ignore")).select(
        F.col("name").alias("entity_id"), "measurement", "description", "days", "output_dir"
    )
    if estimated_bytes(wanted) <= BROADCAST_LIMIT_BYTES:
        wanted = F.broadcast(wanted)
    rows = points
    if start is not None:
        rows = rows.filter(F.col("time") > F.lit(start).cast(dict(points.dtypes)["time"]))
    if end is not None:
        rows = rows.filter(F.col("time") < F.lit(end).cast(dict(points.dtypes)["time"]))
    found = rows.join(wanted, ["entity_id", "measurement"])
    if until is not None:
        last = F.lit(until).cast(dict(points.dtypes)["time"])
        found = found.filter((F.col("time") > last - F.make_dt_interval(F.col("days"))) & (F.col("time") <= last))
    return found.drop("days")


def store_points(points: DataFrame, path: str) -> None:
    """Write points by sensor and day; a full day of a busy sensor may be written by several tasks."""
    days = points.withColumn("day", F.to_date("time"))
    days.hint("rebalance", "entity_id", "day").write.mode("overwrite").partitionBy("entity_id", "day").parquet(path)


def extract_days(points: DataFrame, catalog: DataFrame, until: str) -> DataFrame:
    """Of each sensor that isn't ignored, the points of its own last ``days`` before ``until``.

    ``points`` are partitioned by ``entity_id`` and ``day``, as `store_points`
    writes them. The catalog becomes the sensors' days; joined on both, sensors
    and days reach the scan at run time, which opens the wanted days of the
    wanted sensors only. A catalog whose size Spark can't tell should be stored.
    """
    last = F.lit(until).cast("timestamp")
    days = F.sequence(F.to_date(last - F.make_dt_interval(F.col("days"))), F.to_date(last))
    wanted = catalog.filter(~F.col("ignore") & (F.col("days") > 0)).select(
        F.col("name").alias("entity_id"), "measurement", "description", "output_dir", "days", F.explode(days).alias("day")
    )
    if estimated_bytes(wanted) <= BROADCAST_LIMIT_BYTES:
        wanted = F.broadcast(wanted)
    found = points.join(wanted, ["entity_id", "day", "measurement"])
    t = F.col("time").cast("timestamp")
    return found.filter((t > last - F.make_dt_interval(F.col("days"))) & (t < last)).drop("days", "day")


def export_extract(found: DataFrame, root: str) -> int:
    """Write an extract as CSV: the sensor's ``output_dir`` and name as folders below ``root``; the number of rows."""
    rows = found.select("output_dir", "entity_id", "time", "value")
    return write_csv(rows.hint("rebalance", "output_dir", "entity_id"), root, ["output_dir", "entity_id"])


def count_per_measurement(points: DataFrame, entity: str) -> DataFrame:
    """Measurements that hold points of a sensor, with their number."""
    held = points.filter(F.col("entity_id") == entity).groupBy("measurement")
    return held.agg(F.count("value").alias("n_points")).filter("n_points > 0")


def find_measurement(points: DataFrame, entity: str) -> DataFrame:
    """The first measurement, by name, that holds a sensor; no row if none."""
    return count_per_measurement(points, entity).orderBy("measurement").limit(1)


def pump_sensor_names(quantity: str, pumps: Sequence[int] = range(PUMP_COUNT)) -> list[str]:
    return [f"xcc_tcstav{p}_{quantity}" for p in pumps]
