"""Batch operators over the test tables, each with the SQL it must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sensorlab.functions import wire
from sensorlab.operators import asof, features, gate, profile, resample, rolling, sets, split
from sensorlab.plans import views
from sensorlab.plans.correction import correct_device
from sensorlab.plans.training import training_rows as training_table
from sensorlab.plans import model as model_features
from sensorlab.session import fresh_folder, stored
from sensorlab.sources import catalog, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR = 3600
SITE = ["site"]

READINGS = """readings AS (
  SELECT CAST(user_id % 8 AS BIGINT) AS site, ts, value, event_type AS source,
         event_id AS seq, event_id / 1000.0 AS produced_at
  FROM events)"""
DEVICE = "device AS (SELECT * FROM readings WHERE source = 'view')"
METEO = "meteo AS (SELECT * FROM readings WHERE source = 'click')"
CHANNELS = """channels AS (
  SELECT site, ts, value, seq,
         CASE source WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 END AS pump,
         CASE seq % 3 WHEN 0 THEN 'prikon' WHEN 1 THEN 'tl' ELSE 'fanh' END AS quantity
  FROM readings WHERE source <> 'view')"""
POINTS = """points AS (
  SELECT CASE event_type WHEN 'error' THEN 'kW' WHEN 'signup' THEN 'RPM' ELSE '°C' END AS measurement,
         CASE event_type WHEN 'click' THEN 'xcc_tcstav0_tl' WHEN 'purchase' THEN 'xcc_tcstav1_tl'
                         WHEN 'error' THEN 'xcc_tcstav0_prikon' WHEN 'signup' THEN 'xcc_tcstav2_fanh'
                         ELSE 'gw1100a_outdoor_temperature' END AS entity_id,
         ts AS time, value
  FROM events)"""


def query(sql: str | None = None, *parts: str):
    """Register a query under its function name, with its SQL."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            with_parts = "WITH RECURSIVE " + ", ".join(parts) + "\n" if parts else ""
            SQL[function.__name__] = with_parts + sql
        return function

    return keep


# -- wire records, sources ---------------------------------------------------


def wire_text(df: DataFrame) -> DataFrame:
    """JSON records of readings, in all accepted spellings of time and number."""
    utc = F.col("ts").cast("timestamp")

    def spell(hours: int, zone: str):
        shifted = utc + F.make_dt_interval(hours=F.lit(hours))
        return F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(zone))

    time = (
        F.when(F.col("seq") % 4 == 0, spell(2, "+02:00"))
        .when(F.col("seq") % 4 == 1, spell(-3, "-03:00"))
        .when(F.col("seq") % 4 == 2, spell(0, "Z"))
        .otherwise(spell(0, ""))
    )
    number = F.col("value").cast("string")
    value = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    more = F.when(
        F.col("seq") % 5 != 0,
        F.concat(
            F.lit(',"source":"'), F.col("source"), F.lit('","processing_time_ms":'), F.col("produced_at").cast("string")
        ),
    ).otherwise(F.lit(""))
    text = F.concat(F.lit('{"time":"'), time, F.lit('","value":'), value, more, F.lit("}"))
    return df.select("site", "seq", text.alias("value"))


@query(
    """SELECT site, seq, ts, value, CASE WHEN seq % 5 = 0 THEN '' ELSE source END AS source,
       CASE WHEN seq % 5 = 0 THEN 0.0 ELSE produced_at END AS produced_at FROM readings""",
    READINGS,
)
def parse_readings(spark, folder):
    return views.naive(wire.parse_readings(wire_text(views.readings(spark, folder))))


@query(
    """SELECT seq % 7 AS kind, count(*) AS n_bad FROM readings WHERE seq % 7 < 3 GROUP BY 1""",
    READINGS,
)
def parse_dead_letters(spark, folder):
    """Records without value, with a bad number, and no JSON at all are routed."""
    good = wire_text(views.readings(spark, folder))
    kind = F.col("seq") % 7
    spoiled = good.withColumn(
        "value",
        F.when(kind == 0, F.lit('{"time":"2024-01-01T00:00:00Z"}'))
        .when(kind == 1, F.regexp_replace("value", '"value":"?[0-9.E-]+"?', '"value":"n/a"'))
        .when(kind == 2, F.lit("not json"))
        .otherwise(F.col("value")),
    )
    _, bad = wire.parse_readings(spoiled, on_error="route")
    return bad.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_bad"))


@query(
    """SELECT seq, CAST(to_json({'time': strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+00:00'), 'temperature': value,
       'processing_time': 0.5::DOUBLE, 'start_time': CAST(seq % 1000 AS DOUBLE)}) AS VARCHAR) AS value FROM readings""",
    READINGS,
)
def wire_json(spark, folder):
    rows = views.readings(spark, folder).select(
        "seq",
        F.col("ts").alias("time"),
        F.col("value").alias("temperature"),
        (F.col("seq") % 1000).cast("double").alias("produced_at"),
    )
    timed = wire.with_latency(rows, now=F.col("produced_at") + 0.5).drop("produced_at")
    return wire.to_wire_json(timed, "gated")


@query(
    """SELECT seq, CASE source WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 0
       WHEN 'signup' THEN 2 ELSE -1 END AS pump FROM readings""",
    READINGS,
)
def pump_index(spark, folder):
    names = views.readings(spark, folder)
    entity = F.lit("")
    for kind, (name, _) in views.POINT_NAMES.items():
        entity = F.when(F.col("source") == kind, F.lit(name)).otherwise(entity)
    return names.select("seq", F.coalesce(wire.pump_index(entity), F.lit(-1)).alias("pump"))


@query(
    """SELECT * FROM points WHERE entity_id = 'xcc_tcstav0_prikon'
       AND time > TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-12'""",
    POINTS,
)
def scan_range(spark, folder):
    return catalog.scan_range(
        views.points(spark, folder), "xcc_tcstav0_prikon", "2024-01-05 00:00:00", "2024-01-12 00:00:00"
    )


@query(
    "SELECT site, ts, value, seq FROM readings WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20'",
    READINGS,
)
def filter_range(spark, folder):
    rows = views.readings(spark, folder).select("site", "ts", "value", "seq")
    return catalog.filter_range(rows, "ts", "2024-01-03 00:00:00", "2024-01-20 00:00:00")


@query(
    """SELECT entity_id, measurement, time, value,
       'XCC heat‑pump ' || substr(entity_id, 11, 1) || ' – teplota na horním výparníku' AS description
       FROM points WHERE entity_id LIKE 'xcc_tcstav%_tl'""",
    POINTS,
)
def catalog_extract(spark, folder):
    sensors = catalog.sensor_catalog(spark)
    return catalog.extract_catalog(views.points(spark, folder), sensors).drop("output_dir")


def own_days(sensors: DataFrame) -> DataFrame:
    """The catalog with other days for each pump."""
    pump = wire.pump_index(F.col("name"))
    return sensors.withColumns({"days": F.coalesce(pump * 3 + 2, F.lit(4)), "ignore": F.lit(False), "output_dir": F.col("measurement")})


OWN_DAYS = """own AS (SELECT p.entity_id, p.measurement, p.time, p.value FROM points p WHERE time < TIMESTAMP '2024-01-20 06:00:00'
  AND time > TIMESTAMP '2024-01-20 06:00:00' - to_days(CASE WHEN entity_id LIKE 'xcc_tcstav%' THEN CAST(substr(entity_id, 11, 1) AS INT) * 3 + 2 ELSE 4 END))"""


def stored_points(spark, folder):
    path = fresh_folder(spark, "points")
    catalog.store_points(views.points(spark, folder), path)
    return spark.read.parquet(path)


@query("SELECT entity_id, measurement, time, value, measurement AS output_dir FROM own", POINTS, OWN_DAYS)
def extract_days(spark, folder):
    """Each sensor's own last days, from points stored by sensor and day."""
    sensors = own_days(catalog.sensor_catalog(spark))
    return catalog.extract_days(stored_points(spark, folder), sensors, "2024-01-20 06:00:00").drop("description")


@query("SELECT entity_id, measurement AS output_dir, time, value FROM own", POINTS, OWN_DAYS)
def export_files(spark, folder):
    """The same, written as CSV by output folder and sensor, and read back."""
    sensors = own_days(catalog.sensor_catalog(spark))
    root = fresh_folder(spark, "export")
    catalog.export_extract(catalog.extract_days(stored_points(spark, folder), sensors, "2024-01-20 06:00:00"), root)
    rows = files.read_readings_csv(spark, root).withColumn("value", F.col("value").cast("double"))
    return views.naive(rows.select("entity_id", "output_dir", "time", "value"))


@query(
    """SELECT CASE WHEN entity_id LIKE 'gw%' THEN 'JOM' ELSE 'pump' END AS label,
       CASE WHEN entity_id LIKE 'gw%' THEN 'Gw1100a Outdoor Temperature' ELSE 'Xcc Tcstav0 Tl' END AS series, time, value FROM points
       WHERE entity_id IN ('gw1100a_outdoor_temperature', 'xcc_tcstav0_tl') AND time >= TIMESTAMP '2024-01-03' AND time <= TIMESTAMP '2024-01-20'""",
    POINTS,
)
def series_files(spark, folder):
    """Two series of one collection, written and read as CSV; a third one is missing."""
    root = fresh_folder(spark, "series")
    wanted = [("teplota", "gw1100a_outdoor_temperature.csv", "JOM"), ("tl", "xcc_tcstav0_tl.csv", "pump"), ("tl", "none.csv", "none")]
    for place, name, _ in wanted[:2]:
        rows = views.points(spark, folder).filter(F.col("entity_id") == name.removesuffix(".csv")).select("time", "value")
        files.write_csv(rows, f"{root}/sarze_1/{place}/{name}")
    rows, missing = files.read_series(spark, root, 1, wanted, "2024-01-03 00:00:00", "2024-01-20 00:00:00")
    assert len(missing) == 1
    return views.naive(rows.select("label", "series", "time", "value"))


@query(
    """SELECT measurement, count(value) AS n_points FROM points
       WHERE entity_id = 'xcc_tcstav2_fanh' GROUP BY 1 ORDER BY 1 LIMIT 1""",
    POINTS,
)
def find_measurement(spark, folder):
    return catalog.find_measurement(views.points(spark, folder), "xcc_tcstav2_fanh")


@query("SELECT seq, ts + INTERVAL 1 HOUR AS local_ts, value FROM readings", READINGS)
def local_time(spark, folder):
    """Plant-zone times; the test month lies in winter time (UTC+1)."""
    rows = views.readings(spark, folder)
    return rows.select("seq", wire.local_time(F.col("ts")).alias("local_ts"), "value")


# -- sets ----------------------------------------------------------------------

MINUTES = "minutes AS (SELECT site, date_trunc('minute', ts) AS ts, value, seq, source FROM readings)"


@query(
    """SELECT site, ts, value, seq FROM minutes
       QUALIFY row_number() OVER (PARTITION BY site, ts ORDER BY seq) = 1""",
    READINGS,
    MINUTES,
)
def dedup_first(spark, folder):
    rows = views.minutely(views.readings(spark, folder)).select("site", "ts", "value", "seq")
    return sets.dedup_first(rows, SITE, seq="seq")


@query(
    "SELECT site, ts, value, seq FROM minutes QUALIFY count(*) OVER (PARTITION BY site, ts) = 1",
    READINGS,
    MINUTES,
)
def keep_unique(spark, folder):
    rows = views.minutely(views.readings(spark, folder)).select("site", "ts", "value", "seq")
    return sets.keep_unique(rows, SITE)


@query(
    """SELECT site, ts, value, seq FROM minutes WHERE source IN ('click', 'view')
       QUALIFY row_number() OVER (PARTITION BY site, ts ORDER BY CASE source WHEN 'click' THEN 0 ELSE 1 END, seq) = 1""",
    READINGS,
    MINUTES,
)
def merge_first(spark, folder):
    rows = views.minutely(views.readings(spark, folder))
    first, second = (
        rows.filter(F.col("source") == k).select("site", "ts", "value", "seq") for k in ("click", "view")
    )
    return sets.merge_first([first, second], SITE, seq="seq")


@query(
    "SELECT site, ts, value, source FROM device UNION ALL SELECT site, ts, value, source FROM meteo",
    READINGS,
    DEVICE,
    METEO,
)
def union_all(spark, folder):
    device, meteo = (views.of_type(spark, folder, k).select("site", "ts", "value", "source") for k in ("view", "click"))
    return sets.union_all(device, meteo)


@query("SELECT DISTINCT ts FROM minutes", READINGS, MINUTES)
def distinct_times(spark, folder):
    return sets.distinct_times(views.minutely(views.readings(spark, folder)))


@query(
    """SELECT site, ts, value, arrival FROM (
         SELECT *, max(ts) OVER (PARTITION BY site ORDER BY arrival
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
         FROM (SELECT *, seq * 1000 + (seq * 7919) % 97 * 1000 + seq % 1000 AS arrival FROM readings))
       WHERE top IS NULL OR ts >= top - INTERVAL 60 MINUTE""",
    READINGS,
)
def drop_late(spark, folder):
    """Arrivals shaken by up to 96 places, one hour of patience."""
    seq = F.col("seq")
    arrival = seq * 1000 + (seq * 7919) % 97 * 1000 + seq % 1000
    rows = views.readings(spark, folder).select("site", "ts", "value", arrival.alias("arrival"))
    return sets.drop_late(rows, SITE, "arrival", delay_seconds=HOUR)


# -- gate, correction ------------------------------------------------------------


def gate_sql(source: str, name: str = "gated") -> str:
    """Recursive fold over the numbered readings of ``source``, as a CTE pair."""
    return f"""{name}_n AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, seq) AS rn FROM {source}),
{name} AS (
  SELECT site, rn, ts, seq, produced_at, value, ts AS held_ts, value AS held, value AS gated_value, false AS rejected
  FROM {name}_n WHERE rn = 1
  UNION ALL
  SELECT n.site, n.rn, n.ts, n.seq, n.produced_at, n.value,
         CASE WHEN ok THEN n.ts ELSE held_ts END, CASE WHEN ok THEN n.value ELSE held END,
         CASE WHEN ok THEN n.value ELSE held END, NOT ok
  FROM (SELECT m.*, g.held_ts, g.held,
               m.ts = g.held_ts OR abs((m.value - g.held) / (abs(epoch_us(m.ts) - epoch_us(g.held_ts)) / 1e6 / 60.0)) <= 1.6 AS ok
        FROM {name} g JOIN {name}_n m ON m.site = g.site AND m.rn = g.rn + 1) n)"""


@query("SELECT site, seq, ts, value, gated_value, rejected FROM gated", READINGS, gate_sql("readings"))
def rate_gate(spark, folder):
    rows = views.readings(spark, folder).select("site", "seq", "ts", "value")
    return gate.rate_gate(rows, SITE, seq="seq")


@query(
    "SELECT site, count(*) AS n, CAST(count(*) FILTER (rejected) AS BIGINT) AS n_rejected FROM gated GROUP BY site",
    READINGS,
    gate_sql("readings"),
)
def gate_report(spark, folder):
    rows = views.readings(spark, folder).select("site", "seq", "ts", "value")
    return gate.gate_report(gate.rate_gate(rows, SITE, seq="seq"), SITE)


CORRECT = """SELECT d.site, d.ts, d.value AS temperature,
  CASE WHEN date_diff('microsecond', m.ts, d.ts) <= {us} THEN m.{value} ELSE d.value END AS suggested_temperature,
  d.produced_at,
  CASE WHEN date_diff('microsecond', m.ts, d.ts) <= {us} THEN m.produced_at ELSE 0.0 END AS produced_at_meteo,
  coalesce(date_diff('microsecond', m.ts, d.ts) / 1e6, 0.0) AS time_difference,
  coalesce(date_diff('microsecond', m.ts, d.ts) <= {us}, false) AS meteo_used
FROM {device} d ASOF LEFT JOIN {meteo} m ON d.site = m.site AND d.ts >= m.ts"""


#: The clock of the checked records, and the seconds a station reading took to get to the join.
CLOCK = 10_000.0


def with_stage(station: DataFrame) -> DataFrame:
    """The station's readings with their stage latency, from an arrival time of their own."""
    arrived = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - F.pmod("seq", F.lit(7)) * F.lit(250_000))
    rows = station.withColumns({"arrived_at": arrived, "_now": F.col("ts").cast("timestamp")})
    return wire.with_stage_latency(rows, now=F.col("_now")).drop("arrived_at", "_now")


@query(
    CORRECT.format(us=2 * HOUR * 1_000_000, value="value", device="device", meteo="meteo")
    .replace("AS meteo_used", "AS meteo_used, coalesce(m.seq % 7 * 0.25, 0.0)::DOUBLE AS meteo_stage"),
    READINGS,
    DEVICE,
    METEO,
)
def asof_correct(spark, folder):
    device, meteo = (views.of_type(spark, folder, k) for k in ("view", "click"))
    done = asof.asof_correct(device, with_stage(meteo), SITE, latency="stage", seq="seq", tolerance_seconds=2 * HOUR)
    return done.withColumn("meteo_used", F.coalesce("meteo_used", F.lit(False)))


def first_per_minute(name: str, kind: str) -> str:
    return f"""{name} AS (
  SELECT site, date_trunc('minute', ts) AS ts, value, seq, produced_at FROM readings WHERE source = '{kind}'
  QUALIFY row_number() OVER (PARTITION BY site, date_trunc('minute', ts) ORDER BY seq) = 1)"""


CORRECTED = f"""corrected AS ({CORRECT.format(us=2 * HOUR * 1_000_000, value="gated_value", device="device1", meteo="gated")
    .replace("AS meteo_used", "AS meteo_used, coalesce(m.seq % 7 * 0.25, 0.0)::DOUBLE AS meteo_stage")})"""
RECORD_PARTS = (READINGS, first_per_minute("device1", "view"), first_per_minute("meteo1", "click"), gate_sql("meteo1"), CORRECTED)
RECORD = """SELECT site, ts AS time, temperature, round(suggested_temperature, 6) AS suggested_temperature,
  round(10000.0 - produced_at, 6) AS processing_time, round(10000.0 - produced_at_meteo, 6) AS processing_time_meteo,
  round(time_difference, 6) AS time_difference, meteo_stage AS processing_of_meteo_stage, produced_at AS start_time FROM corrected"""


def corrected_rows(spark, folder):
    device, meteo = (views.minutely(views.of_type(spark, folder, k)) for k in ("view", "click"))
    return correct_device(device, with_stage(meteo), SITE, tolerance_seconds=2 * HOUR)


@query("SELECT * FROM corrected", *RECORD_PARTS)
def correction(spark, folder):
    """De-duplicate both sides, gate the station, correct the device."""
    return corrected_rows(spark, folder).withColumn("meteo_used", F.coalesce("meteo_used", F.lit(False)))


@query(RECORD, *RECORD_PARTS)
def correction_record(spark, folder):
    """The eight fields of every corrected reading."""
    return views.rounded(wire.correction_record(corrected_rows(spark, folder), SITE, now=F.lit(CLOCK)))


# -- JSON records of every layout ------------------------------------------------


def json_sql(layout: str, columns: dict[str, str], source: str, key: str = "seq") -> str:
    """The layout's fields in order, numbers with three places; ``columns`` tells fields that aren't columns of that name."""
    fields = []
    for c in wire.LAYOUTS[layout]:
        text = columns.get(c, c)
        if c == "time":
            text = f"strftime({columns.get(c, 'ts')}, '%Y-%m-%dT%H:%M:%S.%g+00:00')"
        elif c != "source":
            text = f"(round({text}, 3) + 0.0)::DOUBLE"
        fields.append(f"'{c}': {text}")
    return f"SELECT {key}, CAST(to_json({{{', '.join(fields)}}}) AS VARCHAR) AS value FROM {source}"


def as_json(rows: DataFrame, layout: str, key: str = "seq") -> DataFrame:
    return wire.to_wire_json(views.rounded(rows, 3).select(key, *wire.LAYOUTS[layout]), layout)


@query(json_sql("corrected", {"time": "time"}, f"({RECORD})", "site"), *RECORD_PARTS)
def wire_corrected(spark, folder):
    return as_json(wire.correction_record(corrected_rows(spark, folder), SITE, now=F.lit(CLOCK)), "corrected", "site")


MERGED = {"processing_time": "10000.0 - produced_at", "time_at_arrival": "seq % 100 / 4.0", "start_time": "produced_at"}


@query(json_sql("merged", {**MERGED, "temperature": "value"}, "readings"), READINGS)
def wire_merged(spark, folder):
    rows = views.readings(spark, folder).withColumns(
        {"time": F.col("ts"), "temperature": F.col("value"), "time_at_arrival": F.col("seq") % 100 / F.lit(4.0)}
    )
    return as_json(wire.with_latency(rows, now=F.lit(CLOCK)), "merged")


# -- as-of joins -----------------------------------------------------------------

BACKWARD = "backward AS (SELECT d.site, d.ts, d.seq, d.value AS temperature, m.ts AS b_ts, m.value AS b FROM device d ASOF LEFT JOIN meteo m ON d.site = m.site AND d.ts >= m.ts)"
BOTH = "sides AS (SELECT d.*, m.ts AS f_ts, m.value AS f FROM backward d ASOF LEFT JOIN meteo m ON d.site = m.site AND d.ts <= m.ts)"
GAPS = """gaps AS (SELECT *, date_diff('microsecond', b_ts, ts) / 1e6 AS bg, date_diff('microsecond', ts, f_ts) / 1e6 AS fg FROM sides)"""
ASOF = (READINGS, DEVICE, METEO, BACKWARD, BOTH, GAPS)


def asof_rows(spark, folder, direction):
    meteo = views.of_type(spark, folder, "click").select("site", "ts", F.col("value").alias("outdoor_temperature"), "seq")
    base = views.base(spark, folder)
    return asof.asof_join(base, meteo, SITE, ["outdoor_temperature"], "ts", "seq", direction, HOUR)


@query(
    """SELECT site, ts, seq, temperature, CASE WHEN bg <= 3600 THEN b END AS outdoor_temperature,
       CASE WHEN bg <= 3600 THEN bg END AS gap_seconds FROM gaps""",
    *ASOF,
)
def asof_backward(spark, folder):
    return asof_rows(spark, folder, "backward")


@query(
    """SELECT site, ts, seq, temperature, CASE WHEN fg <= 3600 THEN f END AS outdoor_temperature,
       CASE WHEN fg <= 3600 THEN fg END AS gap_seconds FROM gaps""",
    *ASOF,
)
def asof_forward(spark, folder):
    return asof_rows(spark, folder, "forward")


NEAREST = """nearest AS (SELECT *, coalesce(bg <= fg, bg IS NOT NULL) AS earlier FROM gaps)"""


@query(
    """SELECT site, ts, seq, temperature,
       CASE WHEN (CASE WHEN earlier THEN bg ELSE fg END) <= 3600 THEN CASE WHEN earlier THEN b ELSE f END END AS outdoor_temperature,
       CASE WHEN (CASE WHEN earlier THEN bg ELSE fg END) <= 3600 THEN CASE WHEN earlier THEN bg ELSE fg END END AS gap_seconds
       FROM nearest""",
    *ASOF,
    NEAREST,
)
def asof_nearest(spark, folder):
    return asof_rows(spark, folder, "nearest")


@query(
    """SELECT site, ts, seq, CASE WHEN seq % 2 = 0 THEN temperature
       ELSE round((CASE WHEN bg <= 7200 THEN b END + CASE WHEN fg <= 7200 THEN f END) / 2, 6) END AS temperature FROM gaps""",
    *ASOF,
)
def impute_two_sided(spark, folder):
    """Every second device value is taken away and filled from the station."""
    base = views.base(spark, folder).withColumn("temperature", F.when(F.col("seq") % 2 == 0, F.col("temperature")))
    meteo = views.of_type(spark, folder, "click")
    return views.rounded(
        asof.impute_two_sided(base, meteo, SITE, "temperature", seq="seq", gap_seconds=2 * HOUR)
    )


MATCHED = """matched AS (SELECT site, ts, seq, temperature, coalesce(
    CASE WHEN (CASE WHEN earlier THEN bg ELSE fg END) <= 1200 THEN CASE WHEN earlier THEN b ELSE f END END,
    (CASE WHEN bg <= 7200 THEN b END + CASE WHEN fg <= 7200 THEN f END) / 2) AS outdoor_temperature FROM nearest)"""


def matched_rows(spark, folder):
    return asof.match_and_impute(
        views.base(spark, folder), views.of_type(spark, folder, "click"), SITE, seq="seq", gap_seconds=2 * HOUR
    )


@query(
    """SELECT site, ts, seq, temperature, round(outdoor_temperature, 6) AS outdoor_temperature,
       round(outdoor_temperature - temperature, 6) AS temperature_delta FROM matched
       WHERE outdoor_temperature IS NOT NULL""",
    *ASOF,
    NEAREST,
    MATCHED,
)
def match_and_label(spark, folder):
    """Nearest station value within 20 minutes, else imputed; then the label."""
    labelled = features.add_label(matched_rows(spark, folder).na.drop(subset=["outdoor_temperature"]))
    return views.rounded(labelled)


@query(
    """SELECT site, coalesce(d.ts, m.ts) AS ts, d.value AS device, m.value AS station
       FROM (SELECT site, ts, min(value) AS value FROM minutes WHERE source = 'view' GROUP BY ALL) d
       FULL JOIN (SELECT site, ts, min(value) AS value FROM minutes WHERE source = 'click' GROUP BY ALL) m
       USING (site, ts)""",
    READINGS,
    MINUTES,
)
def outer_merge(spark, folder):
    def side(kind, name):
        rows = views.minutely(views.of_type(spark, folder, kind))
        return rows.groupBy("site", "ts").agg(F.min("value").alias(name))

    return side("view", "device").join(side("click", "station"), ["site", "ts"], "full")


@query(
    """SELECT site, d.ts, d.value AS device, m.value AS station
       FROM (SELECT site, ts, min(value) AS value FROM minutes WHERE source = 'view' GROUP BY ALL) d
       LEFT JOIN (SELECT site, ts, min(value) AS value FROM minutes WHERE source = 'click' GROUP BY ALL) m
       USING (site, ts)""",
    READINGS,
    MINUTES,
)
def left_merge(spark, folder):
    def side(kind, name):
        rows = views.minutely(views.of_type(spark, folder, kind))
        return rows.groupBy("site", "ts").agg(F.min("value").alias(name))

    return side("view", "device").join(side("click", "station"), ["site", "ts"], "left")


# -- features --------------------------------------------------------------------

PUMPS = range(4)
FRAME = "c.site = d.site AND c.ts <= d.ts AND c.ts >= d.ts - INTERVAL {hours} HOUR"


def per_pump(text: str, quantity: str) -> str:
    return ", ".join(text.format(p=p, q=quantity) for p in PUMPS)


def window_sql(condition: str, hours: int, columns: str) -> str:
    """Features by a plain range join, grouped per device row."""
    return f"""SELECT d.site, d.ts, d.seq, d.value AS temperature, {columns}
FROM device d LEFT JOIN channels c ON {FRAME.format(hours=hours)} AND {condition}
GROUP BY d.site, d.ts, d.seq, d.value"""


MEAN = (
    "coalesce(round(CAST(sum(CAST(c.value AS DECIMAL(18,2))) FILTER (c.pump = {p} AND c.quantity = '{q}') AS DOUBLE)"
    " / count(*) FILTER (c.pump = {p} AND c.quantity = '{q}'), 6), 0.0) AS {q}_tc{p}"
)
FIRST = "arg_min(c.value, c.ts) FILTER (c.pump = {p} AND c.quantity = '{q}')"
LAST = "arg_max(c.value, c.ts) FILTER (c.pump = {p} AND c.quantity = '{q}')"
SPAN = "((epoch_us(max(c.ts) FILTER (c.pump = {p} AND c.quantity = '{q}')) - epoch_us(min(c.ts) FILTER (c.pump = {p} AND c.quantity = '{q}'))) / 1e6)"
COUNT = "count(*) FILTER (c.pump = {p} AND c.quantity = '{q}')"
RATE = (
    f"CASE WHEN {COUNT} > 1 THEN round(({LAST} - {FIRST}) / {SPAN}, 6) ELSE 0.0 END AS {{q}}_tc{{p}}_rate, "
    f"CASE WHEN {COUNT} > 1 THEN {FIRST} ELSE 0.0 END AS {{q}}_tc{{p}}_value, {COUNT} AS {{q}}_tc{{p}}_n"
)


@query(window_sql("true", 6, per_pump(MEAN, "prikon")), READINGS, DEVICE, CHANNELS)
def window_mean(spark, folder):
    done = features.window_features(
        views.base(spark, folder), views.channels(spark, folder), SITE, "prikon", "mean", seq="seq", window_seconds=6 * HOUR
    )
    return views.rounded(done)


@query(window_sql("true", 24, per_pump(RATE, "prikon")), READINGS, DEVICE, CHANNELS)
def window_rate(spark, folder):
    done = features.window_features(
        views.base(spark, folder), views.channels(spark, folder), SITE, "prikon", "rate", seq="seq", window_seconds=24 * HOUR
    )
    return views.rounded(done)


def latest_sql(quantity: str, name: str) -> str:
    """Last value of each pump up to each device row."""
    joins = " ".join(
        f"ASOF LEFT JOIN (SELECT * FROM channels WHERE pump = {p} AND quantity = '{quantity}') c{p}"
        f" ON d.site = c{p}.site AND d.ts >= c{p}.ts"
        for p in PUMPS
    )
    columns = ", ".join(f"coalesce(c{p}.value, 0.0) AS {name.format(p=p, q=quantity)}" for p in PUMPS)
    return f"SELECT d.site, d.ts, d.seq, d.value AS temperature, {columns} FROM device d {joins}"


@query(latest_sql("fanh", "{q}_tc{p}"), READINGS, DEVICE, CHANNELS)
def latest_values(spark, folder):
    return features.latest_values(views.base(spark, folder), views.channels(spark, folder), SITE, "fanh", seq="seq")


@query(
    f"""SELECT w.site, w.ts, w.seq, w.temperature, {", ".join(f"tl_tc{p}_rate, CASE WHEN tl_tc{p}_n > 1 THEN tl_tc{p}_value ELSE last_tc{p} END AS tl_tc{p}_value, tl_tc{p}_n" for p in PUMPS)}
    FROM ({window_sql("true", 12, per_pump(RATE, "tl"))}) w JOIN ({latest_sql("tl", "last_tc{p}")}) l USING (seq)""",
    READINGS,
    DEVICE,
    CHANNELS,
)
def carry_forward(spark, folder):
    done = features.window_features(
        views.base(spark, folder), views.channels(spark, folder), SITE, "tl", "rate", True, seq="seq", window_seconds=12 * HOUR
    )
    return views.rounded(done)


RATE_FEATURES = [
    features.Feature("prikon", "rate"),
    features.Feature("tl", "rate", carry_forward=True),
    features.Feature("fanh", "rate"),
]
MEAN_FEATURES = [features.Feature("fanh", "latest"), features.Feature("prikon", "mean")]


@query(
    f"""SELECT w.site, w.ts, w.seq, w.temperature, {", ".join(f"prikon_tc{p}_rate, prikon_tc{p}_value, prikon_tc{p}_n, fanh_tc{p}_rate, fanh_tc{p}_value, fanh_tc{p}_n, tl_tc{p}_rate, CASE WHEN tl_tc{p}_n > 1 THEN tl_tc{p}_value ELSE last_tc{p} END AS tl_tc{p}_value, tl_tc{p}_n" for p in PUMPS)}
    FROM ({window_sql("true", 12, ", ".join(per_pump(RATE, q) for q in ("prikon", "tl", "fanh")))}) w
    JOIN ({latest_sql("tl", "last_tc{p}")}) l USING (seq)""",
    READINGS,
    DEVICE,
    CHANNELS,
)
def fused_rates(spark, folder):
    """All three quantities of all pumps in one exchange."""
    done = features.fused_features(
        views.base(spark, folder), views.channels(spark, folder), SITE, RATE_FEATURES, seq="seq", window_seconds=12 * HOUR
    )
    return views.rounded(done)


RATE_FIELDS = {"processing_time": "10000.0 - seq / 1000.0"}


@query(
    json_sql("rates", RATE_FIELDS, "rates"),
    READINGS,
    DEVICE,
    CHANNELS,
    "rates AS (" + SQL["fused_rates"].removeprefix(f"WITH RECURSIVE {READINGS}, {DEVICE}, {CHANNELS}\n") + ")",
)
def wire_rates(spark, folder):
    rows = features.fused_features(
        views.base(spark, folder), views.channels(spark, folder), SITE, RATE_FEATURES, seq="seq", window_seconds=12 * HOUR
    )
    rows = rows.withColumns({"time": F.col("ts"), "produced_at": F.col("seq") / F.lit(1000.0)})
    return as_json(views.rounded(wire.with_latency(rows, now=F.lit(CLOCK))), "rates")


@query(
    f"""SELECT w.*, {", ".join(f"fanh_tc{p}" for p in PUMPS)}
    FROM ({window_sql("true", 6, per_pump(MEAN, "prikon"))}) w JOIN ({latest_sql("fanh", "{q}_tc{p}")}) l USING (seq)""",
    READINGS,
    DEVICE,
    CHANNELS,
)
def fused_means(spark, folder):
    done = features.fused_features(
        views.base(spark, folder), views.channels(spark, folder), SITE, MEAN_FEATURES, seq="seq", window_seconds=6 * HOUR
    )
    return views.rounded(done)


@query(
    """SELECT d.site, d.ts, d.temperature, m.power FROM
       (SELECT site, ts, value AS temperature FROM minutes WHERE source = 'view'
        QUALIFY row_number() OVER (PARTITION BY site, ts ORDER BY seq) = 1) d
       JOIN (SELECT site, ts, value AS power FROM minutes WHERE source = 'error'
        QUALIFY row_number() OVER (PARTITION BY site, ts ORDER BY seq) = 1) m USING (site, ts)""",
    READINGS,
    MINUTES,
)
def exact_join(spark, folder):
    def side(kind, name):
        return views.minutely(views.of_type(spark, folder, kind)).select("site", "ts", F.col("value").alias(name), "seq")

    return features.exact_join(side("view", "temperature"), side("error", "power"), SITE, seq="seq").drop("seq")


LAGS = "lags AS (SELECT site, seq, ts, value, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2 FROM readings WINDOW w AS (PARTITION BY site ORDER BY ts, seq))"


@query("SELECT * FROM lags", READINGS, LAGS)
def lag_features(spark, folder):
    rows = views.readings(spark, folder).select("site", "seq", "ts", "value")
    return features.lag_features(rows, SITE, ["value", "not_there"], windows=(), seq="seq")


@query(
    """SELECT site, seq, ts, value,
       CASE WHEN count(value) OVER w3 = 3 THEN round(avg(value) OVER w3, 6) END AS value_roll3_mean,
       CASE WHEN count(value) OVER w6 = 6 THEN round(avg(value) OVER w6, 6) END AS value_roll6_mean
       FROM readings
       WINDOW w3 AS (PARTITION BY site ORDER BY ts, seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
              w6 AS (PARTITION BY site ORDER BY ts, seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
    READINGS,
)
def rolling_features(spark, folder):
    rows = views.readings(spark, folder).select("site", "seq", "ts", "value")
    return views.rounded(features.rolling_features(rows, SITE, ["value"], seq="seq"))


# -- rolling filter --------------------------------------------------------------

CENTRED = "(PARTITION BY site ORDER BY ts, seq ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)"
SMOOTH = f"smooth AS (SELECT *, CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END AS m FROM readings WINDOW w AS {CENTRED})"
MAD = f"mad AS (SELECT *, CASE WHEN count(m) OVER w >= 5 THEN avg(abs(value - m)) OVER w END AS d FROM smooth WINDOW w AS {CENTRED})"


@query("SELECT site, seq, ts, value, round(m, 6) AS rolling_mean FROM smooth", READINGS, SMOOTH)
def rolling_mean(spark, folder):
    rows = views.readings(spark, folder).select("site", "seq", "ts", "value")
    return views.rounded(rolling.rolling_mean(rows, SITE, seq="seq"))


@query("SELECT site, seq, ts, value, round(m, 6) AS rolling_mean, round(d, 6) AS rolling_mad FROM mad", READINGS, SMOOTH, MAD)
def rolling_mad(spark, folder):
    rows = views.readings(spark, folder).select("site", "seq", "ts", "value")
    return views.rounded(rolling.rolling_mad(rows, SITE, seq="seq"))


@query("SELECT site, seq, ts, value FROM mad WHERE abs(value - m) < 3 * 1.4826 * d", READINGS, SMOOTH, MAD)
def mad_filter(spark, folder):
    rows = views.readings(spark, folder).select("site", "seq", "ts", "value")
    return rolling.mad_filter(rows, SITE, seq="seq")


CLEAN = f"""clean AS (SELECT * FROM (
    SELECT *, CASE WHEN count(m) OVER w >= 5 THEN avg(abs(value - m)) OVER w END AS d FROM (
      SELECT *, CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END AS m
      FROM meteo WINDOW w AS {CENTRED}) WINDOW w AS {CENTRED}) WHERE abs(value - m) < 3 * 1.4826 * d)"""
MERGED = """merged AS (SELECT site, ts, value AS temperature, seq FROM readings WHERE source IN ('view', 'error')
    QUALIFY row_number() OVER (PARTITION BY site, ts ORDER BY source <> 'view', seq) = 1)"""
TRAINING = """labelled AS (
  SELECT site, ts, seq, temperature, round(o - temperature, 6) AS temperature_delta FROM (
    SELECT *, coalesce(
        CASE WHEN (CASE WHEN coalesce(bg <= fg, bg IS NOT NULL) THEN bg ELSE fg END) <= 1200
             THEN CASE WHEN coalesce(bg <= fg, bg IS NOT NULL) THEN b ELSE f END END,
        (CASE WHEN bg <= 7200 THEN b END + CASE WHEN fg <= 7200 THEN f END) / 2) AS o
    FROM (SELECT x.*, date_diff('microsecond', x.b_ts, x.ts) / 1e6 AS bg,
                 date_diff('microsecond', x.ts, f.ts) / 1e6 AS fg, f.value AS f
          FROM (SELECT d.*, m.ts AS b_ts, m.value AS b FROM merged d ASOF LEFT JOIN clean m ON d.site = m.site AND d.ts >= m.ts) x
          ASOF LEFT JOIN clean f ON x.site = f.site AND x.ts <= f.ts))
  WHERE o IS NOT NULL)"""


@query(
    """SELECT * EXCLUDE (rn) FROM (SELECT *, lag(temperature, 1) OVER w AS temperature_lag1, lag(temperature, 2) OVER w AS temperature_lag2,
       round(avg(temperature) OVER (PARTITION BY site ORDER BY ts, seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS temperature_roll3_mean,
       round(avg(temperature) OVER (PARTITION BY site ORDER BY ts, seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 6) AS temperature_roll6_mean,
       row_number() OVER w AS rn FROM labelled WINDOW w AS (PARTITION BY site ORDER BY ts, seq)) WHERE rn > 6""",
    READINGS,
    METEO,
    CLEAN,
    MERGED,
    TRAINING,
)
def training_rows(spark, folder):
    """Two exports merged, cleaned station matched and imputed, label, lags."""
    exports = [
        views.of_type(spark, folder, k).select("site", "ts", F.col("value").alias("temperature"), "seq")
        for k in ("view", "error")
    ]
    station = views.of_type(spark, folder, "click").select("site", "ts", "value", "seq")
    done = training_table(exports, station, SITE, ["temperature"], seq="seq", gap_seconds=2 * HOUR)
    return views.rounded(done)


M2_COLUMNS = ["temperature", *model_features.RATE_FEATURES[1:]]
M2_COLUMNS = [c for c in M2_COLUMNS if c not in ("fanh_tc2_rate", "fanh_tc3_rate")]


def _shifts(c: str) -> str:
    means = (f"round(avg({c}) OVER (PARTITION BY site ORDER BY ts, seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS {c}_roll{n}_mean" for n in (3, 6))
    return ", ".join([f"lag({c}, {n}) OVER w AS {c}_lag{n}" for n in (1, 2)] + list(means))


M2_RATES = SQL["fused_rates"].removeprefix(f"WITH RECURSIVE {READINGS}, {DEVICE}, {CHANNELS}\n").replace(", 6)", ", 4)")
M2_MERGED = f"""merged AS (SELECT site, ts, seq, {", ".join(M2_COLUMNS)} FROM ({M2_RATES})
    QUALIFY row_number() OVER (PARTITION BY site, ts ORDER BY seq % 3 = 0, seq) = 1)"""


@query(
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, {", ".join(_shifts(c) for c in M2_COLUMNS)},
    row_number() OVER w AS rn FROM (SELECT m.*, temperature_delta FROM merged m JOIN (SELECT site, seq, temperature_delta FROM labelled) USING (site, seq))
    WINDOW w AS (PARTITION BY site ORDER BY ts, seq)) WHERE rn > 6""",
    READINGS,
    DEVICE,
    METEO,
    CHANNELS,
    CLEAN,
    M2_MERGED,
    TRAINING,
)
def training_table_m2(spark, folder):
    """Two exports of 23 columns merged, matched, labelled, and 92 columns derived from them."""
    made = features.fused_features(
        views.base(spark, folder), views.channels(spark, folder), SITE, RATE_FEATURES, seq="seq", window_seconds=12 * HOUR
    )
    rows = stored(views.rounded(made, 4).select("site", "ts", "seq", *M2_COLUMNS), "export")
    station = views.of_type(spark, folder, "click").select("site", "ts", "value", "seq")
    exports = [rows.filter(F.col("seq") % 3 != 0), rows]
    return views.rounded(training_table(exports, station, SITE, M2_COLUMNS, seq="seq", gap_seconds=2 * HOUR))


@query(
    """SELECT 'outliers' AS step, (SELECT count(*) FROM meteo) AS n_rows, (SELECT count(*) FROM meteo) - (SELECT count(*) FROM clean) AS n_removed
       UNION ALL SELECT 'unmatched', (SELECT count(*) FROM merged), (SELECT count(*) FROM merged) - (SELECT count(*) FROM labelled)""",
    READINGS,
    METEO,
    CLEAN,
    MERGED,
    TRAINING,
)
def removed_rows(spark, folder):
    """What the filters of the training table removed, counted while it was made."""
    watch = {name: Observation(f"{name}-{uuid.uuid4().hex}") for name in ("outliers", "unmatched")}
    exports = [
        views.of_type(spark, folder, k).select("site", "ts", F.col("value").alias("temperature"), "seq")
        for k in ("view", "error")
    ]
    station = views.of_type(spark, folder, "click").select("site", "ts", "value", "seq")
    training_table(exports, station, SITE, ["temperature"], seq="seq", gap_seconds=2 * HOUR, observed=watch)
    rows = [(name, o.get["n_rows"], o.get["n_rows"] - o.get["n_kept"]) for name, o in watch.items()]
    return spark.createDataFrame(rows, "step string, n_rows long, n_removed long")


# -- resampling ------------------------------------------------------------------

# Sums are taken over exact decimals on both sides.
MONEY = "decimal(18,2)"
HOURLY = """hourly AS (
  SELECT g.site, g.source, g.ts, coalesce(CAST(s.v AS DOUBLE), 0.0) / 60 AS kwh
  FROM (SELECT site, source, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS ts
        FROM readings GROUP BY site, source) g
  LEFT JOIN (SELECT site, source, date_trunc('hour', ts) AS ts, sum(CAST(value AS DECIMAL(18,2))) AS v FROM readings GROUP BY ALL) s
  USING (site, source, ts))"""


@query("SELECT site, source, ts, round(kwh, 6) AS kwh FROM hourly", READINGS, HOURLY)
def hourly_energy(spark, folder):
    rows = views.readings(spark, folder).withColumn("value", F.col("value").cast(MONEY))
    return views.naive(views.rounded(resample.hourly_energy(rows, ["site", "source"])))


@query(
    "SELECT site, source, date_trunc('day', ts) AS ts, round(sum(kwh), 4) AS kwh FROM hourly GROUP BY 1, 2, 3",
    READINGS,
    HOURLY,
)
def daily_energy(spark, folder):
    rows = views.readings(spark, folder).withColumn("value", F.col("value").cast(MONEY))
    days = resample.daily_energy(rows, ["site", "source"])
    return views.naive(views.rounded(days, 4)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    """SELECT source, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, date_trunc('hour', min(ts)) AS hour_ts
       FROM readings GROUP BY 1, 2, 3""",
    READINGS,
)
def date_hour_sum(spark, folder):
    rows = views.readings(spark, folder)
    done = resample.date_hour_sum(rows, ["source"], value=F.col("value").cast(MONEY))
    return views.naive(done.withColumn("value", F.col("value").cast("double")))


@query(
    """SELECT ts, click, purchase, error, signup, click + purchase + error + signup AS total_value FROM (
       SELECT date_trunc('hour', ts) AS ts,
       CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (source = 'click'), 0) AS DOUBLE) AS click,
       CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (source = 'purchase'), 0) AS DOUBLE) AS purchase,
       CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (source = 'error'), 0) AS DOUBLE) AS error,
       CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (source = 'signup'), 0) AS DOUBLE) AS signup
       FROM readings WHERE source <> 'view' GROUP BY 1)""",
    READINGS,
)
def total_power(spark, folder):
    rows = views.readings(spark, folder).select(
        F.date_trunc("hour", "ts").alias("ts"), "source", F.col("value").cast(MONEY).alias("value")
    )
    names = list(views.PUMP_OF)
    wide = resample.total_power(rows, "source", names)
    amounts = [F.col(c).cast("double").alias(c) for c in names]
    total = sum((F.col(n).cast("double") for n in names[1:]), F.col(names[0]).cast("double"))
    return views.naive(wide.select("ts", *amounts, total.alias("total_value")))


# -- profiles --------------------------------------------------------------------


@query(
    """SELECT source, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM readings GROUP BY source""",
    READINGS,
)
def describe_series(spark, folder):
    return views.rounded(profile.describe_series(views.readings(spark, folder).select("source", "value"), ["source"]))


INTERVALS = "intervals AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY site ORDER BY ts, seq))) / 1e6 AS s FROM readings)"


@query(
    """SELECT site, round(avg(s), 6) AS mean_interval, round(quantile_cont(s, 0.5), 6) AS median_interval,
       min(s) AS min_interval, max(s) AS max_interval FROM intervals GROUP BY site""",
    READINGS,
    INTERVALS,
)
def interval_stats(spark, folder):
    return views.rounded(profile.interval_stats(views.readings(spark, folder), SITE, seq="seq"))


@query("SELECT site, seq, ts, s AS interval_seconds FROM intervals WHERE s > 7200", READINGS, INTERVALS)
def find_gaps(spark, folder):
    rows = views.readings(spark, folder).select("site", "seq", "ts")
    return profile.find_gaps(rows, SITE, seq="seq", longer_than_seconds=2 * HOUR)


@query(
    """SELECT count(*) AS n, round(avg(abs(x)), 6) AS mae, round(sqrt(avg(x * x)), 6) AS rmse
       FROM (SELECT outdoor_temperature - temperature AS x FROM matched WHERE outdoor_temperature IS NOT NULL)""",
    *ASOF,
    NEAREST,
    MATCHED,
)
def baseline_metrics(spark, folder):
    """Error of leaving the device's value as it is."""
    labelled = features.add_label(matched_rows(spark, folder).na.drop(subset=["outdoor_temperature"]))
    return views.rounded(profile.regression_metrics(labelled, F.col("temperature_delta")))


@query(
    """SELECT 'temperature' AS column_name, count(*) AS n, count(*) - count(temperature) AS n_null,
       round(100.0 * (count(*) - count(temperature)) / count(*), 6) AS pct_null FROM matched
       UNION ALL SELECT 'outdoor_temperature', count(*), count(*) - count(outdoor_temperature),
       round(100.0 * (count(*) - count(outdoor_temperature)) / count(*), 6) FROM matched""",
    *ASOF,
    NEAREST,
    MATCHED,
)
def null_profile(spark, folder):
    return views.rounded(profile.null_profile(matched_rows(spark, folder), ["temperature", "outdoor_temperature"]))


@query(
    """SELECT site, CAST(sum(c) AS BIGINT) AS n, CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS n_in_duplicates,
       CAST(count(*) FILTER (c > 1) AS BIGINT) AS n_duplicated_times
       FROM (SELECT site, ts, count(*) AS c FROM minutes GROUP BY ALL) GROUP BY site""",
    READINGS,
    MINUTES,
)
def duplicate_profile(spark, folder):
    return profile.duplicate_profile(views.minutely(views.readings(spark, folder)), SITE)


@query("SELECT site, min(ts) AS first_ts, max(ts) AS last_ts FROM readings GROUP BY site", READINGS)
def time_bounds(spark, folder):
    return profile.time_bounds(views.readings(spark, folder), SITE)


@query(
    """SELECT CAST(b AS INTEGER) AS bin, count(value) AS n, round(lo + (b - 1) * ((hi - lo) / 50), 6) AS bin_start
       FROM range(1, 51) bins(b) CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM readings)
       LEFT JOIN readings ON b = least(floor((value - lo) / ((hi - lo) / 50)) + 1, 50) GROUP BY b, lo, hi""",
    READINGS,
)
def histogram(spark, folder):
    return views.rounded(profile.histogram(views.readings(spark, folder)))


@query("SELECT seq, value FROM readings ORDER BY value DESC, seq LIMIT 10", READINGS)
def top_k(spark, folder):
    return views.readings(spark, folder).select("seq", "value").orderBy(F.col("value").desc(), "seq").limit(10)


@query("SELECT seq, ts, value FROM readings ORDER BY ts, seq LIMIT 5 OFFSET 300", READINGS)
def positional_slice(spark, folder):
    """Rows 300 to 304 in time order; each task keeps only what can be among them."""
    return views.readings(spark, folder).select("seq", "ts", "value").orderBy("ts", "seq").offset(300).limit(5)


@query(
    """SELECT site, count(*) FILTER (source = 'view') AS n_unrouted,
       count(*) FILTER (source <> 'view') AS n_routed FROM readings GROUP BY site""",
    READINGS,
)
def routing_report(spark, folder):
    """Readings per site whose source names a pump, and those that are left out."""
    pump = wire.pump_index(views.entity_of(F.col("source")))
    return views.readings(spark, folder).groupBy("site").agg(
        F.count_if(pump.isNull()).alias("n_unrouted"), F.count_if(pump.isNotNull()).alias("n_routed")
    )


@query("SELECT site, value, seq, produced_at FROM readings", READINGS)
def numeric_columns(spark, folder):
    """What a selection of numbers by type keeps."""
    rows = views.readings(spark, folder)
    return rows.select(*profile.numeric_columns(rows))


# -- splits ----------------------------------------------------------------------


@query(
    """SELECT seq, ts, row_number() OVER (ORDER BY ts, seq) > count(*) OVER () - floor(count(*) OVER () * 0.2) AS is_test
       FROM readings""",
    READINGS,
)
def time_split(spark, folder):
    rows = views.readings(spark, folder).select("seq", "ts")
    return split.time_split(rows, seq="seq")


@query(
    """SELECT site, seq, ts, CAST(CASE WHEN i < 0 THEN 0 ELSE floor(i / s) + 1 END AS INTEGER) AS fold FROM (
       SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, seq) - 1 - (n - 5 * s) AS i FROM (
       SELECT *, count(*) OVER (PARTITION BY site) AS n, count(*) OVER (PARTITION BY site) // 6 AS s FROM readings))""",
    READINGS,
)
def cv_folds(spark, folder):
    rows = views.readings(spark, folder).select("site", "seq", "ts")
    return split.time_series_folds(rows, 5, SITE, seq="seq")
