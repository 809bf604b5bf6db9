"""Wire records: parsing, serialising, routing, latencies, time zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone of the plant, for viewing only (fixed value).
LOCAL_ZONE = "Europe/Prague"

_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"
_ZONE = r"[T ].*([Zz]|[+-]\d{2}(:?\d{2})?)$"
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$"
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"


def parse_time(text: Column) -> Column:
    """UTC instant of an ISO-8601 text with offset, ``Z`` or no zone (= UTC)."""
    dated = F.when(text.rlike(_DATE_ONLY), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    zoned = F.when(dated.rlike(_ZONE), dated).otherwise(F.concat(dated, F.lit("Z")))
    return F.when(text.rlike(_ISO_DATE), F.try_to_timestamp(zoned))


def parse_number(text: Column) -> Column:
    """A decimal number; type suffixes as in ``12d`` are no part of one."""
    text = F.trim(text)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_readings(
    df: DataFrame, raw: str = "value", on_error: str = "fail"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """JSON text to ``ts, value, source, produced_at``.

    ``time`` and ``value`` must be there; ``source`` defaults to an empty text
    and ``processing_time_ms`` to 0. ``on_error="fail"`` stops the job at a bad
    record, ``"route"`` returns (good readings, bad records).
    """
    # A generator reads each text once, however many expressions use its fields.
    names = ["time", "value", "source", "processing_time_ms"]
    fields = F.json_tuple(raw, *names).alias(*[f"_{n}" for n in names])
    opened = df.select("*", fields).withColumns(
        {
            "_ts": parse_time(F.col("_time")),
            "_v": parse_number(F.col("_value")),
            "_p": parse_number(F.col("_processing_time_ms")),
        }
    )
    bad = (
        F.col("_ts").isNull()
        | F.col("_v").isNull()
        | (F.col("_processing_time_ms").isNotNull() & F.col("_p").isNull())
    )
    others = [c for c in df.columns if c != raw]

    def readings(rows: DataFrame, ts: Column) -> DataFrame:
        return rows.select(
            *others,
            ts.alias("ts"),
            F.col("_v").alias("value"),
            F.coalesce(F.col("_source"), F.lit("")).alias("source"),
            F.coalesce(F.col("_p"), F.lit(0.0)).alias("produced_at"),
        )

    if on_error == "fail":
        message = F.concat(F.lit("bad sensor record: "), F.substring(F.coalesce(raw, F.lit("null")), 1, 100))
        checked = F.when(bad, F.raise_error(message).cast("timestamp")).otherwise(F.col("_ts"))
        return readings(opened, checked)
    if on_error == "route":
        return readings(opened.filter(~bad), F.col("_ts")), opened.filter(bad).select(*df.columns)
    raise ValueError(f"on_error must be 'fail' or 'route', not {on_error!r}")


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSxxx")


_PUMPS = range(4)

# Fields of each output record, in order (fixed values).
LAYOUTS = {
    "corrected": [
        "time", "temperature", "suggested_temperature", "processing_time",
        "processing_time_meteo", "time_difference", "processing_of_meteo_stage", "start_time",
    ],
    "gated": ["time", "temperature", "processing_time", "start_time"],
    "scored": [
        "time", "temperature", *[f"fanh_tc{p}" for p in _PUMPS],
        *[f"prikon_tc{p}" for p in _PUMPS], "processing_time", "delta", "original_temperature",
    ],
    "rates": [
        "time", "temperature",
        *[f"{q}_tc{p}_{part}" for q in ("prikon", "tl", "fanh") for part in ("rate", "value") for p in _PUMPS],
        "processing_time",
    ],
    "merged": [
        "time", "temperature", "source", "processing_time", "time_at_arrival", "start_time",
    ],
}


def to_wire_json(df: DataFrame, layout: str, name: str = "value") -> DataFrame:
    """One JSON text per row with the fields of ``layout``, taken by name.

    ``time`` is written with milliseconds and offset. NaN and infinite numbers
    are not valid JSON and stop the job.
    """
    kinds = dict(df.dtypes)
    fields = []
    for c in LAYOUTS[layout]:
        column = F.col(c)
        if c == "time":
            column = iso_millis(column)
        elif kinds[c] in ("double", "float"):
            wrong = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
            stop = F.raise_error(F.lit(f"{c} is not a finite number")).cast(kinds[c])
            column = F.when(wrong, stop).otherwise(column)
        fields.append(column.alias(c))
    kept = [c for c in df.columns if c not in LAYOUTS[layout]]
    return df.select(*kept, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))


def with_latency(df: DataFrame, produced: str = "produced_at", now: Column | None = None) -> DataFrame:
    """Latency since the producer's clock, in seconds, and that clock's value.

    ``now`` defaults to the start of the query or micro-batch.
    """
    now = F.unix_micros(F.current_timestamp()) / F.lit(1e6) if now is None else now
    return df.withColumns({"processing_time": now - F.col(produced), "start_time": F.col(produced)})


def with_stage_latency(
    df: DataFrame, arrived: str = "arrived_at", name: str = "stage", now: Column | None = None
) -> DataFrame:
    """Seconds between arrival (e.g. the broker's timestamp) and this step."""
    now = F.current_timestamp() if now is None else now
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(arrived).cast("timestamp"))) / F.lit(1e6)
    return df.withColumn(name, seconds)


def correction_record(corrected: DataFrame, key: Sequence[str] = (), ts: str = "ts", now: Column | None = None) -> DataFrame:
    """The eight fields of a corrected reading: both latencies by the clock ``now``, skew, and the station's stage.

    ``corrected`` comes from the correction in batch or as a stream. Without a
    station reading its producer's clock is 0.
    """
    timed = with_latency(corrected, now=now)
    clock = F.col("processing_time") + F.col("produced_at")
    return timed.select(
        *key,
        F.col(ts).alias("time"),
        "temperature",
        "suggested_temperature",
        "processing_time",
        (clock - F.col("produced_at_meteo")).alias("processing_time_meteo"),
        "time_difference",
        F.col("meteo_stage").alias("processing_of_meteo_stage"),
        "start_time",
    )


def pump_index(source: Column) -> Column:
    """Number of the heat pump named in ``source``; null if none is.

    The names are tried in order and the first match counts.
    """
    chain = F.when(source.contains("tcstav0"), 0)
    for p in (1, 2, 3):
        chain = chain.when(source.contains(f"tcstav{p}"), p)
    return chain


def quantity_of(source: Column) -> Column:
    """The quantity at the end of a pump's series name."""
    return F.regexp_extract(source, r"tcstav\d_([a-z]+)$", 1)


def local_time(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall-clock time in ``zone``, without zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def series_label(path: Column) -> Column:
    """Display name of a series file: ``a/b_c.csv`` becomes ``B C``."""
    stem = F.replace(F.regexp_extract(path, r"([^/\\]+)$", 1), F.lit(".csv"), F.lit(""))
    return F.initcap(F.replace(stem, F.lit("_"), F.lit(" ")))
