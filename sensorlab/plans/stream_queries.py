"""Streaming jobs over the events table as a file stream.

One closing row far in the future pushes the watermark past all readings; it
belongs to no site and is left out of the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlab.functions import wire
from sensorlab.plans import batch_queries as batch
from sensorlab.plans import views
from sensorlab.session import fresh_folder, use_utc
from sensorlab.streaming import jobs

QUERIES, SQL = {}, {}


def query(sql: str, *parts: str):
    def keep(function):
        QUERIES[function.__name__] = function
        with_parts = "WITH RECURSIVE " + ", ".join(parts) + "\n" if parts else ""
        SQL[function.__name__] = with_parts + sql
        return function

    return keep


def stream(spark: SparkSession, folder: str, minutes: bool = False) -> DataFrame:
    """All events as a stream of readings, with the closing row."""
    use_utc(spark)
    path = f"{folder}/events.parquet"
    events = spark.read.parquet(path)
    closing = fresh_folder(spark, "closing")
    values = {
        "event_id": F.lit(-1),
        "ts": F.lit("2100-01-01 00:00:00"),
        "user_id": F.lit(None),
        "event_type": F.lit(""),
        "value": F.lit(0.0),
    }
    end = spark.range(1).select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
    )
    end.write.parquet(closing)
    source = spark.readStream.schema(events.schema)
    # As a pattern the path may name a single file as well as a folder of files.
    rows = source.parquet(f"{folder}/events.parque[t]").unionByName(source.parquet(closing))
    ts = F.col("ts").cast("timestamp")
    return rows.select(
        F.coalesce(F.pmod("user_id", F.lit(views.SITES)), F.lit(-1)).cast("long").alias("site"),
        (F.date_trunc("minute", ts) if minutes else ts).alias("ts"),
        F.col("event_id").alias("seq"),
        "value",
        F.col("event_type").alias("source"),
        (F.col("event_id") / F.lit(1000.0)).alias("produced_at"),
    )


def side(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter(F.col("source").isin(kind, ""))


@query(batch.RECORD, *batch.RECORD_PARTS)
def stream_correction(spark, folder):
    """The eight fields of every corrected reading, from one stateful step."""
    rows = stream(spark, folder, minutes=True)
    station = batch.with_stage(side(rows, "click"))
    done = jobs.correction_job(side(rows, "view"), station, ["site"], tolerance_seconds=2 * batch.HOUR)
    out = jobs.run_available(done.filter("site >= 0"), "stream-correction")
    return views.naive(views.rounded(wire.correction_record(out, ["site"], now=F.lit(batch.CLOCK))))


@query(
    """SELECT site, ts, seq, gated_value AS value, rejected,
       sum(rejected::INT) OVER (PARTITION BY site ORDER BY ts)::BIGINT AS n_rejected FROM gated""",
    batch.READINGS,
    batch.first_per_minute("device1", "view"),
    batch.gate_sql("device1"),
)
def stream_gate(spark, folder):
    """Gated readings with the running count of rejections."""
    done = jobs.sensor_gate_job(side(stream(spark, folder, minutes=True), "view"), ["site"]).filter("site >= 0")
    out = jobs.run_available(done.select("site", "ts", "seq", "value", "rejected", "n_rejected"), "stream-gate")
    return views.naive(out)


def stream_channels(rows: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(q) for q in views.QUANTITIES])
    return rows.filter(F.col("source") != "view").select(
        "site",
        "ts",
        "seq",
        F.coalesce(views.pump_of(F.col("source")), F.lit(0)).alias("pump"),
        F.element_at(kinds, (F.pmod("seq", F.lit(3)) + 1).cast("int")).alias("quantity"),
        "value",
    )


def stream_base(rows: DataFrame) -> DataFrame:
    return side(rows, "view").withColumnRenamed("value", "temperature")


def feature_rows(spark, folder, features, hours, label):
    rows = stream(spark, folder)
    done = jobs.feature_job(
        stream_base(rows), stream_channels(rows), ["site"], features, hours * batch.HOUR, delay="0 seconds"
    ).filter("site >= 0").drop("produced_at")
    return views.naive(views.rounded(jobs.run_available(done, label)))


@query(batch.SQL["fused_means"])
def stream_features(spark, folder):
    return feature_rows(spark, folder, batch.MEAN_FEATURES, 6, "stream-features")


@query(batch.SQL["fused_rates"])
def stream_rates(spark, folder):
    return feature_rows(spark, folder, batch.RATE_FEATURES, 12, "stream-rates")


@query("SELECT DISTINCT site, ts FROM minutes", batch.READINGS, batch.MINUTES)
def stream_dedup(spark, folder):
    rows = stream(spark, folder, minutes=True).filter("site >= 0").select("site", "ts")
    return views.naive(jobs.run_available(jobs.dedup_stream(rows, ["site"], "1 minute"), "stream-dedup"))


@query(batch.SQL["exact_join"])
def stream_exact_join(spark, folder):
    """Pairs of equal time with the values of both sides."""
    rows = stream(spark, folder, minutes=True)
    left = side(rows, "view").select("site", "ts", "seq", F.col("value").alias("temperature"))
    right = side(rows, "error").select("site", "ts", "seq", F.col("value").alias("power"))
    done = jobs.exact_join_stream(left, right, ["site"], seq="seq").filter("site >= 0")
    return views.naive(jobs.run_available(done, "stream-join"))


@query("SELECT site, ts, seq, value FROM readings WHERE source = 'view'", batch.READINGS)
def stream_once(spark, folder):
    """Readings written batch by batch, each batch once however often it runs; read back by their marks."""
    rows = side(stream(spark, folder), "view").filter("site >= 0").select("site", "ts", "seq", "value")
    place = fresh_folder(spark, "once")
    for _ in range(2):  # the second run finds nothing to do
        jobs.start_once(rows, place, f"{place}/checkpoint").awaitTermination()
    return views.naive(jobs.read_once(spark, place, rows.schema))


@query("SELECT site, ts, value, source FROM readings WHERE source IN ('view', 'click')", batch.READINGS)
def stream_merge(spark, folder):
    """JSON records of two topics parsed and merged, then read back."""
    rows = stream(spark, folder).filter("site >= 0")
    text = rows.select(
        "site",
        "source",
        F.to_json(F.struct(wire_time().alias("time"), "value", "source")).alias("value"),
    )
    parsed = [
        wire.parse_readings(text.filter(F.col("source") == k).drop("source")) for k in ("view", "click")
    ]
    merged = jobs.merge_job(*parsed).select("site", "ts", "value", "source")
    return views.naive(jobs.run_available(merged, "stream-merge"))


def wire_time():
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
