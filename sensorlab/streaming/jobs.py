"""Streaming jobs: correction, sensor gate, features and scoring, pass-through.

Every job takes a streaming DataFrame of readings and returns a streaming
DataFrame; sources and sinks are up to the caller. Inputs are united first and
get one watermark, so an idle input never holds the others back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from sensorlab.operators.features import PUMPS, Feature
from sensorlab.operators.gate import MAX_RATE_PER_MINUTE
from sensorlab.session import fresh_folder
from sensorlab.streaming.processors import CorrectionProcessor, ExactJoinProcessor, FeatureProcessor, GateProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Watermark delays (fixed values).
CORRECTION_DELAY = "1 second"
LATE_CORRECTION_DELAY = "60 minutes"
GATE_DELAY = "30 seconds"
FEATURE_DELAY = "0 seconds"


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _schema(df: DataFrame, names: Sequence[str], *more: tuple[str, T.DataType]) -> T.StructType:
    fields = [T.StructField(n, df.schema[n].dataType) for n in names]
    return T.StructType(fields + [T.StructField(n, kind) for n, kind in more])


def dedup_stream(df: DataFrame, key: Sequence[str], delay: str, ts: str = "ts") -> DataFrame:
    """First arrival of each (series, time) within the watermark's delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*key, ts])


def gate_stream(
    readings: DataFrame,
    key: Sequence[str],
    gated: Sequence[str],
    delay: str | None = GATE_DELAY,
    max_rate: float = MAX_RATE_PER_MINUTE,
    reset_after_seconds: float | None = None,
) -> DataFrame:
    """De-duplicate by time and gate the sides named in ``gated``.

    ``readings`` has the key, ``side``, ``ts``, ``seq``, ``value``, ``source``,
    ``produced_at``. Adds ``rejected`` and the series' count of rejections.
    With ``reset_after_seconds`` the held reading counts no longer than that,
    and the state of a silent series goes.
    """
    prepare(readings.sparkSession)
    if delay is not None:
        readings = readings.withWatermark("ts", delay)
    names = [*key, "side"]
    output = _schema(
        readings,
        [*names, "ts", "seq", "value", "source", "produced_at"],
        ("rejected", T.BooleanType()),
        ("n_rejected", T.LongType()),
    )
    processor = GateProcessor(names, output, gated, max_rate, _micros(reset_after_seconds))
    return readings.groupBy(*names).transformWithStateInPandas(
        processor, output, "Append", "EventTime", eventTimeColumnName="ts"
    )


def correction_job(
    device: DataFrame,
    station: DataFrame,
    key: Sequence[str],
    delay: str = CORRECTION_DELAY,
    tolerance_seconds: float = 20 * 60,
    max_rate: float = MAX_RATE_PER_MINUTE,
    forget_after_seconds: float | None = None,
) -> DataFrame:
    """De-duplicate both, gate the station, correct the device: one stateful step.

    Both sides have the key, ``ts``, ``seq``, ``value``, ``produced_at``; the
    station may have ``stage``, the seconds its reading took to get here. A
    millisecond is only complete when the watermark has passed it, so rows come
    out just behind the watermark. With ``LATE_CORRECTION_DELAY`` this is the
    variant for late readings; what comes later still is dropped and counted in
    the query's progress. With ``forget_after_seconds`` a station reading, and
    the one its gate holds, count no longer than that, and the state of a silent site goes.
    """
    columns = [*key, "ts", "seq", "value", "produced_at"]
    stage = F.col("stage").cast("double") if "stage" in station.columns else F.lit(0.0)
    both = device.select(*columns, F.lit("device").alias("side"), F.lit(0.0).alias("stage")).unionByName(
        station.select(*columns, F.lit("station").alias("side"), stage.alias("stage"))
    )
    prepare(both.sparkSession)
    double = T.DoubleType()
    names = ("temperature", "suggested_temperature", "produced_at", "produced_at_meteo", "time_difference", "meteo_stage")
    output = _schema(both, [*key, "ts"], *[(n, double) for n in names], ("meteo_used", T.BooleanType()))
    processor = CorrectionProcessor(list(key), output, "device", tolerance_seconds, max_rate, _micros(forget_after_seconds))
    return (
        both.withWatermark("ts", delay)
        .groupBy(*key)
        .transformWithStateInPandas(processor, output, "Append", "EventTime")
    )


def _micros(seconds: float | None) -> int | None:
    """State that is forgotten: a timer clears a series that long after its last row.

    Results don't depend on when that happens, as older readings don't count
    from then on anyway; the batch operators have the same setting.
    """
    return None if seconds is None else int(seconds * 1e6)


def sensor_gate_job(
    device: DataFrame, key: Sequence[str], delay: str = GATE_DELAY, reset_after_seconds: float | None = None
) -> DataFrame:
    """De-duplicate and gate the device's own readings."""
    side = device.withColumn("side", F.lit("device"))
    return gate_stream(side, key, ["device"], delay, reset_after_seconds=reset_after_seconds)


def feature_job(
    base: DataFrame,
    readings: DataFrame,
    key: Sequence[str],
    features: Sequence[Feature],
    window_seconds: float = 5 * 60,
    pumps: Sequence[int] = PUMPS,
    delay: str = FEATURE_DELAY,
    forget_after_seconds: float | None = None,
) -> DataFrame:
    """All channel features of every base row, with one state for all channels.

    ``base`` has the key, ``ts``, ``seq``, ``temperature``, ``produced_at``;
    ``readings`` the key, ``ts``, ``seq``, ``quantity``, ``pump``, ``value``.
    """
    prepare(base.sparkSession)
    quantities = sorted({f.quantity for f in features})
    channels = readings.filter(F.col("quantity").isin(*quantities) & F.col("pump").isin(*pumps)).select(
        *key,
        "ts",
        "seq",
        F.concat_ws("_tc", "quantity", F.col("pump").cast("string")).alias("channel"),
        "value",
        F.lit(0.0).alias("produced_at"),
    )
    rows = base.select(
        *key,
        "ts",
        "seq",
        F.lit(None).cast("string").alias("channel"),
        F.col("temperature").alias("value"),
        "produced_at",
    ).unionByName(channels)
    more = []
    for f in features:
        for p in pumps:
            c = f"{f.quantity}_tc{p}"
            if f.stat == "rate":
                more += [(f"{c}_rate", T.DoubleType()), (f"{c}_value", T.DoubleType()), (f"{c}_n", T.LongType())]
            else:
                more.append((c, T.DoubleType()))
    output = _schema(base, [*key, "ts", "seq", "temperature", "produced_at"], *more)
    processor = FeatureProcessor(list(key), output, features, pumps, int(window_seconds * 1e6), _micros(forget_after_seconds))
    return (
        rows.withWatermark("ts", delay)
        .groupBy(*key)
        .transformWithStateInPandas(processor, output, "Append", "EventTime", eventTimeColumnName="ts")
    )


def exact_join_stream(
    left: DataFrame, right: DataFrame, key: Sequence[str], delay: str = "5 minutes", ts: str = "ts", seq: str | None = None
) -> DataFrame:
    """Pairs of equal time with the columns of both, each side's first arrival.

    The sides are united and get one watermark: an idle one holds nothing back.
    A pair comes, and a row without partner goes, when the watermark has
    reached it. Other columns must not have the same name on both sides.
    """
    prepare(left.sparkSession)
    arrival = [seq] if seq else []
    payload = [[c for c in df.columns if c not in (*key, ts, *arrival)] for df in (left, right)]
    sides = []
    for df, own, is_left in ((left, payload[0], True), (right, payload[1], False)):
        rank = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
        sides.append(df.select(*key, F.col(ts).cast("timestamp").alias("ts"), rank.alias("seq"), F.lit(is_left).alias("is_left"), *own))
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    kinds = [both.schema[c] for c in (*payload[0], *payload[1])]
    fields = T.StructType([T.StructField("us", T.LongType()), both.schema["seq"], both.schema["is_left"], *kinds])
    output = T.StructType([*[both.schema[k] for k in key], both.schema["ts"], *kinds])
    processor = ExactJoinProcessor(list(key), output, fields, *payload)
    paired = (
        both.withWatermark("ts", delay)
        .groupBy(*key)
        .transformWithStateInPandas(processor, output, "Append", "EventTime", eventTimeColumnName="ts")
    )
    return paired.withColumnRenamed("ts", ts)


def merge_job(*streams: DataFrame) -> DataFrame:
    """All readings of all inputs, unchanged."""
    merged = streams[0]
    for other in streams[1:]:
        merged = merged.unionByName(other)
    return merged


def start_files(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to parquet files until all input there is now is done."""
    return (
        df.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def start_once(df: DataFrame, folder: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Write a stream so that a batch that is run again changes nothing.

    Every batch has a folder of its own, which it overwrites, and is marked as
    done behind that; a marked batch is not written again. `read_once` reads
    marked batches only, so a batch that failed half-way shows nothing.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        done = f"{folder}/done"
        if _exists(spark, f"{done}/batch={number}"):
            return
        rows = batch.write.mode("overwrite")
        (rows.partitionBy(*partition_by) if partition_by else rows).parquet(f"{folder}/rows/batch={number}")
        mark(spark, done, number)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mark(spark: SparkSession, done: str, number: int) -> None:
    """Tell that a batch is written; creating the empty folder is one step."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{done}/batch={number}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_once(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches that `start_once` has finished."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/done")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = [m.getPath().getName() for m in store.listStatus(place)] if store.exists(place) else []
    if not marks:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{folder}/rows").schema(schema)
    return rows.parquet(*[f"{folder}/rows/{m}" for m in sorted(marks)]).select(*schema.names)


def start_console(df: DataFrame, checkpoint: str) -> StreamingQuery:
    """Print a stream's rows, batch by batch."""
    return (
        df.writeStream.format("console")
        .option("truncate", "false")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .start()
    )


def run_available(df: DataFrame, label: str) -> DataFrame:
    """Run a stream over what its sources hold now; the rows it wrote."""
    spark = df.sparkSession
    folder = fresh_folder(spark, label)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    # State is kept per shuffle partition: no more of them than cores.
    spark.conf.set(
        "spark.sql.shuffle.partitions", str(min(int(partitions), max(8, spark.sparkContext.defaultParallelism)))
    )
    try:
        start_files(df, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


