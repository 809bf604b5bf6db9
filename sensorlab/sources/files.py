"""Sensor files: CSV series in, CSV and model folders out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlab.functions.wire import series_label
from sensorlab.schemas import SENSOR_CSV


def read_readings_csv(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = SENSOR_CSV
) -> DataFrame:
    """CSV with header; ``time`` may carry any offset and becomes UTC.

    A file without a ``time`` column is read with a schema that has none.
    """
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "time" else f.dataType) for f in schema.fields]
    )
    rows = spark.read.schema(as_text).option("header", True).csv(paths)
    if "time" in schema.names:
        rows = rows.withColumn("time", F.try_to_timestamp(F.col("time")))
    return rows


def read_series(
    spark: SparkSession,
    root: str,
    batch: int,
    files: Sequence[tuple[str, str, str]],
    start: str | None = None,
    end: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Series of one collection folder, as (folder, file, display name) triples.

    Returns the rows with ``series`` and ``label``, and the paths that do not
    exist. All files are read by one scan.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    configuration = spark._jsc.hadoopConfiguration()
    found, missing = {}, []
    for folder, file, label in files:
        path = f"{root}/sarze_{batch}/{folder}/{file}"
        target = hadoop(path)
        exists = target.getFileSystem(configuration).exists(target)
        if exists:
            found[f"{folder}/{file}"] = (path, label)
        else:
            missing.append(path)
    if not found:
        empty = spark.createDataFrame([], SENSOR_CSV)
        return empty.withColumns({"series": F.lit(""), "label": F.lit("")}), missing
    rows = read_readings_csv(spark, [path for path, _ in found.values()])
    path = F.col("_path")
    rows = rows.withColumn("_path", F.col("_metadata.file_path"))
    label, series = F.lit(None).cast("string"), F.lit(None).cast("string")
    for ending, (_, name) in found.items():
        # The name may be that of a file or of a folder of part files.
        here = path.endswith(f"/{ending}") | path.contains(f"/{ending}/")
        label, series = F.when(here, F.lit(name)).otherwise(label), F.when(here, series_label(F.lit(ending))).otherwise(series)
    rows = rows.withColumns({"label": label, "series": series}).drop("_path")
    if start is not None:
        rows = rows.filter(F.col("time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("time") <= F.lit(end).cast("timestamp"))
    return rows, missing


def write_csv(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> int:
    """CSV with header; folders are made. Returns the number of rows written,
    counted while writing."""
    observed = Observation()
    counted = df.observe(observed, F.count(F.lit(1)).alias("n"))
    writer = counted.write.mode(mode).option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    plain = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    writer.option("timestampFormat", f"{plain}XXX").option("timestampNTZFormat", plain).csv(path)
    return observed.get["n"]
