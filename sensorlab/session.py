"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SLICE_ROWS = "sensorlab.slice.rows"

_DEFAULTS = {SLICE_ROWS: 250_000}


def setting(spark: SparkSession, name: str) -> int:
    """Integer setting of this package, read from the session."""
    return int(spark.conf.get(name, str(_DEFAULTS[name])))


def use_utc(spark: SparkSession) -> SparkSession:
    """All instants are handled in UTC; zone-less times mean UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not hasattr(spark, "_sensorlab_folder"):
        spark._sensorlab_folder = tempfile.mkdtemp(prefix="sensorlab-")
    return spark._sensorlab_folder


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` so later jobs start from stored rows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that Spark knows its size.

    The files are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
