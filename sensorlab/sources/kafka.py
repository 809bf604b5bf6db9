"""Kafka topics as streams of text records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def kafka_source_options(
    servers: str, topics: str | Sequence[str], starting: str = "latest", group: str | None = None
) -> dict[str, str]:
    names = topics if isinstance(topics, str) else ",".join(topics)
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": names,
        "startingOffsets": starting,
    }
    if group:
        options["groupIdPrefix"] = group
    return options


def read_kafka(
    spark: SparkSession, servers: str, topics: str | Sequence[str], **options: str
) -> DataFrame:
    """``topic, value`` (text) and the broker's time as ``arrived_at``."""
    reader = spark.readStream.format("kafka").options(**kafka_source_options(servers, topics, **options))
    return as_text(reader.load())


def as_text(records: DataFrame) -> DataFrame:
    """Columns of a Kafka record that the jobs use."""
    return records.select(
        "topic",
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("arrived_at"),
    )


def write_kafka(
    df: DataFrame, servers: str, topic: str, checkpoint: str, value: str = "value"
) -> StreamingQuery:
    """Value-only text records, delivered at least once."""
    return (
        df.select(F.col(value).alias("value"))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.transaction.timeout.ms", "60000")
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .start()
    )
