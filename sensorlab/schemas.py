"""Row layouts shared by batch and streaming."""

from pyspark.sql import types as T

READING = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("produced_at", T.DoubleType()),
    ]
)

SENSOR_CSV = T.StructType(
    [T.StructField("time", T.TimestampType()), T.StructField("value", T.DoubleType())]
)

POINT = T.StructType(
    [
        T.StructField("measurement", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)

SENSOR = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("measurement", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("days", T.IntegerType()),
        T.StructField("output_dir", T.StringType()),
        T.StructField("ignore", T.BooleanType()),
    ]
)
