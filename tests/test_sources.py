import os

from pyspark.sql import functions as F

from sensorlab.schemas import POINT
from sensorlab.sources import catalog, files, kafka


def points(spark):
    rows = [
        ("°C", "xcc_tcstav0_tl", "2025-03-15 00:00:00", 1.0),
        ("°C", "xcc_tcstav0_tl", "2025-03-16 00:00:00", 2.0),
        ("°C", "xcc_tcstav0_tl", "2025-04-23 00:00:00", 3.0),
        ("RPM", "xcc_tcstav1_fanh", "2025-03-16 00:00:00", 4.0),
        ("kW", "xcc_tcstav1_fanh", "2025-03-16 00:00:00", None),
    ]
    df = spark.createDataFrame(rows, "measurement string, entity_id string, time string, value double")
    return df.withColumn("time", F.col("time").cast("timestamp")).to(POINT)


def test_catalog(spark):
    rows = catalog.sensor_catalog(spark, "out/")
    assert rows.count() == 16
    assert rows.filter("not ignore").count() == 4
    row = rows.filter("name = 'xcc_tcstav2_prikon'").first()
    assert (row.measurement, row.ignore, row.days) == ("kW", True, 5)
    assert row.output_dir == "out/tepelna_cerpadla/prikon/"


def test_range_excludes_both_bounds(spark):
    done = catalog.scan_range(points(spark), "xcc_tcstav0_tl", "2025-03-15 00:00:00", "2025-04-23 00:00:00")
    assert [r.value for r in done.collect()] == [2.0]


def test_range_defaults_to_the_last_days(spark):
    recent = points(spark).limit(1).withColumn("time", F.current_timestamp() - F.expr("INTERVAL 2 DAYS"))
    assert catalog.scan_range(recent, days=5).count() == 1
    assert catalog.scan_range(recent, days=1).count() == 0


def test_extract_takes_what_is_not_ignored(spark):
    done = catalog.extract_catalog(points(spark), catalog.sensor_catalog(spark))
    assert {r.entity_id for r in done.collect()} == {"xcc_tcstav0_tl"}


def test_measurement_is_found(spark):
    assert catalog.find_measurement(points(spark), "xcc_tcstav1_fanh").first() == ("RPM", 1)
    assert catalog.find_measurement(points(spark), "none").count() == 0


def test_range_filter_reaches_the_scan(spark, tmp_path):
    points(spark).write.partitionBy("measurement", "entity_id").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    done = catalog.scan_range(stored, "xcc_tcstav0_tl", "2025-03-15 00:00:00", "2025-04-23 00:00:00").select("time")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(entity_id" in plan and "GreaterThan(time" in plan
    assert "ReadSchema: struct<time:timestamp>" in plan


def test_csv_round_trip(spark, tmp_path):
    folder = str(tmp_path / "deep" / "out")
    written = files.write_csv(points(spark).select("time", "value"), folder)
    assert written == 5
    back = files.read_readings_csv(spark, folder)
    assert sorted(r.time for r in back.collect()) == sorted(r.time for r in points(spark).collect())


def test_series_of_one_collection(spark, tmp_path):
    folder = tmp_path / "sarze_5" / "teplota"
    os.makedirs(folder)
    (folder / "gw1100a_outdoor_temperature.csv").write_text(
        "time,value\n2025-04-26T00:00:00+02:00,1.5\n2025-04-26T03:00:00+02:00,2.5\n"
    )
    wanted = [("teplota", "gw1100a_outdoor_temperature.csv", "station"), ("teplota", "gone.csv", "gone")]
    rows, missing = files.read_series(spark, str(tmp_path), 5, wanted, end="2025-04-25 22:00:00")
    assert [(r.label, r.series, r.value) for r in rows.collect()] == [("station", "Gw1100a Outdoor Temperature", 1.5)]
    assert len(missing) == 1 and missing[0].endswith("gone.csv")
    none, missing = files.read_series(spark, str(tmp_path), 6, wanted)
    assert none.count() == 0 and len(missing) == 2


def test_kafka_options_and_columns(spark):
    options = kafka.kafka_source_options("broker:9092", ["temperature", "prikon"], group="job")
    assert options["subscribe"] == "temperature,prikon" and options["groupIdPrefix"] == "job"
    record = spark.range(1).select(
        F.lit("t").alias("topic"), F.lit(b"x").alias("value"), F.current_timestamp().alias("timestamp")
    )
    assert kafka.as_text(record).columns == ["topic", "value", "arrived_at"]
