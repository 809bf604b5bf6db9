import json

import pytest
from pyspark.sql import functions as F

from sensorlab.functions.wire import (
    LAYOUTS,
    local_time,
    parse_readings,
    pump_index,
    quantity_of,
    series_label,
    to_wire_json,
    with_latency,
)

GOOD = [
    ('{"time":"2025-04-13T10:00:00+02:00","value":7.4,"source":"gw1100a_outdoor_temperature","processing_time_ms":12.5}', "2025-04-13 08:00:00", 7.4, "gw1100a_outdoor_temperature", 12.5),
    ('{"time":"2025-04-13T08:00:30Z","value":"7.5"}', "2025-04-13 08:00:30", 7.5, "", 0.0),
    ('{"time":"2025-04-13T08:01:00","value":7.6}', "2025-04-13 08:01:00", 7.6, "", 0.0),
    ('{"time":"2024-11-20 01:15:30.250750+02:00","value":-1}', "2024-11-19 23:15:30.25075", -1.0, "", 0.0),
    ('{"time":"2024-11-20 01:45:00.125000+03:00","value":1e2}', "2024-11-19 22:45:00.125", 100.0, "", 0.0),
    ('{"time":"2024-11-20 02:30:10.000000+04:00","value":0}', "2024-11-19 22:30:10", 0.0, "", 0.0),
    ('{"time":"2024-11-20 02:30:10.000000Z","value":0}', "2024-11-20 02:30:10", 0.0, "", 0.0),
]
BAD = [
    '{"time":"2025-04-13T08:01:30"}',
    "not json",
    '{"time":"2025-04-13T08:01:30","value":1',
    '{"value":1}',
    '{"time":"soon","value":1}',
    '{"time":"2025-04-13T08:01:30","value":"warm"}',
    '{"time":"2025-04-13T08:01:30","value":"12d"}',
    '{"time":"2025-04-13T08:01:30","value":"3f"}',
    '{"time":"2025-04-13T08:01:30","value":1,"processing_time_ms":"x"}',
    None,
]


def texts(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


@pytest.mark.parametrize("text, ts, value, source, produced", GOOD)
def test_good_records(spark, text, ts, value, source, produced):
    row = parse_readings(texts(spark, [text])).select(F.col("ts").cast("string"), "value", "source", "produced_at")
    assert tuple(row.first()) == (ts, value, source, produced)


@pytest.mark.parametrize("text", BAD)
def test_bad_record_stops_the_job(spark, text):
    with pytest.raises(Exception, match="bad sensor record"):
        parse_readings(texts(spark, [text])).collect()


def test_bad_records_are_routed(spark):
    good, bad = parse_readings(texts(spark, [g[0] for g in GOOD] + BAD), on_error="route")
    assert good.count() == len(GOOD)
    assert {r[0] for r in bad.collect()} == set(BAD)


def test_record_layouts(spark):
    row = spark.createDataFrame([(1.5, 0.25)], "temperature double, produced_at double")
    row = row.withColumn("time", F.lit("2025-04-13 08:00:00.123456").cast("timestamp"))
    done = to_wire_json(with_latency(row, now=F.lit(1.0)).drop("produced_at"), "gated")
    record = json.loads(done.first()[0])
    assert list(record) == LAYOUTS["gated"]
    assert record["time"] == "2025-04-13T08:00:00.123+00:00"
    assert record["processing_time"] == 0.75 and record["start_time"] == 0.25
    assert [len(LAYOUTS[k]) for k in ("corrected", "gated", "scored", "rates", "merged")] == [8, 4, 13, 27, 6]


def test_written_records_can_be_parsed(spark):
    row = spark.createDataFrame([("s", 2.0, 1.0)], "source string, temperature double, start_time double")
    row = row.withColumns({"time": F.current_timestamp(), "processing_time": F.lit(0.0), "time_at_arrival": F.lit(0.0)})
    text = to_wire_json(row, "merged").select(F.replace("value", F.lit("temperature"), F.lit("value")).alias("value"))
    assert parse_readings(text).first()["value"] == 2.0


def test_nulls_are_written(spark):
    row = spark.createDataFrame([(None, 1.0, 1.0)], "temperature double, processing_time double, start_time double")
    done = to_wire_json(row.withColumn("time", F.current_timestamp()), "gated").first()[0]
    assert json.loads(done)["temperature"] is None


@pytest.mark.parametrize("wrong", ["NaN", "Infinity", "-Infinity"])
def test_not_finite_numbers_stop_the_job(spark, wrong):
    row = spark.createDataFrame([(1.0, 1.0)], "processing_time double, start_time double")
    row = row.withColumns({"time": F.current_timestamp(), "temperature": F.lit(wrong).cast("double")})
    with pytest.raises(Exception, match="temperature is not a finite number"):
        to_wire_json(row, "gated").collect()


def test_routing_by_name(spark):
    names = ["xcc_tcstav0_tl", "xcc_tcstav3_prikon", "other", "tcstav2_tcstav1"]
    rows = spark.createDataFrame([(n,) for n in names], "source string")
    assert [r[0] for r in rows.select(pump_index(F.col("source"))).collect()] == [0, 3, None, 1]
    assert [r[0] for r in rows.select(quantity_of(F.col("source"))).collect()] == ["tl", "prikon", "", ""]


def test_local_time_knows_summer(spark):
    rows = spark.createDataFrame([("2025-01-01 00:00:00",), ("2025-07-01 00:00:00",)], "t string")
    done = rows.select(local_time(F.col("t").cast("timestamp")).cast("string")).collect()
    assert [r[0] for r in done] == ["2025-01-01 01:00:00", "2025-07-01 02:00:00"]


def test_series_label(spark):
    row = spark.range(1).select(series_label(F.lit("../data/sarze_2/tepelna_cerpadla/xcc_tcstav0_prikon.csv")))
    assert row.first()[0] == "Xcc Tcstav0 Prikon"
