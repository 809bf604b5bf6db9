"""Streams give what the batch operators give, in any order of arrival."""

import random
import uuid

import pytest
from helpers import at
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sensorlab.functions.wire import LAYOUTS, correction_record
from sensorlab.operators.asof import asof_correct
from sensorlab.operators.features import Feature, fused_features
from sensorlab.operators.gate import rate_gate
from sensorlab.operators.sets import dedup_first
from sensorlab.plans.correction import correct_device
from sensorlab.streaming import jobs

SCHEMA = "site long, ts timestamp, value double, seq long, produced_at double, source string"
FAR = 10**7


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def write_files(spark, folder, parts):
    """One file per part; later parts get later file times."""
    for part in parts:
        df = spark.createDataFrame(part, SCHEMA).coalesce(1)
        df.write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def readings(n, seed):
    """Device and station rows of two sites, some times twice."""
    rng = random.Random(seed)
    rows, value = [], 10.0
    for i in range(n):
        value += rng.choice([-1, 0, 1, 1, 40 if rng.random() < 0.1 else 0])
        rows.append((i % 2, at((i // 3) * 15), value, i, i / 10, rng.choice(["device", "station"])))
    return rows


def closing():
    return [(-1, at(FAR), 0.0, -1, 0.0, side) for side in ("device", "station")]


def run(spark, df, tmp_path, name="out"):
    """Run until all files are done; the written rows and the last progress."""
    query = jobs.start_files(df, str(tmp_path / name), str(tmp_path / f"{name}-state"))
    query.awaitTermination()
    rows = spark.read.schema(df.schema).parquet(str(tmp_path / name))
    return rows, [p for p in query.recentProgress]


def as_rows(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def correction_twin(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    device, station = (
        dedup_first(df.filter(F.col("source") == s), ["site"], seq="seq") for s in ("device", "station")
    )
    gated = rate_gate(station, ["site"], seq="seq").withColumn("value", F.col("gated_value"))
    return asof_correct(device, gated, ["site"], seq="seq", tolerance_seconds=120)


def correction(spark, folder, delay):
    rows = source(spark, folder)
    device, station = (rows.filter(F.col("source") == s) for s in ("device", "station"))
    return jobs.correction_job(device, station, ["site"], delay, tolerance_seconds=120)


COLUMNS = ["site", "ts", "temperature", "suggested_temperature", "time_difference"]


def shaken(rows, reach, seed):
    """Rows out of order by less than ``reach`` seconds."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: (r[1].timestamp() + rng.random() * reach))


def chunks(rows, n):
    return [rows[i : i + n] for i in range(0, len(rows), n)]


@pytest.mark.parametrize("reach", [0, 50])
def test_correction_equals_batch(spark, tmp_path, reach):
    rows = readings(240, 1)
    folder = str(tmp_path / "in")
    write_files(spark, folder, [*chunks(shaken(rows, reach, 2) if reach else rows, 80), closing()])
    done, _ = run(spark, correction(spark, folder, "1 minute"), tmp_path)
    assert as_rows(done, *COLUMNS) == as_rows(correction_twin(spark, rows), *COLUMNS)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    rows = readings(120, 3)
    late = [(0, at(-5000), 1.0, 900, 0.0, "device"), (1, at(-4000), 1.0, 901, 0.0, "device")]
    folder = str(tmp_path / "in")
    write_files(spark, folder, [rows, rows[-1:], late, closing()])
    done, progress = run(spark, correction(spark, folder, "1 second"), tmp_path)
    assert done.filter(F.col("ts") < F.lit(at(0))).count() == 0
    dropped = sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)
    assert dropped >= 2
    assert as_rows(done, *COLUMNS) == as_rows(correction_twin(spark, rows), *COLUMNS)


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    rows = readings(160, 5)
    folder = str(tmp_path / "in")
    write_files(spark, folder, [rows[:80]])
    run(spark, correction(spark, folder, "1 minute"), tmp_path)
    write_files(spark, folder, [rows[80:], closing()])
    done, _ = run(spark, correction(spark, folder, "1 minute"), tmp_path)
    assert as_rows(done, *COLUMNS) == as_rows(correction_twin(spark, rows), *COLUMNS)


def test_sensor_gate_counts_rejections(spark, tmp_path):
    rows = [r for r in readings(200, 6) if r[5] == "device"]
    folder = str(tmp_path / "in")
    write_files(spark, folder, [*chunks(rows, 60), closing()])
    done, _ = run(spark, jobs.sensor_gate_job(source(spark, folder), ["site"]), tmp_path)
    twin = rate_gate(dedup_first(spark.createDataFrame(rows, SCHEMA), ["site"], seq="seq"), ["site"], seq="seq")
    twin = twin.withColumn("value", F.col("gated_value"))
    assert as_rows(done, "site", "seq", "value", "rejected") == as_rows(twin, "site", "seq", "value", "rejected")
    total = done.groupBy("site").agg(F.max("n_rejected").alias("n"))
    assert as_rows(total, "site", "n") == as_rows(
        twin.groupBy("site").agg(F.sum(F.col("rejected").cast("long")).alias("n")), "site", "n"
    )


def test_features_equal_batch(spark, tmp_path):
    features = [Feature("prikon", "mean"), Feature("tl", "rate", carry_forward=True), Feature("fanh", "latest")]
    rows = readings(360, 7)
    folder = str(tmp_path / "in")
    write_files(spark, folder, [*chunks(shaken(rows, 40, 8), 120), closing()])

    def parts(df):
        base = df.filter("source = 'device'").withColumnRenamed("value", "temperature")
        kinds = F.array(F.lit("prikon"), F.lit("tl"), F.lit("fanh"))
        read = df.filter("source = 'station'").withColumns(
            {"quantity": F.element_at(kinds, (F.pmod("seq", F.lit(3)) + 1).cast("int")), "pump": (F.col("seq") % 2).cast("int")}
        )
        return base, read

    done, _ = run(
        spark, jobs.feature_job(*parts(source(spark, folder)), ["site"], features, 300, delay="1 minute"), tmp_path
    )
    twin = fused_features(*parts(spark.createDataFrame(rows, SCHEMA)), ["site"], features, seq="seq", window_seconds=300)
    columns = [c for c in done.columns if c != "produced_at"]
    assert as_rows(done, *columns) == as_rows(twin, *columns)


def test_dedup_within_the_delay(spark, tmp_path):
    rows = [(0, at(0), 1.0, 0, 0.0, "device"), (0, at(5), 1.0, 1, 0.0, "device")]
    folder = str(tmp_path / "in")
    write_files(spark, folder, [rows, rows])
    done, _ = run(spark, jobs.dedup_stream(source(spark, folder), ["site"], "1 minute"), tmp_path)
    assert done.count() == 2


def test_exact_join_of_streams(spark, tmp_path):
    """Each side's first arrival of a time, with the values of both."""
    left = [(0, at(s), 1.0 + s, s, 0.0, "device") for s in (0, 60, 120)]
    right = [(0, at(s), 2.0 + s, s, 0.0, "station") for s in (60, 90, 120)]
    folder = str(tmp_path / "in")
    write_files(spark, folder, [left + right, [(0, at(120), -1.0, 900, 0.0, "station")], right, closing()])
    rows = source(spark, folder)
    a = rows.filter("source = 'device'").select("site", "ts", "seq", F.col("value").alias("a"))
    b = rows.filter("source = 'station'").select("site", "ts", "seq", F.col("value").alias("b"), F.col("source").alias("kind"))
    done, _ = run(spark, jobs.exact_join_stream(a, b, ["site"], seq="seq"), tmp_path)
    assert as_rows(done, "ts", "a", "b", "kind") == [(at(60), 61.0, 62.0, "station"), (at(120), 121.0, 122.0, "station")]


def test_an_idle_side_holds_nothing_back(spark, tmp_path):
    """The station stops; the device's later rows alone move the watermark on."""
    folder = str(tmp_path / "in")
    pairs = [(0, at(s), 1.0, s, 0.0, side) for s in (0, 60) for side in ("device", "station")]
    write_files(spark, folder, [pairs, [(0, at(s), 1.0, s, 0.0, "device") for s in range(120, 3600, 60)], [(0, at(3600), 1.0, 3600, 0.0, "device")]])
    rows = source(spark, folder)
    a = rows.filter("source = 'device'").select("site", "ts", F.col("value").alias("a"))
    b = rows.filter("source = 'station'").select("site", "ts", F.col("value").alias("b"))
    done, progress = run(spark, jobs.exact_join_stream(a, b, ["site"]), tmp_path)
    assert as_rows(done, "ts") == [(at(0),), (at(60),)]
    (operator,) = progress[-1].stateOperators  # one stateful step
    assert operator.numRowsTotal <= 3  # the rows of the last minutes, their mark and timer


def parted(df):
    return (df.filter(F.col("source") == s) for s in ("device", "station"))


def test_correction_has_one_stateful_step_and_carries_the_stage(spark, tmp_path):
    rows = readings(150, 11)
    folder = str(tmp_path / "in")
    write_files(spark, folder, [*chunks(rows, 50), closing()])
    device, station = parted(source(spark, folder))
    station = station.withColumn("stage", F.pmod("seq", F.lit(5)) / 4)
    done, progress = run(spark, jobs.correction_job(device, station, ["site"], "1 minute", 120), tmp_path)
    assert {len(p.stateOperators) for p in progress} == {1}
    df = spark.createDataFrame(rows, SCHEMA)
    device, station = parted(df)
    station = station.withColumn("stage", F.pmod("seq", F.lit(5)) / 4)
    twin = correct_device(device, station, ["site"], 120)
    columns = [*COLUMNS, "produced_at", "produced_at_meteo", "meteo_stage", "meteo_used"]
    assert as_rows(done.filter("site >= 0"), *columns) == as_rows(twin, *columns)
    record = correction_record(done, ["site"], now=F.lit(1000.0))
    assert record.columns[1:] == LAYOUTS["corrected"]
    assert all(r["processing_time_meteo"] == pytest.approx(1000 - p["produced_at_meteo"]) for r, p in zip(record.collect(), done.collect(), strict=True))


def silent_rows():
    """Two stretches an hour apart, the second on another level."""
    return [(0, at(s), 10.0 + s / 600, s, s / 10, side) for s in (0, 60, 120) for side in ("device", "station")] + [
        (0, at(3720 + s), 900.0, 3720 + s, 1.0, side) for s in (0, 60) for side in ("device", "station")
    ]


@pytest.mark.parametrize("forget", [None, 1200])
def test_silent_series_are_forgotten(spark, tmp_path, forget):
    """After the silence a level is accepted anew, as in batch; no state is left at the end."""
    rows = silent_rows()
    folder = str(tmp_path / "in")
    write_files(spark, folder, [rows[:6], rows[6:], closing(), [(-2, at(2 * FAR), 0.0, -2, 0.0, "device")]])
    device, station = parted(source(spark, folder))
    job = jobs.correction_job(device, station, ["site"], "1 second", 300, forget_after_seconds=forget)
    done, progress = run(spark, job, tmp_path)
    device, station = parted(spark.createDataFrame(rows, SCHEMA))
    twin = correct_device(device, station, ["site"], 300, forget_after_seconds=forget)
    assert as_rows(done.filter("site >= 0"), *COLUMNS) == as_rows(twin, *COLUMNS)
    last = done.filter(F.col("ts") == F.lit(at(3720))).first()
    assert last.suggested_temperature == (900.0 if forget else pytest.approx(10.2))
    left = progress[-1].stateOperators[0].numRowsTotal
    # The newest row still waits: its part, mark and timer.
    assert left <= 3 if forget else left > 3


def test_forgetting_gate_and_features(spark, tmp_path):
    rows = silent_rows()
    folder = str(tmp_path / "in")
    write_files(spark, folder, [rows[:6], rows[6:], closing(), [(-2, at(2 * FAR), 0.0, -2, 0.0, "device")]])
    device, _ = parted(source(spark, folder))
    done, progress = run(spark, jobs.sensor_gate_job(device, ["site"], reset_after_seconds=1200), tmp_path, "gate")
    twin = rate_gate(next(parted(spark.createDataFrame(rows, SCHEMA))), ["site"], seq="seq", reset_after_seconds=1200)
    twin = twin.withColumn("value", F.col("gated_value"))
    assert as_rows(done.filter("site >= 0"), "seq", "value", "rejected") == as_rows(twin, "seq", "value", "rejected")
    assert progress[-1].stateOperators[0].numRowsTotal <= 3

    def sides(df):
        base, read = parted(df)
        return base.withColumnRenamed("value", "temperature"), read.filter("seq < 3000").withColumns({"quantity": F.lit("fanh"), "pump": F.lit(0)})

    wanted = [Feature("fanh", "latest")]
    made, progress = run(spark, jobs.feature_job(*sides(source(spark, folder)), ["site"], wanted, pumps=(0,), forget_after_seconds=1200), tmp_path, "features")
    twin = fused_features(*sides(spark.createDataFrame(rows, SCHEMA)), ["site"], wanted, seq="seq", pumps=(0,), forget_after_seconds=1200)
    assert as_rows(made.filter("site >= 0"), "seq", "fanh_tc0") == as_rows(twin, "seq", "fanh_tc0")
    assert [r.fanh_tc0 for r in twin.orderBy("ts").collect()][-2:] == [0.0, 0.0]
    assert progress[-1].stateOperators[0].numRowsTotal <= 3


def test_parts_are_only_added(spark, tmp_path):
    """A micro-batch touches no rows kept before: one new part for each day it holds."""
    rows = [(0, at(s), float(s), s, 0.0, "device") for s in range(0, 600, 10)]
    folder = str(tmp_path / "in")
    write_files(spark, folder, chunks(rows, 10))
    device, station = parted(source(spark, folder))
    _, progress = run(spark, jobs.correction_job(device, station, ["site"], "1 day"), tmp_path)
    updated = [p.stateOperators[0].numRowsUpdated for p in progress if p.numInputRows]
    assert len(updated) == 6 and max(updated) <= 4  # part, mark, timer, its index
    assert progress[-1].stateOperators[0].numRowsTotal >= 6


def test_a_batch_run_again_changes_nothing(spark, tmp_path, monkeypatch):
    """The second batch fails behind its write, before its mark: after a restart every row is there once."""
    rows = readings(90, 12)
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_files(spark, folder, chunks(rows, 30))
    df = source(spark, folder).select("site", "ts", "seq", "value")
    real, calls = jobs.mark, []

    def failing(spark_, done, number):
        calls.append(number)
        if number == 1 and calls.count(1) == 1:
            raise RuntimeError("lost")
        real(spark_, done, number)

    monkeypatch.setattr(jobs, "mark", failing)
    with pytest.raises(StreamingQueryException):
        jobs.start_once(df, out, state).awaitTermination()
    assert jobs.read_once(spark, out, df.schema).count() == 30  # what failed half-way does not show
    jobs.start_once(df, out, state).awaitTermination()
    assert calls == [0, 1, 1, 2]
    done = jobs.read_once(spark, out, df.schema)
    assert sorted(r.seq for r in done.collect()) == list(range(90))
    # A batch whose mark is there, but not the query's own, is not written again.
    jobs.start_once(df, out, str(tmp_path / "state-lost")).awaitTermination()
    assert jobs.read_once(spark, out, df.schema).count() == 90
    assert jobs.read_once(spark, str(tmp_path / "nothing"), df.schema).count() == 0


def test_console_sink(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_files(spark, folder, [[(0, at(0), 123.25, 0, 0.0, "device")]])
    query = jobs.start_console(source(spark, folder).select("site", "value"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert "console" in query.lastProgress.sink.description.lower()
    assert sum(p.numInputRows for p in query.recentProgress) == 1


def test_merge_keeps_all_rows(spark, tmp_path):
    rows = readings(30, 9)
    folder = str(tmp_path / "in")
    write_files(spark, folder, [rows])
    df = source(spark, folder)
    merged = jobs.merge_job(df.filter("source = 'device'"), df.filter("source = 'station'"))
    name = f"t{uuid.uuid4().hex}"
    query = merged.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table(name).count() == 30
