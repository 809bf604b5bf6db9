"""Extracts open only the folders they need; shifts of many columns; counted filters."""

import random
import uuid

import pytest
from helpers import at, series, values
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sensorlab.operators import rolling
from sensorlab.operators.features import lag_features, vector_lags
from sensorlab.operators.sets import observed_filter
from sensorlab.sources import catalog


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Three sensors with a point every six hours for 20 days."""
    path = str(tmp_path_factory.mktemp("points") / "points")
    rows = [("°C", f"xcc_tcstav{p}_tl", at(-6 * 3600 * i), float(i)) for p in range(3) for i in range(80)]
    points = spark.createDataFrame(rows, "measurement string, entity_id string, time timestamp, value double")
    catalog.store_points(points, path)
    return points, spark.read.parquet(path)


def sensors(spark, days):
    name = F.col("name")
    own = F.lit(0)
    for p, n in days.items():
        own = F.when(name == f"xcc_tcstav{p}_tl", n).otherwise(own)
    wanted = name.isin(*[f"xcc_tcstav{p}_tl" for p in days])
    return catalog.sensor_catalog(spark).withColumns({"days": own, "output_dir": F.concat(F.lit("out"), own.cast("string"), F.lit("/")), "ignore": ~wanted})


def files_read(df):
    """Files and folders the scan of the finished plan has opened."""
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            return node.metrics().apply("numFiles").value(), node.metrics().apply("numPartitions").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")


def test_only_wanted_sensors_and_days_are_opened(spark, stored):
    points, table = stored
    found = catalog.extract_days(table, sensors(spark, {0: 1, 1: 4}), str(at(0)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    _, folders = files_read(found)
    # Sensors and days prune one by one: two sensors, the five dates of the longer one, of 3 x 21 folders.
    assert folders == 2 * 5
    counts = dict(values(found.groupBy("entity_id").count(), "entity_id", "count", order=("entity_id",)))
    assert counts == {"xcc_tcstav0_tl": 3, "xcc_tcstav1_tl": 15}


def test_extract_has_what_a_plain_filter_has(spark, stored):
    points, table = stored
    found = catalog.extract_days(table, sensors(spark, {0: 2, 1: 30, 2: 0}), "2025-04-10 03:00:00")
    until = F.lit("2025-04-10 03:00:00").cast("timestamp")
    days = F.when(F.col("entity_id") == "xcc_tcstav0_tl", 2).otherwise(30)
    wanted = points.filter("entity_id <> 'xcc_tcstav2_tl'").filter((F.col("time") < until) & (F.col("time") > until - F.make_dt_interval(days)))
    assert values(found, "entity_id", "time", "value", order=("entity_id", "time")) == values(wanted, "entity_id", "time", "value", order=("entity_id", "time"))


def test_export_by_output_folder(spark, stored, tmp_path):
    _, table = stored
    root = str(tmp_path / "out")
    n = catalog.export_extract(catalog.extract_days(table, sensors(spark, {0: 1, 1: 4}), str(at(0))), root)
    assert n == 18
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["output_dir=out1%2F", "output_dir=out4%2F"]
    text = next((tmp_path / "out" / "output_dir=out1%2F" / "entity_id=xcc_tcstav0_tl").glob("*.csv")).read_text().splitlines()
    assert text[0] == "time,value" and len(text) == 4


def rows_of(spark, n=300):
    rng = random.Random(3)
    data = [
        (rng.choice([1, 1, 2, None]), at(rng.randrange(n)), i, None if rng.random() < 0.05 else rng.uniform(-9, 9), float("nan") if i == 50 else float(i), rng.randrange(9))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "site long, ts timestamp, seq long, a double, b double, c long")


@pytest.mark.parametrize(("rows_per_slice", "batch", "key"), [(7, 3, ["site"]), (40, 10_000, []), (10**6, 3, []), (10**6, 10_000, ["site"])])
def test_vector_lags_equal_windows(spark, split, rows_per_slice, batch, key):
    """Across slices and Arrow batches alike."""
    df = rows_of(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        with split(rows_per_slice):
            options = {"lags": (1, 4), "windows": (3, 6), "seq": "seq"}
            plain = lag_features(df.withColumn("c", F.col("c").cast("double")), key, ["a", "b", "c", "none"], **options)
            fast = vector_lags(df, key, ["a", "b", "c", "none"], **options)
            names = [c for c in plain.columns if c not in ("ts", "c")]
            assert fast.columns == plain.columns
            for x, y in zip(values(fast, *names, order=("seq",)), values(plain, *names, order=("seq",)), strict=True):
                assert [v if v is None else pytest.approx(v, nan_ok=True) for v in y] == list(x)
            whole = vector_lags(df, key, ["a", "c"], **options, drop_incomplete=True)
            assert whole.count() == lag_features(df, key, ["a", "c"], **options, drop_incomplete=True).count() > 50
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_vector_lags_sort_once(spark):
    plan = vector_lags(rows_of(spark), ["site"], [f"x{i}" for i in range(9)] + ["a", "b"], seq="seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_vector_lags_of_no_rows_and_no_columns(spark):
    assert vector_lags(rows_of(spark).filter("false"), ["site"], ["a"], seq="seq").count() == 0
    assert vector_lags(rows_of(spark), ["site"], ["none"], seq="seq").columns == rows_of(spark).columns


def test_filters_count_what_passes(spark):
    df = series(spark, [(i * 60, 1.0 if i % 50 else 500.0) for i in range(200)])
    watch = Observation(f"t-{uuid.uuid4().hex}")
    kept = rolling.mad_filter(df, ["site"], seq="seq", observation=watch)
    n = len(kept.collect())
    assert watch.get == {"n_rows": 200, "n_kept": n}
    none = Observation(f"t-{uuid.uuid4().hex}")
    assert observed_filter(df.filter("false"), F.lit(True), none).collect() == []
    assert none.get == {"n_rows": 0, "n_kept": 0}
