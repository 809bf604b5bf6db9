import random

import numpy as np
import pytest
from helpers import at
from pyspark.sql import functions as F

from sensorlab.plans import model, model_queries


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(240):
        a, b, c = rng.gauss(0, 1), rng.gauss(5, 2), rng.gauss(0, 1)
        data.append((at(i * 60), i, a, b, c, 3 * a - b + rng.gauss(0, 0.1)))
    return spark.createDataFrame(
        data, "ts timestamp, seq long, a double, b double, c double, temperature_delta double"
    ).coalesce(2).cache()


def zero_error(rows):
    return rows.agg(F.avg(F.abs("temperature_delta"))).first()[0]


def lasso_by_descent(x, y, alpha, rounds=500):
    """Coordinate descent of 1/(2n)|y - Xw|^2 + alpha |w|_1 on centred data."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(len(w)):
            rest = y - x @ w + x[:, j] * w[j]
            r = x[:, j] @ rest / len(y)
            w[j] = np.sign(r) * max(abs(r) - alpha, 0) / (x[:, j] @ x[:, j] / len(y))
    return w


@pytest.mark.parametrize("alpha", [0.1, 1.0])
def test_lasso_minimises_the_known_objective(rows, alpha):
    fitted = model.model_pipeline("lasso", ["a", "b", "c"], regParam=alpha).fit(rows)
    data = np.array(rows.select("a", "b", "c", "temperature_delta").collect(), dtype=float)
    x = (data[:, :3] - data[:, :3].mean(0)) / data[:, :3].std(0, ddof=1)
    y = data[:, 3] - data[:, 3].mean()
    assert np.allclose(fitted.stages[-1].coefficients.toArray(), lasso_by_descent(x, y, alpha), atol=1e-3)


def test_lasso_training(spark, rows):
    done = model.train_delta_model(rows, ["a", "b", "c"], "lasso", {"regParam": [0.01, 10.0]}, "rmse", 3, seq="seq")
    assert done.params == {"regParam": 0.01}
    assert done.test["n"] == 48 and done.test["mae"] < zero_error(rows) / 5
    importance = model.feature_importance(spark, done)
    assert [r.feature for r in model.top_features(importance, 2).collect()] == ["a", "b"]
    assert model.importance_summary(importance).first()["all_zero"] is False


def test_trees_training_is_repeatable(spark, rows):
    grid = {"maxIter": [5], "maxDepth": [3], "minInstancesPerNode": [1]}
    first, second = (model.train_delta_model(rows, ["a", "b"], "trees", grid, "mae", 2, seq="seq") for _ in range(2))
    assert first.test == second.test and first.test["mae"] < zero_error(rows)
    assert abs(sum(r.importance for r in model.feature_importance(spark, first).collect()) - 1) < 1e-9


def test_all_zero_importance_is_reported(spark, rows):
    done = model.train_delta_model(rows, ["c"], "lasso", {"regParam": [100.0]}, "mae", 2, seq="seq")
    assert model.importance_summary(model.feature_importance(spark, done)).first()["all_zero"] is True


def test_grids_and_feature_lists():
    assert len(model.MEAN_FEATURES) == 9 and len(model.RATE_FEATURES) == 25
    assert [np.prod([len(v) for v in model.TREE_GRIDS[m].values()]) for m in ("mae", "rmse")] == [12, 32]


def test_scoring_with_and_without_model(spark, rows, tmp_path):
    scored = rows.withColumnRenamed("a", "temperature")
    fitted = model.model_pipeline("lasso", ["temperature", "b"], regParam=0.01).fit(scored)
    path = str(tmp_path / "model")
    model.save_model(fitted, path)
    holed = scored.withColumn("b", F.when(F.col("seq") > 0, F.col("b")))
    done = model.adjust_temperature(holed, model.load_model(path)).orderBy("seq").collect()
    assert len(done) == 240
    assert done[0].model_used is False and done[0].b is None and done[0].temperature == done[0].original_temperature
    assert done[1].model_used and done[1].temperature == done[1].original_temperature + done[1].delta
    plain = model.adjust_temperature(holed, model.load_model(str(tmp_path / "none")))
    assert plain.columns == list(done[0].asDict()) and plain.filter("delta <> 0 or model_used").count() == 0


def test_training_reads_its_rows_once(spark, rows):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    done = model.train_delta_model(rows.mapInArrow(counted, rows.schema), ["a", "b"], "lasso", seq="seq")
    assert done.test["n"] == 48 and made.value == 240


def test_training_and_scoring_share_their_features(spark, monkeypatch):
    calls, fused = [], model_queries.features.fused_features

    def counted(*args, **options):
        calls.append(1)
        return fused(*args, **options)

    monkeypatch.setattr(model_queries.features, "fused_features", counted)
    assert model_queries.wire_scored(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
