"""The L1 path against a direct solution, and trees read off a longer model."""

import numpy as np
import pytest
from helpers import at
from pyspark.sql import functions as F

from sensorlab.operators.lasso import LinearModel, descend, fold_moments, lasso_path
from sensorlab.operators.split import time_series_folds
from sensorlab.plans import model

NAMES = ["a", "b", "c", "d"]
ALPHAS = [0.0, 0.001, 0.01, 0.1, 1.0, 10.0]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(180, 4)) * [1, 5, 0.1, 1] + [1000, -3, 0, 7]
    x[:, 3] = 4.0  # constant
    return x, x[:, 0] * 2 - x[:, 1] + rng.normal(size=180) * 0.3


@pytest.fixture(scope="module")
def folded(spark, data):
    x, y = data
    rows = [(at(60 * i), i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "ts timestamp, seq long, a double, b double, c double, d double, y double")
    return time_series_folds(df, 5, (), "ts", "seq").repartition(7).cache()


def direct(x, y, alpha):
    """Proximal steps on the centred and scaled matrix itself."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1)
    z, t, w = (x - mean) / scale, y - y.mean(), np.zeros(x.shape[1])
    step = len(y) / np.linalg.norm(z, 2) ** 2
    for _ in range(20_000):
        g = w - step * z.T @ (z @ w - t) / len(y)
        w = np.sign(g) * np.maximum(np.abs(g) - step * alpha, 0)
    return lambda v: y.mean() + (v - mean) / scale @ w, w


def test_every_strength_and_window(folded, data):
    x, y = data
    points, final = lasso_path(folded, NAMES, "y", ALPHAS, 5)
    assert [(p.alpha, p.fold) for p in points] == [(a, i) for a in ALPHAS for i in range(1, 6)]
    for p in points:
        begin, end = 30 * p.fold, 30 * (p.fold + 1)
        predict, w = direct(x[:begin], y[:begin], p.alpha)
        want = np.sqrt(np.mean((y[begin:end] - predict(x[begin:end])) ** 2))
        assert (p.n_train, p.n_test) == (begin, 30)
        assert p.rmse == pytest.approx(want, rel=1e-6, abs=1e-8)
        assert np.allclose(p.model.coefficients, w, atol=1e-6)
    for alpha in ALPHAS:
        assert np.allclose(final[alpha].coefficients, direct(x, y, alpha)[1], atol=1e-6)
    assert final[10.0].coefficients == (0.0,) * 4 and all(m.coefficients[3] == 0 for m in final.values())


def test_least_squares(folded, data):
    x, y = data
    points, final = lasso_path(folded, NAMES[:3], "y", [0.0], 5)
    design = np.column_stack([np.ones(180), x[:, :3]])
    solved, *_ = np.linalg.lstsq(design, y, rcond=None)
    model_ = final[0.0]
    assert np.allclose(np.array(model_.coefficients) / np.array(model_.scales), solved[1:], rtol=1e-8)


def test_one_scan(spark, folded, monkeypatch):
    """The rows are read once for all points, besides the first ones for a centre."""
    scans = []
    original = type(folded).mapInArrow
    monkeypatch.setattr(type(folded), "mapInArrow", lambda self, *a, **k: scans.append(1) or original(self, *a, **k))
    lasso_path(folded, NAMES, "y", ALPHAS, 5)
    assert scans == [1]


def test_moments_add_up(folded, data):
    x, y = data
    folds = fold_moments(folded, [*NAMES, "y"])
    total = sum(list(folds.values())[1:], list(folds.values())[0])
    full = np.column_stack([x, y])
    assert total.n == 180 and np.allclose(total.means, full.mean(axis=0))
    assert np.allclose(total.covariance, np.cov(full.T, bias=True), atol=1e-9)


def test_few_folds_and_bad_values(spark, folded):
    assert lasso_path(folded.filter("false"), NAMES, "y", ALPHAS, 5) == ([], {})
    points, final = lasso_path(folded.filter("fold in (0, 3)"), NAMES, "y", [0.1], 5)
    assert [(p.fold, p.n_train) for p in points] == [(3, 30)] and len(final) == 1
    with pytest.raises(ValueError, match="finite"):
        lasso_path(folded.withColumn("a", F.when(F.col("seq") != 7, F.col("a"))), NAMES, "y", [0.1], 5)


def test_descent_of_a_singular_matrix():
    g = np.array([[1.0, 1.0], [1.0, 1.0]])
    w = descend(g, np.array([1.0, 1.0]), 0.25)
    assert w.sum() == pytest.approx(0.75)


def test_a_stored_model_predicts_alike(spark, folded, tmp_path):
    _, final = lasso_path(folded, NAMES, "y", [0.01], 5)
    path = str(tmp_path / "model")
    model.save_model(final[0.01], path, spark)
    assert model.load_model(path, "linear") == final[0.01]
    assert model.load_model(str(tmp_path / "none"), "linear") is None
    plan = final[0.01].transform(folded)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_linear_model_without_features():
    assert LinearModel((), (), (), (), 2.0).coefficients == ()


def test_shorter_models_are_read_off_longer_ones(spark, folded):
    grid = {"maxIter": [2, 5], "maxDepth": [2, 3], "minInstancesPerNode": [1]}
    rows = folded.withColumn(model.TARGET, F.col("y"))
    scores = model.staged_scores(rows, ["a", "b"], grid, 2)
    assert len(scores) == 2 * 2 * 2
    for s in scores:
        params = {k: s[k] for k in grid}
        pipeline = model.model_pipeline("trees", ["a", "b"], **params)
        fitted = pipeline.fit(rows.filter(F.col("fold") < s["fold"]).orderBy("seq").coalesce(1))
        alone = model.evaluate(fitted.transform(rows.filter(F.col("fold") == s["fold"])))
        # Samples differ with the order of rows, the size of the model doesn't.
        assert alone["rmse"] == pytest.approx(s["rmse"], rel=0.35)
    by_length = {(s["maxDepth"], s["fold"], s["maxIter"]): s["rmse"] for s in scores}
    assert all(by_length[d, f, 5] < by_length[d, f, 2] for d in (2, 3) for f in (1, 2))


def test_best_point_is_the_first_of_equals():
    scores = [{"p": p, "fold": f, "mae": m} for p, f, m in [(1, 1, 2.0), (1, 2, 4.0), (2, 1, 3.0), (2, 2, 3.0), (3, 1, 5.0), (3, 2, 5.0)]]
    assert model.best_point(scores, ["p"], "mae") == ({"p": 1}, 3.0)
