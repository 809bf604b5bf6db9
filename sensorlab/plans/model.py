"""Training and applying the model of the device's temperature error."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlab.operators.lasso import LinearModel, lasso_path
from sensorlab.operators.profile import regression_metrics
from sensorlab.operators.split import time_series_folds, time_split
from sensorlab.session import stored

TARGET = "temperature_delta"
PUMPS = range(4)

# Feature columns of the two models (fixed values).
MEAN_FEATURES = [
    "temperature",
    *[f"fanh_tc{p}" for p in PUMPS],
    *[f"prikon_tc{p}" for p in PUMPS],
]
RATE_FEATURES = [
    "temperature",
    *[f"{q}_tc{p}_{part}" for q in ("prikon", "tl", "fanh") for part in ("rate", "value") for p in PUMPS],
]

# Parameter grids (fixed values): trees, depth, least rows per leaf; L1 strength.
TREE_GRIDS = {
    "mae": {"maxIter": [400, 800], "maxDepth": [4, 6, 8], "minInstancesPerNode": [1, 5]},
    "rmse": {"maxIter": [200, 400, 600, 1600], "maxDepth": [2, 4, 6, 8], "minInstancesPerNode": [1, 5]},
}
LASSO_GRID = {"regParam": [0.001, 0.01, 0.1, 1.0, 10.0]}


def estimator(kind: str, label: str):
    if kind == "trees":
        return GBTRegressor(
            labelCol=label,
            lossType="squared",
            stepSize=0.05,
            subsamplingRate=0.8,
            featureSubsetStrategy="0.8",
            seed=42,
        )
    if kind == "lasso":
        # The scaler has standardised the features already.
        return LinearRegression(labelCol=label, elasticNetParam=1.0, maxIter=10000, standardization=False)
    raise ValueError(f"unknown kind of model: {kind!r}")


def model_pipeline(kind: str, features: Sequence[str], label: str = TARGET, **params) -> Pipeline:
    """Assemble, standardise (mean 0, sample deviation 1), regress."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="assembled", handleInvalid="error"),
            StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True),
            estimator(kind, label).setParams(**params),
        ]
    )


def evaluate(scored: DataFrame, label: str = TARGET) -> dict[str, float]:
    row = regression_metrics(scored, F.col(label), F.col("prediction")).first()
    return {"mae": row["mae"], "rmse": row["rmse"], "n": row["n"]}


@dataclass
class Trained:
    """``scores`` has a row per point of the grid and fold: the parameters, ``fold`` and both metrics, as far as they are known."""

    model: PipelineModel | LinearModel
    params: dict
    cv_score: float
    test: dict[str, float]
    features: list[str]
    scores: list[dict] = field(default_factory=list)


def grid_points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def staged_scores(folded: DataFrame, features: Sequence[str], grid: dict[str, list], n_splits: int, label: str = TARGET, threads: int = 4) -> list[dict]:
    """Scores of boosted trees for every point of the grid and every expanding window.

    Boosting adds trees one by one, so the first m of a longer model are the
    model of m trees: only the longest of each line of the grid is fitted, and
    the shorter ones are read off it. Features are assembled and scaled once
    per window. Fits of different windows and lines run side by side.
    """
    lines = grid_points({k: v for k, v in grid.items() if k != "maxIter"})
    lengths = sorted(grid.get("maxIter", [20]))
    prepared = {}
    for i in range(1, n_splits + 1):
        ready = Pipeline(stages=model_pipeline("trees", features, label).getStages()[:2]).fit(folded.filter(F.col("fold") < i))
        prepared[i] = stored(ready.transform(folded.filter(F.col("fold") <= i)).select("fold", "features", F.col(label).cast("double").alias(label)), "fold")

    def fit(job: tuple[int, dict]) -> list[dict]:
        i, line = job
        rows, test = prepared[i].filter(F.col("fold") < i), prepared[i].filter(F.col("fold") == i)
        fitted = estimator("trees", label).setParams(**line, maxIter=lengths[-1]).fit(rows)
        absolute, squared = (fitted.evaluateEachIteration(test, loss) for loss in ("absolute", "squared"))
        return [{**line, "maxIter": m, "fold": i, "mae": absolute[m - 1], "rmse": squared[m - 1] ** 0.5} for m in lengths]

    jobs = [(i, line) for i in prepared for line in lines]
    with ThreadPoolExecutor(threads) as pool:
        return [row for rows in pool.map(fit, jobs) for row in rows]


def best_point(scores: list[dict], names: Sequence[str], metric: str) -> tuple[dict, float]:
    """The parameters with the least mean score over the folds; the first of equal ones."""
    totals: dict[tuple, list[float]] = {}
    for row in scores:
        totals.setdefault(tuple(row[n] for n in names), []).append(row[metric])
    best = min(totals, key=lambda p: sum(totals[p]) / len(totals[p]))
    return dict(zip(names, best, strict=True)), sum(totals[best]) / len(totals[best])


def train_delta_model(
    rows: DataFrame,
    features: Sequence[str],
    kind: str = "trees",
    grid: dict[str, list] | None = None,
    metric: str = "mae",
    n_splits: int = 5,
    ts: str = "ts",
    seq: str | None = None,
    label: str = TARGET,
    test_fraction: float = 0.2,
) -> Trained:
    """Hold out the newest rows, search the grid by time-ordered validation,
    fit the best parameters on all older rows and measure on the newest.

    The L1 regression is chosen by its root mean squared error, whatever
    ``metric`` says: that needs no look at the rows beyond the one scan.
    """
    if grid is None:
        grid = LASSO_GRID if kind == "lasso" else TREE_GRIDS[metric]
    # Numbering reads the rows several times.
    rows = stored(rows.select(ts, *([seq] if seq else []), *features, label), "rows")
    marked = time_split(rows, (), ts, seq, test_fraction)
    marked = stored(marked, "labelled")
    train = stored(time_series_folds(marked.filter(~F.col("is_test")), n_splits, (), ts, seq), "folds")
    test = marked.filter("is_test")
    if kind == "lasso":
        points, final = lasso_path(train, features, label, grid["regParam"], n_splits)
        scores = [{"regParam": p.alpha, "fold": p.fold, "rmse": p.rmse, "n_train": p.n_train, "n_test": p.n_test} for p in points]
        params, score = best_point(scores, ["regParam"], "rmse")
        model = final[params["regParam"]]
    else:
        scores = staged_scores(train, features, grid, n_splits, label)
        params, score = best_point(scores, list(grid), metric)
        model = model_pipeline(kind, features, label, **params).fit(train)
    return Trained(model, params, score, evaluate(model.transform(test), label), list(features), scores)


def feature_importance(spark: SparkSession, trained: Trained) -> DataFrame:
    """``feature, importance``: share of the trees' gain, or absolute coefficient."""
    if isinstance(trained.model, LinearModel):
        weights = trained.model.coefficients
    else:
        stage = trained.model.stages[-1]
        weights = (stage.featureImportances if hasattr(stage, "featureImportances") else stage.coefficients).toArray()
    rows = [(n, abs(float(v))) for n, v in zip(trained.features, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")


def importance_summary(importance: DataFrame) -> DataFrame:
    """Number of features that count, and whether none does."""
    used = F.count_if(F.col("importance") > 0)
    return importance.agg(F.count("*").alias("n"), used.alias("n_nonzero"), (used == 0).alias("all_zero"))


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(k)


def save_model(model: PipelineModel | LinearModel, path: str, spark: SparkSession | None = None) -> None:
    if isinstance(model, LinearModel):
        model.save(spark or SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, kind: str = "pipeline") -> PipelineModel | LinearModel | None:
    """The stored model, or none if it cannot be read."""
    try:
        return LinearModel.load(SparkSession.active(), path) if kind == "linear" else PipelineModel.load(path)
    except Exception as error:  # noqa: BLE001 - any unreadable model means none
        print(f"no model at {path}: {error}")
        return None


def adjust_temperature(
    rows: DataFrame, model: PipelineModel | LinearModel | None, temperature: str = "temperature"
) -> DataFrame:
    """Add the predicted error to the temperature, in batch or on a stream.

    Appends ``delta``, ``original_temperature`` and ``model_used``. Without a
    model, and for rows with a missing feature, the temperature stays as it is.
    """
    original = F.col(temperature)
    if model is None:
        delta = F.lit(0.0)
        return rows.withColumns(
            {"delta": delta, "original_temperature": original, "model_used": F.lit(False)}
        )
    needed = model.features if isinstance(model, LinearModel) else model.stages[0].getInputCols()
    usable = F.lit(True)
    for c in needed:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    # Gaps are filled only so that the row can pass the model; it is not used.
    safe = rows.withColumn("model_used", usable)
    kept = [F.col(c).alias(f"_in_{c}") for c in needed]
    filled = safe.select("*", *kept).withColumns(
        {c: F.when(F.col("model_used"), F.col(c)).otherwise(F.lit(0.0)) for c in needed}
    )
    scored = model.transform(filled)
    before = F.col(f"_in_{temperature}") if temperature in needed else original
    delta = F.when(F.col("model_used"), F.col("prediction")).otherwise(F.lit(0.0))
    columns = []
    for c in rows.columns:
        if c == temperature:
            columns.append((before + delta).alias(c))
        else:
            columns.append(F.col(f"_in_{c}").alias(c) if c in needed else F.col(c))
    return scored.select(
        *columns, delta.alias("delta"), before.alias("original_temperature"), "model_used"
    )
