"""L1 regression for all strengths and all expanding windows from one scan.

The scan sums, for each fold, the products of all features and the label. Sums
over the folds before a window are all that its training needs, and those of
the next fold are all that its root mean squared error needs; so a grid of
strengths and windows costs no further job. Coordinate descent works on numbers
of features x features, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS, CLOSE = 10_000, 1e-13


@dataclass(frozen=True)
class Moments:
    """Number, sums and products of rows of features and label, each less a centre."""

    centre: np.ndarray
    n: int
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.centre, self.n + other.n, self.sums + other.sums, self.products + other.products)

    @property
    def means(self) -> np.ndarray:
        return self.centre + self.sums / self.n

    @property
    def covariance(self) -> np.ndarray:
        return self.products / self.n - np.outer(self.sums, self.sums) / self.n**2


@dataclass(frozen=True)
class LinearModel:
    """A prediction ``intercept + sum of coefficient * (x - mean) / scale`` as a plain expression."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def prediction(self) -> Column:
        out = F.lit(self.intercept)
        for name, mean, scale, weight in zip(self.features, self.means, self.scales, self.coefficients, strict=True):
            if weight:
                out = out + F.lit(weight) * (F.col(name).cast("double") - F.lit(mean)) / F.lit(scale)
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", self.prediction())

    def mean_squared_error(self, rows: Moments) -> float:
        """The error over the rows the moments were taken of, label last."""
        slope = np.append(-np.array(self.coefficients) / np.array(self.scales), 1.0)
        shift = slope[:-1] @ (rows.centre[:-1] - np.array(self.means)) + rows.centre[-1] - self.intercept
        return float((slope @ rows.products @ slope + 2 * shift * (slope @ rows.sums)) / rows.n + shift * shift)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [*zip(range(len(self.features)), self.features, self.means, self.scales, self.coefficients, strict=True), (-1, "", 0.0, 1.0, self.intercept)]
        frame = spark.createDataFrame(rows, "place int, feature string, mean double, scale double, coefficient double")
        frame.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        rows = spark.read.parquet(path).orderBy("place").collect()
        names, means, scales, weights = zip(*[(r["feature"], r["mean"], r["scale"], r["coefficient"]) for r in rows[1:]], strict=True)
        return LinearModel(names, means, scales, weights, rows[0]["coefficient"])


def fold_moments(rows: DataFrame, columns: Sequence[str], fold: str = "fold") -> dict[int, Moments]:
    """Moments of each fold in one job: a task sums its rows, Spark the tasks.

    Some first rows give a centre near the means, which saves digits only.
    """
    values = rows.select(F.col(fold).cast("int").alias("_fold"), *[F.col(c).cast("double").alias(c) for c in columns])
    d = len(columns)
    centre = np.nan_to_num(np.array([[r[c] or 0.0 for c in columns] for r in values.limit(100).collect()], float).reshape(-1, d))
    centre = centre.mean(axis=0) if len(centre) else np.zeros(d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float) - centre
            for k in np.unique(folds).tolist():
                part = x[folds == k]
                total = np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
                held[k] = held.get(k, 0) + total
        for k, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), k)), pa.array(np.arange(len(total))), pa.array(total)], ["fold", "at", "m"])

    found = values.mapInArrow(sums, "fold long, at long, m double").groupBy("fold", "at").agg(F.sum("m").alias("m")).toPandas()
    out = {}
    for k, part in found.groupby("fold"):
        m = part.sort_values("at")["m"].to_numpy()
        if not np.isfinite(m).all():
            raise ValueError("features and label must be finite numbers")
        out[int(k)] = Moments(centre, int(m[0]), m[1 : d + 1], m[d + 1 :].reshape(d, d))
    return out


def descend(gram: np.ndarray, aims: np.ndarray, alpha: float, start: np.ndarray | None = None) -> np.ndarray:
    """Minimise 1/2 w'Gw - w'b + alpha |w|_1, one coordinate after another."""
    w = np.zeros(len(aims)) if start is None else start.copy()
    pull = gram @ w
    for _ in range(ROUNDS):
        moved = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            rest = aims[j] - pull[j] + gram[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / gram[j, j]
            if new != w[j]:
                pull += gram[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved <= CLOSE * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def fit_path(train: Moments, features: Sequence[str], alphas: Sequence[float]) -> dict[float, LinearModel]:
    """A model for each strength; features are scaled by their population deviation, the stronger one starts the weaker."""
    means, covariance = train.means, train.covariance
    spread = np.sqrt(np.maximum(np.diag(covariance)[:-1], 0.0))
    # A constant feature has no weight.
    spread[spread <= 1e-12 * np.maximum(1.0, np.abs(means[:-1]))] = 0.0
    scale = np.where(spread > 0, spread, 1.0)
    gram = covariance[:-1, :-1] / np.outer(scale, scale)
    gram[:, spread == 0] = gram[spread == 0] = 0.0
    aims = np.where(spread > 0, covariance[:-1, -1] / scale, 0.0)
    out, w = {}, None
    for alpha in sorted(alphas, reverse=True):
        w = descend(gram, aims, alpha, w)
        out[alpha] = LinearModel(tuple(features), tuple(means[:-1].tolist()), tuple(scale.tolist()), tuple(w.tolist()), float(means[-1]))
    return out


@dataclass(frozen=True)
class PathPoint:
    alpha: float
    fold: int
    n_train: int
    n_test: int
    rmse: float
    model: LinearModel


def lasso_path(
    folded: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float], n_splits: int = 5, fold: str = "fold"
) -> tuple[list[PathPoint], dict[float, LinearModel]]:
    """Scores of every strength on every expanding window, and models of all folds.

    Fold i is predicted from all folds before it. Windows without rows to train
    on or to predict are left out.
    """
    folds = fold_moments(folded, [*features, label], fold)
    points, train = [], folds.get(0)
    for i in range(1, n_splits + 1):
        test = folds.get(i)
        if train is not None and test is not None:
            for alpha, model in fit_path(train, features, alphas).items():
                points.append(PathPoint(alpha, i, train.n, test.n, max(model.mean_squared_error(test), 0.0) ** 0.5, model))
        if test is not None:
            train = test if train is None else train + test
    return sorted(points, key=lambda p: (p.alpha, p.fold)), fit_path(train, features, alphas) if train is not None else {}
