"""Model training and scoring over the events table (small grids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlab.functions import wire
from sensorlab.operators import asof, features
from sensorlab.plans import batch_queries as batch
from sensorlab.plans import model, stream_queries, views
from sensorlab.session import fresh_folder, stored
from sensorlab.streaming import jobs

QUERIES = {}
SQL = {}
#: Fewer trees than the full grids have; the lines of the grid and their stages are the same.
TREES = {"maxIter": [4, 8, 12], "maxDepth": [2, 4], "minInstancesPerNode": [1, 5]}
ALPHA = 0.1
SWEEPS = 60


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return keep


def device_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of every device row; stored, as training and scoring both start from them."""
    made = features.fused_features(
        views.base(spark, folder), views.channels(spark, folder), ["site"], batch.MEAN_FEATURES, seq="seq",
        window_seconds=6 * batch.HOUR,
    )
    return stored(made, "features")


def labelled(spark: SparkSession, folder: str, made: DataFrame | None = None) -> DataFrame:
    """Features of every device row with the station's matched or imputed value."""
    matched = asof.match_and_impute(
        device_features(spark, folder) if made is None else made, views.of_type(spark, folder, "click"), ["site"], seq="seq",
        gap_seconds=2 * batch.HOUR,
    )
    return features.add_label(matched.na.drop(subset=["outdoor_temperature"]))


def trained(spark, folder, kind="lasso", grid=None, metric="rmse", n_splits=5, made=None) -> model.Trained:
    return model.train_delta_model(labelled(spark, folder, made), model.MEAN_FEATURES, kind, grid, metric, n_splits, seq="seq")


# -- the same by SQL: normal numbers of every window, coordinate descent as a recursion --------

_P = len(model.MEAN_FEATURES)
_X = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in model.MEAN_FEATURES) + "]"
_EXACT = batch.MEAN.replace("round(", "(").replace(", 6)", ")")
_FUSED = f"""fused AS (SELECT w.*, {", ".join(f"fanh_tc{p}" for p in range(4))}
    FROM ({batch.window_sql("true", 6, batch.per_pump(_EXACT, "prikon"))}) w JOIN ({batch.latest_sql("fanh", "{q}_tc{p}")}) l USING (seq))"""
_STEP = f"""list_transform(w, lambda v, k: CASE WHEN k <> s % {_P} + 1 THEN v ELSE
      sign(b[k] - list_dot_product(g[k], w) + g[k][k] * v) * greatest(abs(b[k] - list_dot_product(g[k], w) + g[k][k] * v) - alpha, 0) / nullif(g[k][k], 0) END)"""


def lasso_sql(select: str, alphas: str = "[0.001, 0.01, 0.1, 1.0, 10.0]") -> str:
    """``paths``: weights, means and deviations by window and strength; window 6 trains on all folds."""
    parts = [
        batch.READINGS, batch.DEVICE, batch.METEO, batch.CHANNELS, *[p for p in batch.ASOF if p.split(" AS")[0] not in ("readings", "device", "meteo")],
        batch.NEAREST, batch.MATCHED, _FUSED,
        f"""told AS (SELECT ts, seq, {_X} AS x, outdoor_temperature - temperature AS y FROM fused
          JOIN (SELECT site, seq, outdoor_temperature FROM matched) USING (site, seq) WHERE outdoor_temperature IS NOT NULL)""",
        "placed AS (SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS r, count(*) OVER () - CAST(floor(count(*) OVER () * 0.2) AS BIGINT) AS n FROM told)",
        """folds AS (SELECT *, CASE WHEN r >= n THEN 6 WHEN r - (n - 5 * (n // 6)) < 0 THEN 0
          ELSE (r - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold FROM placed)""",
        f"""long AS (SELECT fold, r, y, unnest(range(1, {_P + 1})) AS j, unnest(x) AS v FROM folds)""",
        "windows AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i)",
        "spread AS (SELECT i, j, avg(v) AS mu, stddev_pop(v) AS sd, covar_pop(v, y) AS c, avg(y) AS y0, count(*) AS n FROM windows JOIN long ON fold < i GROUP BY i, j)",
        """aims AS (SELECT i, list(mu ORDER BY j) AS mu, list(sd ORDER BY j) AS sd, list(c / sd ORDER BY j) AS b, any_value(y0) AS y0, any_value(n) AS n_train
          FROM spread GROUP BY i)""",
        """pairs AS (SELECT i, a.j AS j, z.j AS k, covar_pop(a.v, z.v) AS c FROM windows JOIN long a ON a.fold < i JOIN long z ON z.r = a.r GROUP BY 1, 2, 3)""",
        """gram AS (SELECT i, list(row_ ORDER BY j) AS g FROM (SELECT p.i, p.j, list(p.c / (u.sd * o.sd) ORDER BY p.k) AS row_ FROM pairs p
          JOIN spread u ON u.i = p.i AND u.j = p.j JOIN spread o ON o.i = p.i AND o.j = p.k GROUP BY p.i, p.j) GROUP BY i)""",
        f"""descent AS (SELECT i, alpha, 0 AS s, list_transform(range({_P}), lambda z: 0.0::DOUBLE) AS w FROM windows, (SELECT unnest({alphas})::DOUBLE AS alpha)
          UNION ALL SELECT d.i, alpha, s + 1, {_STEP} FROM descent d JOIN aims USING (i) JOIN gram USING (i) WHERE s < {SWEEPS * _P})""",
        f"paths AS (SELECT i, alpha, w, mu, sd, y0, n_train FROM descent JOIN aims USING (i) WHERE s = {SWEEPS * _P})",
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def predicted(x: str) -> str:
    return f"(y0 + list_dot_product(w, list_transform(range(1, {_P + 1}), lambda k: ({x}[k] - mu[k]) / sd[k])))"


_SCORES = f"""SELECT alpha, i AS fold, any_value(n_train) AS n_train, count(*) AS n_test, sqrt(avg(power(y - {predicted("x")}, 2))) AS rmse
  FROM paths JOIN folds ON fold = i WHERE i < 6 GROUP BY alpha, i"""


@query(lasso_sql(f"SELECT alpha, CAST(fold AS INTEGER) AS fold, n_train, n_test, round(rmse, 6) AS rmse FROM ({_SCORES})"))
def lasso_path(spark, folder):
    """All strengths and windows of the grid, from one scan of the labelled rows."""
    done = trained(spark, folder)
    rows = [(s["regParam"], s["fold"], s["n_train"], s["n_test"], s["rmse"]) for s in done.scores]
    return views.rounded(spark.createDataFrame(rows, "alpha double, fold int, n_train long, n_test long, rmse double"))


def summary(spark: SparkSession, kind: str, done: model.Trained) -> DataFrame:
    row = (kind, str(done.params), float(done.cv_score), float(done.test["mae"]), float(done.test["rmse"]), int(done.test["n"]))
    return views.rounded(
        spark.createDataFrame([row], "model string, params string, cv_score double, test_mae double, test_rmse double, n_test long")
    )


@query(
    lasso_sql(
        f"""SELECT 'lasso' AS model, '{{''regParam'': ' || CAST(alpha AS VARCHAR) || '}}' AS params, any_value(round(score, 6)) AS cv_score,
        round(avg(abs(y - {predicted("x")})), 6) AS test_mae, round(sqrt(avg(power(y - {predicted("x")}, 2))), 6) AS test_rmse, count(*) AS n_test
        FROM (SELECT alpha, avg(rmse) AS score FROM ({_SCORES}) GROUP BY alpha ORDER BY score LIMIT 1) JOIN paths USING (alpha) JOIN folds ON fold = 6
        WHERE i = 6 GROUP BY alpha"""
    )
)
def train_lasso(spark, folder):
    """The full grid of strengths on five windows; the best one measured on the newest rows."""
    return summary(spark, "lasso", trained(spark, folder))


@query()
def train_trees(spark, folder):
    """Every point of the grid with its mean scores over three windows."""
    done = trained(spark, folder, "trees", TREES, "mae", 3)
    totals: dict[tuple, list] = {}
    for s in done.scores:
        totals.setdefault(tuple(s[k] for k in TREES), []).append((s["mae"], s["rmse"]))
    rows = [
        (*point, sum(m for m, _ in found) / len(found), sum(r for _, r in found) / len(found), dict(zip(TREES, point, strict=True)) == done.params, float(done.test["mae"]))
        for point, found in totals.items()
    ]
    return spark.createDataFrame(
        rows, "max_iter int, max_depth int, min_instances int, cv_mae double, cv_rmse double, chosen boolean, test_mae double"
    )


_NAMES = "[" + ", ".join(f"'{c}'" for c in model.MEAN_FEATURES) + "]"


@query(
    lasso_sql(
        f"""SELECT feature, round(importance, 6) AS importance FROM (SELECT unnest({_NAMES}) AS feature, unnest(list_transform(w, lambda v: abs(v))) AS importance
        FROM paths WHERE i = 6 AND alpha = {ALPHA}) ORDER BY importance DESC, feature LIMIT 10"""
    )
)
def feature_importance(spark, folder):
    done = trained(spark, folder, grid={"regParam": [ALPHA]})
    return views.rounded(model.top_features(model.feature_importance(spark, done)))


@query(
    lasso_sql(
        """SELECT count(*) AS n, count(*) FILTER (v <> 0) AS n_nonzero, count(*) FILTER (v <> 0) = 0 AS all_zero
        FROM (SELECT unnest(w) AS v FROM paths WHERE i = 6 AND alpha = 10.0)"""
    )
)
def importance_summary(spark, folder):
    """How many features a strong penalty leaves."""
    done = trained(spark, folder, grid={"regParam": [10.0]})
    return model.importance_summary(model.feature_importance(spark, done))


def adjusted(columns: str) -> str:
    delta = predicted(_X)
    return f"""SELECT {columns}, round(temperature + {delta}, 6) AS temperature, round({delta}, 6) AS delta,
        temperature AS original_temperature, true AS model_used FROM fused, paths WHERE i = 6 AND alpha = {ALPHA}"""


_MADE = ", ".join(f"round({c}, 6) AS {c}" for c in model.MEAN_FEATURES if c != "temperature")


@query(lasso_sql(adjusted(f"site, ts, seq, {_MADE}")))
def adjust_temperature(spark, folder):
    """Train, store, load and apply: every device row with its corrected value."""
    made = device_features(spark, folder)
    done = trained(spark, folder, grid={"regParam": [ALPHA]}, made=made)
    path = fresh_folder(spark, "model")
    model.save_model(done.model, path, spark)
    return views.rounded(model.adjust_temperature(made, model.load_model(path, "linear")))


_SCORED = {"time": "ts", "processing_time": "10000.0 - seq / 1000.0"}


@query(lasso_sql(batch.json_sql("scored", _SCORED, "(" + adjusted(f"site, ts, seq, {_MADE}") + ")")))
def wire_scored(spark, folder):
    """JSON records of the scored readings."""
    made = device_features(spark, folder)
    done = trained(spark, folder, grid={"regParam": [ALPHA]}, made=made)
    rows = views.rounded(model.adjust_temperature(made, done.model))
    rows = rows.withColumns({"time": F.col("ts"), "produced_at": F.col("seq") / F.lit(1000.0)})
    return batch.as_json(wire.with_latency(rows, now=F.lit(batch.CLOCK)), "scored")


@query(lasso_sql(adjusted(f"site, ts, seq, seq / 1000.0 AS produced_at, {_MADE}")))
def stream_scoring(spark, folder):
    """The feature job with the model applied to the stream."""
    done = trained(spark, folder, grid={"regParam": [ALPHA]})
    rows = stream_queries.stream(spark, folder)
    made = jobs.feature_job(
        stream_queries.stream_base(rows), stream_queries.stream_channels(rows), ["site"], batch.MEAN_FEATURES,
        6 * batch.HOUR,
    ).filter("site >= 0")
    return views.naive(views.rounded(jobs.run_available(model.adjust_temperature(made, done.model), "stream-scoring")))
