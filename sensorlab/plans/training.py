"""Training table: match, impute, label, lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sensorlab.operators.asof import match_and_impute
from sensorlab.operators.features import add_label, lag_features, vector_lags
from sensorlab.operators.rolling import mad_filter
from sensorlab.operators.sets import merge_first, observed_filter, union_all
from sensorlab.operators.slices import micros, plan_slices
from sensorlab.session import stored

#: More columns than this are shifted together instead of by window expressions.
FEW = 4


def training_rows(
    exports: Sequence[DataFrame],
    station: DataFrame,
    key: Sequence[str],
    features: Sequence[str],
    ts: str = "ts",
    seq: str | None = None,
    tolerance_seconds: float = 20 * 60,
    gap_seconds: float = 45 * 60,
    lags: Sequence[int] = (1, 2),
    windows: Sequence[int] = (3, 6),
    observed: dict[str, Observation] | None = None,
) -> DataFrame:
    """Labelled rows with lag features, none incomplete.

    ``exports`` are merged, the first has priority at equal times. The station
    is cleaned of outliers, matched to the nearest time or imputed from both
    sides; rows that stay without a station value are dropped. ``observed`` may
    name observations of the rows that the filters see and keep: ``outliers``
    and ``unmatched``; they are there once this returns.
    """
    watch = observed or {}
    times = [t.select(*key, ts) for t in [*exports, station]]
    plan = plan_slices(union_all(*times), key, micros(ts))
    merged = merge_first(exports, key, ts, seq)
    clean = stored(mad_filter(station, key, ts=ts, seq=seq, plan=plan, observation=watch.get("outliers")), "clean")
    matched = match_and_impute(
        merged,
        clean,
        key,
        ts=ts,
        seq=seq,
        tolerance_seconds=tolerance_seconds,
        gap_seconds=gap_seconds,
        plan=plan,
    )
    found = observed_filter(matched, F.col("outdoor_temperature").isNotNull(), watch.get("unmatched"))
    labelled = stored(add_label(found).drop("outdoor_temperature"), "labelled")
    shift = vector_lags if len(features) > FEW else lag_features
    return shift(labelled, key, features, lags, windows, ts, seq, drop_incomplete=True, plan=plan)
