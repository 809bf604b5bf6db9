from datetime import datetime, timedelta

T0 = datetime(2025, 4, 13)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def series(spark, rows, site=1):
    """Readings from (seconds, value) pairs; arrival in the given order."""
    data = [(site, at(s), float(v), i, 1.5) for i, (s, v) in enumerate(rows)]
    return spark.createDataFrame(
        data, "site long, ts timestamp, value double, seq long, produced_at double"
    )


def pump_rows(spark, rows, site=1):
    """Channel readings from (seconds, quantity, pump, value)."""
    data = [(site, at(s), float(v), i, p, q) for i, (s, q, p, v) in enumerate(rows)]
    return spark.createDataFrame(
        data, "site long, ts timestamp, value double, seq long, pump int, quantity string"
    )


def base_rows(spark, seconds, site=1):
    data = [(site, at(s), 20.0 + i, i, 0.0) for i, s in enumerate(seconds)]
    return spark.createDataFrame(
        data, "site long, ts timestamp, temperature double, seq long, produced_at double"
    )


def values(df, *columns, order=("ts", "seq")):
    order = [c for c in order if c in df.columns]
    rows = df.orderBy(*order).select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]
