"""Features of a base series from many device channels, and row-based lags."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sensorlab.operators.slices import (
    BLOCK,
    HOT,
    SLICE,
    SlicePlan,
    drop_margin,
    micros,
    plan_slices,
    row_blocks,
    tie_order,
)
from sensorlab.session import stored

PUMPS = (0, 1, 2, 3)


@dataclass(frozen=True)
class Feature:
    """What to compute per pump from the channels of one quantity.

    ``stat``: ``mean`` of the trailing window, ``rate`` of change over it (per
    second, with the window's first value), or ``latest`` value of all time.
    ``carry_forward`` lets a rate without result keep the last value seen.
    """

    quantity: str
    stat: str
    carry_forward: bool = False


_FRONT, _BACK = -(2**62), 2**62


def fused_features(
    base: DataFrame,
    readings: DataFrame,
    key: Sequence[str],
    features: Sequence[Feature],
    ts: str = "ts",
    value: str = "value",
    seq: str | None = None,
    window_seconds: float = 5 * 60,
    pumps: Sequence[int] = PUMPS,
    plan: SlicePlan | None = None,
    forget_after_seconds: float | None = None,
) -> DataFrame:
    """All channel features of every base row.

    ``readings`` has ``quantity`` and ``pump`` besides key, time and value.
    The window is ``[t - window, t]``. It follows from two points of each
    channel: counts and sums up to ``t`` less those before ``t - window``, the
    last reading up to ``t`` and the first one from ``t - window`` on. So every
    base row visits the series twice, at the opening of its window and at its
    own time, and takes what its channels have come to there from one ordered
    pass over Arrow batches. The cost per row does not depend on how many
    readings a window holds. With ``forget_after_seconds`` a latest value
    older than that counts as none.

    The opening of a window of rates is visited against time, so that its first
    reading is the last one seen. In split series each (slice, channel) gets a
    row more in a pass, with what lies before or behind the slice; no reading
    is placed twice in one, however long the window is.
    """
    width = int(window_seconds * 1e6)
    quantities = sorted({f.quantity for f in features})
    channels = [f"{q}_tc{p}" for q in quantities for p in pumps]
    arrival = (F.col(seq) if seq else F.lit(0)).cast("long")
    read = (
        readings.filter(
            F.col("quantity").isin(*quantities)
            & F.col("pump").isin(*pumps)
            & F.col(ts).isNotNull()
            & F.col(value).isNotNull()
            & ~F.isnan(F.col(value).cast("double"))
            & (F.abs(F.col(value).cast("double")) != F.lit(float("inf")))
        )
        .select(
            *key,
            F.concat_ws("_tc", "quantity", F.col("pump").cast("string")).alias("_channel"),
            micros(ts).alias("_us"),
            F.struct(
                micros(ts).alias("us"), arrival.alias("seq"), F.col(value).cast("double").alias("v")
            ).alias("_r"),
        )
        .withColumn("_base", F.lit(False))
    )
    tie = F.col(seq).cast("long") if seq and seq in base.columns else F.lit(0).cast("long")
    rows = base.withColumns({"_us": micros(ts), "_base": F.lit(True), "_tie": tie})
    by = [F.col("_us"), F.col("_base").cast("int"), F.coalesce("_r.seq", "_tie")]
    times = read.select(*key, "_us", "_base", "_r").unionByName(rows.select(*key, "_us", "_base", "_tie"), allowMissingColumns=True)
    plan = plan or plan_slices(times, key, *by)
    # The look-up for split series alone; the other rows make it on the spot.
    opening = {s: [f"{f.quantity}_tc{p}" for f in features if f.stat == s for p in pumps] for s in ("mean", "rate")}
    opening = {s: list(dict.fromkeys(found)) for s, found in opening.items() if found}
    sums = _SUMS["mean"] if "mean" in opening else _SUMS["rate"]
    read = plan.assign(plan.mark_hot(read), F.col("_us"), F.lit(0), F.col("_r.seq")).drop(HOT)
    read = read.withColumns(_added(F.col("_r.v")) if "mean" in opening else {}).withColumn("_n", F.lit(1).cast("long"))
    if not plan.single:
        # Every pass reads it, and the look-up is dear.
        read = stored(read, "readings")
    front = back = None
    if not plan.single or "rate" in opening:
        front, back = _rims(read, plan, channels, sums)

    def visit(rows: DataFrame, read: DataFrame, rims: DataFrame | None) -> DataFrame:
        placed = plan.assign(rows, F.col("_us"), F.lit(1), F.col("_tie")).drop(HOT).unionByName(read, allowMissingColumns=True)
        return placed if rims is None else placed.unionByName(rims, allowMissingColumns=True)

    for stat, some in opening.items():
        wanted = F.col("_channel").isin(*some)
        opened = rows.withColumns({"_t": F.col("_us"), "_us": F.col("_us") - width - 1})
        if stat == "rate":
            # Against time, readings are taken off what has come up to the slice's end.
            placed = visit(opened, read.filter(wanted).withColumn("_n", F.lit(-1).cast("long")), back.filter(wanted))
            states = _channel_states(placed, plan, {stat}, backward=True)
        else:
            placed = visit(opened, read.filter(wanted), None if plan.single else front.filter(wanted))
            states = _channel_states(placed, plan, {stat})
        kept = [c for c in opened.columns if c not in ("_us", "_base")]
        rows = _look_up(states, plan, some, kept, f"_{stat}", _SUMS[stat], seen=stat == "rate")
        rows = rows.withColumnRenamed("_t", "_us").withColumn("_base", F.lit(True))
    states = _channel_states(visit(rows, read, None if plan.single else front), plan, set(opening))
    kept = [c for c in rows.columns if c != "_base"]
    last_sums = sums if opening else []
    states = _look_up(states, plan, channels, kept, "_last", last_sums, seen=True)

    out: list[Column] = []
    zero = F.lit(0.0)
    for f in features:
        for p in pumps:
            c = f"{f.quantity}_tc{p}"
            latest, us = (_part("_last", channels.index(c), part, last_sums, True) for part in ("_v", "_us"))
            known = latest
            if forget_after_seconds is not None:
                latest = F.when(F.col("_us") - us <= F.lit(int(forget_after_seconds * 1e6)), latest)
            if f.stat == "latest":
                out.append(F.coalesce(latest, zero).alias(c))
                continue

            def opened_at(part: str, c=c, stat=f.stat) -> Column:
                return _part(f"_{stat}", opening[stat].index(c), part, _SUMS[stat], stat == "rate")

            def inside(part: str, c=c, opened_at=opened_at) -> Column:
                return _part("_last", channels.index(c), part, last_sums, True) - opened_at(part)

            n = inside("_n")
            if f.stat == "mean":
                total = _decimal(*[inside(d) for d in _DIGITS])
                out.append(F.when(n > 0, (total.cast("double") + inside("_rest")) / n).otherwise(zero).alias(c))
                continue
            first_us, first_v = opened_at("_us"), opened_at("_v")
            seconds = (us - first_us) / F.lit(1e6)
            timed = (n > 1) & (seconds > 0)
            rate = F.when(timed, (known - first_v) / seconds).otherwise(zero)
            fallback = F.coalesce(latest, zero) if f.carry_forward else zero
            out.append(rate.alias(f"{c}_rate"))
            out.append(F.when(timed, first_v).otherwise(fallback).alias(f"{c}_value"))
            out.append(n.alias(f"{c}_n"))
    return states.select(*base.columns, *out)


#: A sum of decimals with nine places travels as sums of digits to base 1e9, the last one first; these stay
#: below a long for nine billion readings. What a decimal leaves of a value is summed as a double.
_DIGITS = ["_s0", "_s1", "_s2"]
_BASE = 10**9
_KINDS = {"_longs": T.LongType(), "_doubles": T.DoubleType()}
_SUMS = {"mean": ["_n", *_DIGITS, "_rest"], "rate": ["_n"]}


def _near(v: Column) -> Column:
    """The decimal part of a value: its sums are exact, so their differences are too."""
    return F.coalesce(v.try_cast("decimal(27,9)"), F.lit(0).cast("decimal(27,9)"))


def _kind(part: str) -> str:
    return "_doubles" if part in ("_rest", "_v") else "_longs"


def _added(v: Column) -> dict[str, Column]:
    """What one value adds to the sums."""
    near, unit = _near(v), F.lit(_BASE).cast("long")
    whole = F.floor(near).cast("long")
    place = ((near - F.floor(near)) * F.lit(_BASE)).cast("long")
    return {"_s0": place, "_s1": whole % unit, "_s2": F.call_function("div", whole, unit), "_rest": v - near.cast("double")}


def _decimal(low: Column, middle: Column, high: Column) -> Column:
    whole = high.cast("decimal(19,0)") * F.lit(Decimal(_BASE)) + middle.cast("decimal(19,0)")
    return whole.cast("decimal(28,0)") + low.cast("decimal(19,0)") * F.lit(1 / Decimal(_BASE))


def _rims(read: DataFrame, plan: SlicePlan, channels: Sequence[str], sums: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """For each (slice, channel) a row in front, for passes in time, and one behind, for those against it.

    The row in front is the channel's last reading before the slice, with the
    number and ``sums`` of all readings up to it. The row behind is the next
    reading, with the number and sums of all up to the slice's end.
    """
    spot = [*plan.key, SLICE]
    parts = [F.sum(name).alias(name) for name in sums]
    ends = read.groupBy(*spot, "_channel").agg(*parts, F.min("_r").alias("_first"), F.max("_r").alias("_final"))
    if not plan.single:
        every = plan.every_slice().withColumn("_channel", F.explode(F.array(*[F.lit(c) for c in channels])))
        every = every.withColumns({name: F.lit(0).cast("double" if name == "_rest" else "long") for name in sums})
        ends = ends.unionByName(every, allowMissingColumns=True).groupBy(*spot, "_channel")
        ends = stored(ends.agg(*parts, F.min("_first").alias("_first"), F.max("_final").alias("_final")), "ends")
    series = Window.partitionBy(*plan.key, "_channel")
    before = series.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    through = series.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = series.orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)

    def rim(us: int, reading: Column, over) -> DataFrame:
        many = [F.sum(name).over(over).alias(name) for name in sums]
        rows = ends.select(*spot, "_channel", F.lit(us).cast("long").alias("_us"), reading.alias("_r"), *many)
        return rows.filter("_n > 0 OR _r IS NOT NULL").withColumn("_base", F.lit(False))

    return rim(_FRONT, F.max("_final").over(before), before), rim(_BACK, F.min("_first").over(behind), through)


def _channel_states(placed: DataFrame, plan: SlicePlan, stats: set[str], backward: bool = False) -> DataFrame:
    """Every slice in one place, ordered with or against time, and the sums that ``stats`` need."""
    order = [F.col(c).desc() if backward else F.col(c).asc() for c in ("_us", "_base", "_r")]
    unused = [] if "mean" in stats else [c for c in _SUMS["mean"] if c not in _SUMS["rate"]]
    placed = placed.drop(*unused)
    placed = placed.repartition(*plan.group) if plan.group else placed.repartition(1)
    return placed.sortWithinPartitions(*plan.group, *order)


def _look_up(
    states: DataFrame, plan: SlicePlan, channels: Sequence[str], keep: Sequence[str], name: str, sums: Sequence[str], seen: bool
) -> DataFrame:
    """The base rows' ``keep`` with what every channel has come to before them in its slice.

    Of each channel ``sums`` and, of the reading ``seen`` last, ``_us`` and
    ``_v``, null before the first. They are packed into two arrays, which cost
    the rows of readings in the next pass nothing; ``_part`` unpacks them.
    """
    group = plan.group
    number = (F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("_channel")) - 1).cast("int")
    slim = states.select(
        *dict.fromkeys([*keep, *group]), "_base", F.coalesce(number, F.lit(-1)).alias("_number"),
        F.col("_r.us").alias("_seen_us"), F.col("_r.v").alias("_seen_v"), *sums,
    )
    packs = [T.StructField(f"{name}{kind}", T.ArrayType(of)) for kind, of in _KINDS.items()]
    schema = T.StructType([*slim.select(*keep).schema.fields, *packs])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = _changes(batch, group)
            if last is not None and all(batch.column(c)[0].equals(v) for c, v in zip(group, last, strict=True)):
                fresh[0] = False
            else:
                carry = None
            last = [batch.column(c)[n - 1] for c in group]
            base = np.flatnonzero(batch.column("_base").to_numpy(zero_copy_only=False))
            # The batch's end is looked up, too, for the next one.
            at = np.append(base, n)
            begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            begin = np.append(begin[base], begin[-1])
            ongoing = int(np.argmax(fresh)) if fresh.any() else n  # rows of the group that the last batch began
            number = batch.column("_number").to_numpy()
            adds = {s: pc.fill_null(batch.column(s), 0).to_numpy(zero_copy_only=False) for s in sums}
            us, v = batch.column("_seen_us"), batch.column("_seen_v")
            known = us.is_valid().to_numpy(zero_copy_only=False)
            us, v = pc.fill_null(us, 0).to_numpy(), pc.fill_null(v, 0.0).to_numpy()
            made: dict[str, list] = {kind: [] for kind in _KINDS}
            ends = []
            for c in range(len(channels)):
                mine = np.flatnonzero(number == c)
                upto, since = np.searchsorted(mine, at), np.searchsorted(mine, begin)
                old = carry[c] if carry else {**dict.fromkeys(sums, 0), "at": None}
                goes_on = at < ongoing if ongoing < n else np.ones(len(at), bool)
                end = {}
                for s in sums:
                    total = _running(adds[s][mine], since, upto, int(np.searchsorted(mine, ongoing)), old[s], goes_on)
                    made[_kind(s)].append((total[:-1], np.ones(len(base), bool)))
                    end[s] = total[-1]
                if seen:
                    here = upto > since
                    spot = mine[np.maximum(upto - 1, 0)] if len(mine) else np.zeros(len(at), int)
                    then = old["at"] or (0, 0.0)
                    is_known = np.where(here, known[spot], goes_on & (old["at"] is not None))
                    last_us, last_v = np.where(here, us[spot], then[0]), np.where(here, v[spot], then[1])
                    made["_longs"].append((last_us[:-1], is_known[:-1]))
                    made["_doubles"].append((last_v[:-1], is_known[:-1]))
                    end["at"] = (last_us[-1], last_v[-1]) if is_known[-1] else None
                ends.append(end)
            carry = ends
            kept = batch.take(pa.array(base))
            packed = [_packed(made[kind], len(base), pa.int64() if kind == "_longs" else pa.float64()) for kind in _KINDS]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), *packed], names)

    return slim.mapInArrow(run, schema)


def _packed(columns: list[tuple[np.ndarray, np.ndarray]], rows: int, kind: pa.DataType) -> pa.Array:
    """A list for each row of its values in all ``columns``, null where they aren't known."""
    if not columns:
        return pa.nulls(rows, pa.list_(kind))
    flat = pa.array(np.column_stack([x for x, _ in columns]).ravel(), kind, mask=~np.column_stack([known for _, known in columns]).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(columns)), flat)


def _part(name: str, channel: int, part: str, sums: Sequence[str], seen: bool) -> Column:
    """One part of what `_look_up` has packed."""
    kind = _kind(part)
    of_kind = [p for p in (*sums, *(("_us", "_v") if seen else ())) if _kind(p) == kind]
    return F.get(F.col(f"{name}{kind}"), F.lit(channel * len(of_kind) + of_kind.index(part)))


def _running(x: np.ndarray, since: np.ndarray, upto: np.ndarray, ongoing: int, old, goes_on: np.ndarray) -> np.ndarray:
    """Sums of ``x[since:upto]``, those that go on from the last batch with its sum ``old``; no sum is a difference of doubles."""
    if x.dtype.kind == "i" or not (x.any() or old):
        total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
        return total[upto] - total[since] + np.where(goes_on, old, 0).astype(x.dtype)
    total = np.zeros(len(x) + 1)
    total[: ongoing + 1] = np.cumsum(np.concatenate([[old], x[:ongoing]]))
    cuts = np.unique(np.append(since[since >= ongoing], ongoing))
    for a, b in zip(cuts, np.append(cuts[1:], len(x)), strict=True):
        total[a + 1 : b + 1] = np.cumsum(x[a:b])
    return np.where(goes_on, total[upto], np.where(upto > since, total[upto], 0.0))


def latest_values(base, readings, key, quantity="fanh", **options) -> DataFrame:
    """Last value of each pump seen up to each base row; 0.0 before the first."""
    return fused_features(base, readings, key, [Feature(quantity, "latest")], **options)


def window_features(
    base, readings, key, quantity="prikon", stat="mean", carry_forward=False, **options
) -> DataFrame:
    """Trailing-window mean or rate of change of each pump."""
    return fused_features(base, readings, key, [Feature(quantity, stat, carry_forward)], **options)


def exact_join(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    ts: str = "ts",
    seq: str | None = None,
) -> DataFrame:
    """Pair the rows of both sides that have the same time, each once.

    Each side is first reduced to its first row per time (already on the map
    side), so copies never multiply; the join then reuses that partitioning.
    """

    def once(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*key, ts).orderBy(*tie_order(df, [*key, ts], ts, seq)[1:])
        return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")

    shared = [*key, ts]
    other = once(right).drop(*([seq] if seq and seq in left.columns and seq in right.columns else []))
    return once(left).join(other, shared, "inner")


def add_label(
    df: DataFrame,
    actual: str = "outdoor_temperature",
    measured: str = "temperature",
    name: str = "temperature_delta",
) -> DataFrame:
    return df.withColumn(name, F.col(actual) - F.col(measured))


def lag_features(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    lags: Sequence[int] = (1, 2),
    windows: Sequence[int] = (3, 6),
    ts: str = "ts",
    seq: str | None = None,
    drop_incomplete: bool = False,
    plan: SlicePlan | None = None,
) -> DataFrame:
    """Lags and means of the previous rows, over one shared ordering.

    ``{c}_lag{n}`` is the value n rows before; ``{c}_roll{n}_mean`` the mean of
    the n rows before the current one, null unless all n are there. Columns
    that do not exist are passed over.
    """
    present = [c for c in columns if c in df.columns]
    order = tie_order(df, key, ts, seq)
    blocked = row_blocks(df, key, order, before=max([*lags, *windows, 0]), plan=plan)
    w = Window.partitionBy(*key, BLOCK).orderBy(*order)
    made: dict[str, Column] = {}
    for c in present:
        for n in lags:
            made[f"{c}_lag{n}"] = F.lag(c, n).over(w)
        for n in windows:
            previous = w.rowsBetween(-n, -1)
            made[f"{c}_roll{n}_mean"] = F.when(
                F.count(c).over(previous) == n, F.avg(c).over(previous)
            )
    done = drop_margin(blocked.withColumns(made))
    return done.na.drop("any") if drop_incomplete else done


def vector_lags(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    lags: Sequence[int] = (1, 2),
    windows: Sequence[int] = (3, 6),
    ts: str = "ts",
    seq: str | None = None,
    drop_incomplete: bool = False,
    plan: SlicePlan | None = None,
) -> DataFrame:
    """The same as `lag_features` for many columns, as doubles.

    All of them are shifted together in one pass over Arrow batches, one sort
    for all; the tail of a batch, as many rows as the longest lag, is carried to
    the next one. That takes the place of a window expression for each column.
    """
    present = [c for c in columns if c in df.columns]
    order = tie_order(df, key, ts, seq)
    reach = max([*lags, *windows, 0])
    blocked = row_blocks(df, key, order, before=reach, plan=plan)
    group = [*key, BLOCK]
    placed = blocked.repartition(*group).sortWithinPartitions(*group, *order)
    names = [n for c in present for n in (*(f"{c}_lag{n}" for n in lags), *(f"{c}_roll{n}_mean" for n in windows))]
    schema = T.StructType([*placed.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, last = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = _changes(batch, group)
            first = [batch.column(c)[0] for c in group]
            x = np.column_stack([pc.fill_null(batch.column(c).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for c in present])
            known = np.column_stack([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in present])
            if tail is not None and all(a.equals(b) for a, b in zip(first, last, strict=True)):
                fresh[0] = False
                x, known = np.vstack([tail[0], x]), np.vstack([tail[1], known])
                fresh = np.concatenate([np.zeros(len(tail[0]), bool), fresh])
            ahead = len(x) - n
            rows = np.arange(len(x))
            begin = np.maximum.accumulate(np.where(fresh, rows, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_shifted(x, known, begin, ahead, lags, windows)], schema=to_arrow_schema(schema))
            keep = max(int(begin[-1]), len(x) - reach)
            tail, last = (x[keep:], known[keep:]), [batch.column(c)[n - 1] for c in group]

    done = drop_margin(placed.mapInArrow(run, schema)) if present else drop_margin(placed)
    return done.na.drop("any") if drop_incomplete else done


def _changes(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Whether each row differs from the one above it; nulls are equal."""
    changed = np.zeros(batch.num_rows, bool)
    changed[0] = True
    for c in columns:
        column = batch.column(c)
        above, below = column.slice(0, len(column) - 1), column.slice(1)
        unlike = pc.fill_null(pc.not_equal(above, below), False).to_numpy(zero_copy_only=False)
        one_null = pc.not_equal(above.is_null(), below.is_null()).to_numpy(zero_copy_only=False)
        changed[1:] |= unlike | one_null
    return changed


def _shifted(x: np.ndarray, known: np.ndarray, begin: np.ndarray, ahead: int, lags: Sequence[int], windows: Sequence[int]) -> list[pa.Array]:
    """Lags and means of the rows before each, column by column; rows before ``ahead`` are the carried ones."""
    rows = np.arange(ahead, len(x))
    reach = rows - begin[ahead:]
    out: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for n in lags:
        at = np.maximum(rows - n, 0)
        out["lag", n] = x[at], known[at] & (reach >= n)[:, None]
    for n in windows:
        total, whole = np.zeros((len(rows), x.shape[1])), np.repeat((reach >= n)[:, None], x.shape[1], axis=1)
        for k in range(n, 0, -1):
            at = np.maximum(rows - k, 0)
            total += x[at]
            whole &= known[at]
        out["roll", n] = total / n, whole
    return [
        pa.array(np.ascontiguousarray(values[:, j]), mask=~seen[:, j])
        for j in range(x.shape[1])
        for values, seen in (*(out["lag", n] for n in lags), *(out["roll", n] for n in windows))
    ]


def rolling_features(df, key, columns, windows=(3, 6), **options) -> DataFrame:
    return lag_features(df, key, columns, lags=(), windows=windows, **options)
