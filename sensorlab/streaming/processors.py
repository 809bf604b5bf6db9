"""Stateful processors for event-time streams.

Rows of a micro-batch come in no order, so every processor first keeps the rows
of its series until the watermark has passed them and then takes them in time
order. Results therefore equal those of the batch operators, whatever the order
of arrival within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sensorlab.operators.gate import fold_gate


# Waiting rows are kept per day, so a backlog is worked off in pieces.
PIECE_MS = 86_400_000


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


LONG, DOUBLE, BYTES = T.LongType(), T.DoubleType(), _struct(rows=T.BinaryType())


def _pack(frame: pd.DataFrame, fields: T.StructType) -> tuple[bytes]:
    """Rows as one value of the state: an Arrow batch."""
    batch = pa.RecordBatch.from_pandas(frame[fields.names], to_arrow_schema(fields), preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return (out.getvalue().to_pybytes(),)


def _unpack(values: Sequence[tuple]) -> pd.DataFrame:
    return pa.concat_tables([pa.ipc.open_stream(bytes(v[0])).read_all() for v in values]).to_pandas(integer_object_nulls=True)


class OrderedProcessor(StatefulProcessor):
    """Keeps rows back until complete; ``take`` gets them sorted by time, arrival.

    ``fields`` are the columns kept of a row, the event time as microseconds
    under ``us``. A row is complete once the watermark has reached it, or has
    passed its whole millisecond if ``take`` needs those together. Every
    micro-batch adds one value of Arrow rows for each day of event time it
    holds and touches none of the earlier ones; days are taken one by one, so
    memory holds one day of one series however long the backlog. One timer per
    series stands at its earliest waiting row or, if ``forget_us`` is given and
    nothing waits, that long after its last one: then the series' state goes.
    """

    fields: T.StructType
    order: Sequence[str] = ("us", "seq")
    whole_ms = False
    forget_us: int | None = None

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _struct(piece=LONG, part=LONG), BYTES)
        # When the timer stands, how many parts were added, and the last time taken.
        self.mark = handle.getValueState("mark", _struct(alarm=LONG, parts=LONG, seen=LONG))

    def _marked(self) -> tuple[int | None, int, int | None]:
        return tuple(self.mark.get()) if self.mark.exists() else (None, 0, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        kept = []
        for frame in rows:
            frame = self.keep(frame.assign(us=frame["ts"].astype("datetime64[us]").astype("int64")))
            if len(frame):
                kept.append(frame)
        if kept:
            frame = pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
            alarm, parts, seen = self._marked()
            for piece, part in frame.groupby(frame["us"] // (PIECE_MS * 1000)):
                parts += 1
                self.waiting.updateValue((int(piece), parts), _pack(part, self.fields))
            self.wake(self.due(frame["us"].min()), alarm, parts, seen)
        return iter(())

    def due(self, us: int) -> int:
        """Watermark (ms) at which a row is complete."""
        return int(us) // 1000 + 1 if self.whole_ms else -(-int(us) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        _, parts, seen = self._marked()
        self.load(key)
        earliest = None
        for piece, keys in groupby(sorted(tuple(k) for k in self.waiting.keys()), key=lambda k: k[0]):
            first = piece * PIECE_MS
            if first <= now:
                keys = list(keys)
                rows = _unpack([self.waiting.getValue(k) for k in keys])
                ready = rows["us"] <= (now * 1000 - 1 if self.whole_ms else now * 1000)
                later = rows[~ready]
                if ready.any():
                    for k in keys:
                        self.waiting.removeKey(k)
                    if len(later):
                        self.waiting.updateValue(keys[0], _pack(later, self.fields))
                    complete = rows[ready].sort_values(list(self.order), kind="stable", ignore_index=True)
                    seen = int(complete["us"].iloc[-1])
                    out = self.take(complete)
                    if len(out):
                        yield self.named(key, out)
                if not len(later):
                    continue
                first = self.due(later["us"].min())
            earliest = first if earliest is None else min(earliest, first)
        silent = None if self.forget_us is None or seen is None else (seen + self.forget_us) // 1000 + 1
        if silent is not None and now >= silent:
            self.forget()
            seen = silent = None
        else:
            self.store()
        times = [t for t in (earliest, silent) if t is not None]
        if times:
            self.wake(max(min(times), now + 1), None, parts, seen)
        elif seen is None:
            self.mark.clear()
        else:
            self.mark.update((None, parts, seen))

    def named(self, key, out: pd.DataFrame) -> pd.DataFrame:
        for name, part in zip(self.key_names, key):
            out.insert(0, name, part)
        out["ts"] = pd.to_datetime(out.pop("us"), unit="us")
        return out[self.output.names]

    def wake(self, ms: int, alarm: int | None, parts: int, seen: int | None) -> None:
        if alarm is None or alarm > ms:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            self.handle.registerTimer(ms)
            alarm = ms
        self.mark.update((alarm, parts, seen))

    def keep(self, frame: pd.DataFrame) -> pd.DataFrame:
        return frame

    def load(self, key) -> None:
        """Fetch the series' own state before its pieces are taken."""

    def store(self) -> None:
        """Put it back afterwards."""

    def forget(self) -> None:
        """Clear it after a long silence."""

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


def first_per_time(rows: pd.DataFrame, by: Sequence[str] = ("us",)) -> pd.DataFrame:
    return rows.drop_duplicates(list(by), keep="first", ignore_index=True)


class Gate:
    """The rate gate of one series, going on from the reading it held last."""

    def __init__(self, max_rate: float, reset_us: int | None, last: tuple | None) -> None:
        self.max_rate, self.reset_us, self.last = max_rate, reset_us, last

    def fold(self, us: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gated values, and which readings were rejected."""
        before = 0
        if self.last is not None:
            us, v, before = np.r_[self.last[0], us], np.r_[self.last[1], v], 1
        stands = fold_gate(us, v, self.max_rate, self.reset_us)
        known = np.flatnonzero(~np.isnan(v))
        if len(known):
            end = stands[known[-1]]
            self.last = (int(us[end]), float(v[end]))
        return v[stands][before:], (stands != np.arange(len(us)))[before:]


class GateProcessor(OrderedProcessor):
    """De-duplicates by time and applies the rate gate to the gated sides."""

    fields = _struct(us=LONG, seq=LONG, value=DOUBLE, source=T.StringType(), produced_at=DOUBLE)

    def __init__(self, key_names, output, gated: Sequence[str], max_rate: float, reset_us: int | None):
        self.key_names, self.output = key_names, output
        self.gated, self.max_rate, self.reset_us = tuple(gated), max_rate, reset_us
        self.forget_us = reset_us

    def init(self, handle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", _struct(us=LONG, v=DOUBLE, rejected=LONG))

    def load(self, key) -> None:
        self.open_gate = key[-1] in self.gated
        held = tuple(self.held.get()) if self.open_gate and self.held.exists() else (None, None, 0)
        self.gate = Gate(self.max_rate, self.reset_us, held[:2] if held[0] is not None else None)
        self.rejected = held[2]

    def store(self) -> None:
        if self.open_gate and self.gate.last is not None:
            self.held.update((*self.gate.last, self.rejected))

    def forget(self) -> None:
        self.held.clear()

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = first_per_time(rows)
        if not self.open_gate:
            return rows.assign(rejected=False, n_rejected=0)
        gated, rejected = self.gate.fold(rows["us"].to_numpy("int64"), rows["value"].to_numpy("float64"))
        counts = self.rejected + rejected.cumsum()
        self.rejected = int(counts[-1])
        return rows.assign(value=gated, rejected=rejected, n_rejected=counts)


class CorrectionProcessor(OrderedProcessor):
    """Both sides of a site in one state: gates the station and gives each device
    reading the latest station reading not after it, with fallback."""

    order = ("us", "is_device", "seq")
    whole_ms = True
    fields = _struct(us=LONG, seq=LONG, is_device=T.BooleanType(), value=DOUBLE, produced_at=DOUBLE, stage=DOUBLE)

    def __init__(self, key_names, output, device_side: str, tolerance_seconds: float, max_rate: float, forget_us: int | None):
        self.key_names, self.output = key_names, output
        self.device_side, self.tolerance = device_side, float(tolerance_seconds)
        self.max_rate, self.forget_us = max_rate, forget_us

    def init(self, handle) -> None:
        super().init(handle)
        self.station = handle.getValueState(
            "station", _struct(held_us=LONG, held=DOUBLE, us=LONG, v=DOUBLE, produced=DOUBLE, stage=DOUBLE)
        )

    def load(self, key) -> None:
        known = tuple(self.station.get()) if self.station.exists() else None
        self.gate = Gate(self.max_rate, self.forget_us, known[:2] if known and known[0] is not None else None)
        self.last = known[2:] if known else None

    def store(self) -> None:
        if self.last is not None:
            self.station.update((*(self.gate.last or (None, None)), *self.last))

    def forget(self) -> None:
        self.station.clear()

    def keep(self, frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(is_device=frame["side"] == self.device_side)

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = first_per_time(rows, ["is_device", "us"])
        is_device = rows["is_device"].to_numpy(bool)
        device, station = rows[is_device], rows[~is_device]
        gated, _ = self.gate.fold(station["us"].to_numpy("int64"), station["value"].to_numpy("float64"))
        known = [station["us"].to_numpy("int64"), gated, station["produced_at"].to_numpy("float64"), station["stage"].to_numpy("float64")]
        if self.last is not None:
            known = [np.r_[old, new] for old, new in zip(self.last, known, strict=True)]
        if len(known[0]):
            self.last = (int(known[0][-1]), *(float(c[-1]) for c in known[1:]))
        # One row per millisecond, the last arrival stands.
        device = device.assign(ms=device["us"] // 1000).sort_values(["seq", "us"], kind="stable")
        device = device.drop_duplicates("ms", keep="last").sort_values("us", kind="stable")
        at, own = device["us"].to_numpy("int64"), device["value"].to_numpy("float64")
        place = np.searchsorted(known[0], at, side="right") - 1
        hit = np.maximum(place, 0)
        us, v, produced, stage = (c[hit] if len(c) else np.zeros(len(at), c.dtype) for c in known)
        skew = (at - us) / 1e6
        found = place >= 0
        if self.forget_us is not None:
            found &= at - us <= self.forget_us
        used = found & (skew <= self.tolerance)
        return pd.DataFrame(
            {
                "us": at,
                "temperature": own,
                "suggested_temperature": np.where(used, v, own),
                "produced_at": device["produced_at"].to_numpy("float64"),
                "produced_at_meteo": np.where(used, produced, 0.0),
                "time_difference": np.where(found, skew, 0.0),
                "meteo_stage": np.where(found, stage, 0.0),
                "meteo_used": used,
            }
        )


class ExactJoinProcessor(OrderedProcessor):
    """Pairs rows of two sides that have the same time, the first arrival of each.

    Both sides wait in one state under one watermark, so a side that is idle
    holds nothing back; rows without a partner go when the watermark has
    reached them.
    """

    order = ("us", "seq")

    def __init__(self, key_names, output, fields: T.StructType, left: Sequence[str], right: Sequence[str]):
        self.key_names, self.output, self.fields = key_names, output, fields
        self.left, self.right = list(left), list(right)

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        once = first_per_time(rows, ["is_left", "us"])
        is_left = once["is_left"].to_numpy(bool)
        return once[is_left][["us", *self.left]].merge(once[~is_left][["us", *self.right]], on="us")


class FeatureProcessor(OrderedProcessor):
    """Channel features of base rows; see ``fused_features`` for their meaning."""

    fields = _struct(us=LONG, seq=LONG, channel=T.StringType(), value=DOUBLE, produced_at=DOUBLE)
    _READING = _struct(us=LONG, seq=LONG, channel=T.StringType(), v=DOUBLE)

    def __init__(self, key_names, output, features, pumps, window_us: int, forget_us: int | None = None):
        self.key_names, self.output = key_names, output
        # Plain tuples travel to the workers.
        self.features = [(f.quantity, f.stat, f.carry_forward) for f in features]
        self.pumps, self.width, self.forget_us = list(pumps), window_us, forget_us

    def init(self, handle) -> None:
        super().init(handle)
        self.recent = handle.getValueState("recent", BYTES)

    def load(self, key) -> None:
        known = self.recent.exists()
        self.old = _unpack([self.recent.get()]) if known else pd.DataFrame(columns=self._READING.names)

    def store(self) -> None:
        if len(self.old):
            self.recent.update(_pack(self.old, self._READING))

    def forget(self) -> None:
        self.recent.clear()

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        is_base = rows["channel"].isna()
        base = rows[is_base]
        fresh = rows[~is_base].rename(columns={"value": "v"})
        read = fresh[self._READING.names]
        if len(self.old):
            read = pd.concat([self.old, read], ignore_index=True)
        read = read.dropna(subset=["v"]).sort_values(["us", "seq", "v"], kind="stable", ignore_index=True)
        at = base["us"].to_numpy("int64")
        made: dict[str, np.ndarray] = {}
        groups = {c: g for c, g in read.groupby("channel", sort=False)}
        for quantity, stat, carry in self.features:
            for pump in self.pumps:
                channel = f"{quantity}_tc{pump}"
                mine = groups.get(channel)
                us = mine["us"].to_numpy("int64") if mine is not None else np.zeros(0, "int64")
                v = mine["v"].to_numpy("float64") if mine is not None else np.zeros(0)
                made.update(self._channel(channel, stat, carry, at, us, v))
        # Keep what later windows reach, and the last reading of each channel.
        horizon = int(rows["us"].max()) - self.width
        last = ~read.duplicated("channel", keep="last")
        if self.forget_us is not None:
            last &= read["us"] >= int(rows["us"].max()) - self.forget_us
        self.old = read[(read["us"] >= horizon) | last]
        out = {"us": at, "seq": base["seq"].to_numpy("int64"), "temperature": base["value"].to_numpy("float64")}
        return pd.DataFrame({**out, "produced_at": base["produced_at"].to_numpy("float64"), **made})

    def _channel(self, channel, stat, carry, at, us, v) -> dict[str, np.ndarray]:
        low = np.searchsorted(us, at - self.width, side="left")
        high = np.searchsorted(us, at, side="right")
        n = high - low
        us, v = np.r_[us, 0], np.r_[v, 0.0]
        known = high > 0
        if self.forget_us is not None:
            known &= at - us[high - 1] <= self.forget_us
        seen = np.where(known, v[high - 1], 0.0)
        if stat == "latest":
            return {channel: seen}
        if stat == "mean":
            bounds = np.column_stack([low, high]).ravel()
            sums = np.add.reduceat(v, bounds)[::2] if len(bounds) else np.zeros(0)
            return {channel: np.where(n > 0, sums / np.maximum(n, 1), 0.0)}
        first, last = np.where(n > 0, low, 0), np.where(n > 0, high - 1, 0)
        seconds = (us[last] - us[first]) / 1e6
        known = (n > 1) & (seconds > 0)
        rate = np.where(known, (v[last] - v[first]) / np.where(known, seconds, 1.0), 0.0)
        fallback = seen if carry else np.zeros(len(at))
        return {
            f"{channel}_rate": rate,
            f"{channel}_value": np.where(known, v[first], fallback),
            f"{channel}_n": n.astype("int64"),
        }
