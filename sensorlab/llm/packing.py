"""Mixture-controlled packing of documents into fixed windows of tokens.

Every source is a queue of its documents. Deficit round-robin serves the queues
in units: a document, or, of one longer than a window, a stretch as long as a
window. A queue earns its share of every token served and pays with its units;
its deficit is what it has earned and not been served. The unit whose queue has
earned half of it first comes next, so that a queue is ahead or behind by half
a unit, and what it couldn't be served it carries on to the next window. A
queue of share w has earned its token b when b / w tokens are served in all:
that is the turn of the unit with b in its middle, known without any other
queue, and sorting by turns is the whole schedule. A queue that is empty drops out and the others fill its
place.

Units are range-sharded by their turns; the sums of the shards before it tell
each where its first window stands, so windows and deficits cross shards. In a
shard units are laid into windows one after another. One that would cross the
end of a window waits while later units of the next LOOK fill the rest, at
best a stretch of a long document, which is cut anyway; only if there is none
it is cut itself. No token is left out; only the last window has padding.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlab.llm.common import small_batches, stored
from sensorlab.llm.tokens import encoder

WINDOW = 1024
LOOK = 64
#: Share of a source that the mixture leaves nothing for: it comes last.
NOTHING = 1e-9


def schedule(units: Iterable[tuple], place: int, window: int) -> Iterator[tuple]:
    """Pieces ``key, start, length, place`` of ``key, start, length, may be cut`` units, laid from `place` on."""
    waiting: deque[list] = deque()
    units = iter(units)
    more = True
    while True:
        while more and len(waiting) < LOOK:
            unit = next(units, None)
            more = unit is not None
            if more:
                waiting.append(list(unit))
        if not waiting:
            return
        room = window - place % window
        # The first that fits or may be cut, else the first of all.
        pick = next((i for i, u in enumerate(waiting) if u[2] <= room or u[3]), 0)
        key, start, n, _ = unit = waiting[pick]
        size = min(n, room)
        yield key, start, size, place
        place += size
        if size == n:
            del waiting[pick]
        else:
            unit[1], unit[2] = start + size, n - size


def pack(
    docs: DataFrame, tokenizer: str, mixture: dict[str, float] | None = None, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", end_id: int = 0, window: int = WINDOW,
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids, doc_tokens, sequence_id, offset``.

    `ids` are the piece's token ids, little-endian unsigned 32-bit numbers;
    `start` counts the document's ids before it. A document's ids are those of
    its text (null: none) and `end_id`. `mixture` gives target shares of
    sources; sources that it doesn't name share what is left of 1 by their
    tokens. Without it every source has its share of all tokens. A null source
    is a source of its own; repeated rows are packed each.
    """
    spark = small_batches(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, coder, served, number = TaskContext.get().partitionId(), encoder(tokenizer), {}, 0
        for batch in batches:
            ids, ends = coder.encode_all(batch.column("_text"))
            n = np.diff(ends, prepend=0) + 1
            ids = np.insert(ids, ends, end_id)
            before = np.empty(len(n), np.int64)
            for i, (source, size) in enumerate(zip(batch.column("_source").to_pylist(), n.tolist(), strict=True)):
                before[i] = served.get(source, 0)
                served[source] = before[i] + size
            wide = ids.max(initial=0) > 0xFFFF
            packed = ids.astype("<u4" if wide else "<u2")
            offsets = pa.array((np.concatenate([[0], np.cumsum(n)]) * packed.itemsize).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), batch.column("_source"), pa.array(np.full(len(n), block)), pa.array(np.arange(number, number + len(n))),
                    pa.array(before), pa.array(n), pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(packed.tobytes())]),
                ],
                ["_id", "_source", "_block", "_number", "_before", "_n", "_ids"],
            )
            number += len(n)

    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), source.alias("_source"), F.col(text_col).alias("_text"))
    kinds = "_id long, _source string, _block long, _number long, _before long, _n long, _ids binary"
    rows = stored(texts.mapInArrow(encoded, kinds), "ids")

    # Where each block of a source begins in its queue, and the turn of every unit.
    parts = rows.groupBy("_source", "_block").agg(F.sum("_n").alias("_sum"))
    ahead = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select("_source", "_block", "_sum", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base")), "parts")
    queues = stored(parts.groupBy("_source").agg(F.sum("_sum").alias("_total")), "queues")
    queues = queues.select("_source", _share(queues, mixture).alias("_share"))
    units = rows.select("_source", "_block", "_number", "_before", "_n").join(parts, ["_source", "_block"]).join(queues, "_source")
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(window).cast("long")))
    units = units.withColumn("_start", step).select(
        "_source", "_block", "_number", "_start", F.least(F.col("_n") - F.col("_start"), F.lit(window)).alias("_size"),
        (F.col("_n") > window).alias("_long"), (F.col("_base") + F.col("_before") + F.col("_start")).alias("_at"), "_share",
    )
    units = units.withColumn("_turn", (F.col("_at") + F.col("_size") / 2) / F.col("_share")).drop("_at", "_share")
    order = ["_turn", "_source", "_block", "_number", "_start"]
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = units.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("_shard", F.spark_partition_id())
    sorted_ = stored(sorted_.select("_shard", *order, "_size", "_long"), "units")
    sums = sorted_.groupBy("_shard").agg(F.sum("_size").alias("_sum"))
    bases = sums.select("_shard", F.coalesce(F.sum("_sum").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    # One row a shard.
    ready = sorted_.join(F.broadcast(bases), "_shard").repartition(shards, "_shard").sortWithinPartitions("_shard", *order)

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard_units():
            names = ("_shard", "_first", "_block", "_number", "_start", "_size", "_long")
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

        def pieces():
            held = _Peek(shard_units())
            while held.top is not None:
                shard, first = held.top[:2]
                run = ((u[2:4], *u[4:]) for u in held.while_(lambda u, shard=shard: u[0] == shard))
                yield from schedule(run, first, window)

        out: list[tuple] = []
        for (block, number), start, size, place in pieces():
            out.append((block, number, start, size, place))
            if len(out) >= 20_000:
                yield _columns(out)
                out = []
        if out:
            yield _columns(out)

    pieces = ready.mapInArrow(laid, "_block long, _number long, _start long, _size long, _place long")
    pieces = pieces.groupBy("_block", "_number").agg(F.array_sort(F.collect_list(F.struct("_start", "_size", "_place"))).alias("_pieces"))
    both = rows.select("_id", "_block", "_number", "_n", "_ids").join(pieces, ["_block", "_number"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("_n").to_numpy()
            if not len(n):
                continue
            lists = batch.column("_pieces")
            doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            start, length, place = (c.to_numpy() for c in lists.flatten().flatten())
            # Neighbours in both the document and the window are one piece.
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + length[:-1]) | (place[1:] % window == 0)
            first = np.flatnonzero(fresh)
            doc, start, place, length = doc[first], start[first], place[first], np.add.reduceat(length, first)
            wide = _wide(batch.column("_ids"), n)
            # Pieces come in the order of documents and starts, so they cut the ids gaplessly.
            bounds = pa.array((np.concatenate([[0], np.cumsum(length)]) * 4).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array(doc)), pa.array(start), pa.array(length),
                    pa.Array.from_buffers(pa.binary(), len(doc), [None, bounds.buffers()[1], pa.py_buffer(wide.tobytes())]),
                    pa.array(n[doc]), pa.array(place // window), pa.array(place % window),
                ],
                [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    schema = f"`{id_col}` long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return both.select("_id", "_n", "_ids", "_pieces").mapInArrow(cut, schema)


def _share(queues: DataFrame, mixture: dict[str, float] | None) -> Column:
    """A queue's share of all tokens: its own, or the mixture's."""
    if not mixture:
        return F.lit(1.0) * F.col("_total") / F.greatest(F.lit(queues.agg(F.sum("_total")).first()[0] or 1), F.lit(1))
    named = F.col("_source").isin([f"={s}" for s in mixture])
    others = queues.filter(~named).agg(F.sum("_total")).first()[0] or 1
    share = F.lit(max(0.0, 1 - sum(mixture.values()))) * F.col("_total") / others
    for name, part in mixture.items():
        share = F.when(F.col("_source") == f"={name}", F.lit(float(part))).otherwise(share)
    return F.greatest(share, F.lit(NOTHING))


class _Peek:
    """An iterator whose next item can be seen."""

    def __init__(self, items: Iterator) -> None:
        self.items, self.top = items, next(items, None)

    def while_(self, wanted) -> Iterator:
        while self.top is not None and wanted(self.top):
            item, self.top = self.top, next(self.items, None)
            yield item


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    names = ["_block", "_number", "_start", "_size", "_place"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def _wide(ids: pa.Array, n: np.ndarray) -> np.ndarray:
    """The 32-bit ids of all documents; stored ones have two bytes where that is enough."""
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(n) + 1].astype(np.int64)
    raw = np.frombuffer(ids.buffers()[2], np.uint8)
    narrow = np.diff(offsets) == 2 * n
    if narrow.all():
        return np.frombuffer(raw[offsets[0] : offsets[-1]].tobytes(), "<u2").astype("<u4")
    wide = np.empty(n.sum(), "<u4")
    first = np.cumsum(n) - n
    for i in range(len(n)):
        wide[first[i] : first[i] + n[i]] = np.frombuffer(raw[offsets[i] : offsets[i + 1]].tobytes(), "<u2" if narrow[i] else "<u4")
    return wide
