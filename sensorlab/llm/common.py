"""Helpers shared by the operators: stored tables, Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlab.session import fresh_folder

BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> SparkSession:
    """Texts may be long: lower the session's rows per Arrow batch to BATCH_ROWS, which bounds a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage, survives lost executors and gives Spark the table's
    true size, by which it decides whether a join can broadcast it. The files
    go when the driver ends, or by `discard`; the write's shuffle files go at
    its end.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = place
    return table


def hash_share(column: Column, wanted: int, total: int) -> Column:
    """Whether a row belongs to about `wanted` of `total`, by the 64-bit hash of a column: as fine as that for any number of rows."""
    if wanted >= total:
        return F.lit(True)
    return F.xxhash64(column) < F.lit(-(2**63) + (wanted << 64) // total)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        table.stored_at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(table.stored_at, True)


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` for a step that needs one batch at a time."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, wanted: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``df``, all columns, whose text is wanted."""
    at = df.columns.index(text_col)
    kept = map_arrow(
        df.toDF(*(f"c{i}" for i in range(len(df.columns)))),
        lambda batch: batch.filter(pa.array(wanted(batch.column(at)))),
        T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)]),
    )
    return kept.toDF(*df.columns)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of neighbouring rows with equal keys, from batches sorted by these keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def list_array(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def run_firsts(key: np.ndarray, value: np.ndarray, last: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and the first value of each row's run; `last` is key and first value of the run before."""
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(fresh)
    first = value[begin][np.cumsum(fresh) - 1]
    if last is not None and key[0] == last[0]:
        end = begin[1] if len(begin) > 1 else len(key)
        first[:end] = last[1]
        fresh[0] = False
    return fresh, first


def _star(batches: Iterator[pa.RecordBatch], large: bool) -> Iterator[pa.RecordBatch]:
    """One step over edges sorted by ``u, v``; the first v of a run is the least neighbour."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        fresh, first = run_firsts(u, v, last)
        last = (u[-1], first[-1])
        low = np.minimum(first, u)
        if large:  # larger neighbours go to the least node known
            keep = v > u
            a, b, moved = v[keep], low[keep], (low != u)[keep]
        else:  # u and its smaller neighbours do
            other = v != first
            a = np.concatenate([v[other], u[fresh]])
            b = np.concatenate([first[other], first[fresh]])
            moved = np.concatenate([np.ones(other.sum(), bool), np.zeros(fresh.sum(), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(moved)], ["a", "b", "moved"])


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every end of the edges ``a, b``: the smallest id reachable.

    Two steps alternate until nothing moves: every node links its larger
    neighbours to the least node it knows, then itself and its smaller ones.
    Each step is one exchange and one pass over sorted edges, so that a node of
    any number of edges needs no memory.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    last = None
    while True:
        moved = 0
        for large in (True, False):
            links = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
            links = (links.union(links.select("v", "u")) if large else links).repartition("u").sortWithinPartitions("u", "v")
            step = links.mapInArrow(lambda batches, large=large: _star(batches, large), "a long, b long, moved boolean")
            links = stored(step, "links")
            if last is not None:
                discard(last)
            last = links
            moved += links.filter("moved").limit(1).count()
        if not moved:
            break
    pairs = links.select("a", "b")
    return pairs.union(pairs.select("b", "b")).distinct().toDF("id", "component")


def maybe_in(df: DataFrame, column: str, ids: DataFrame, bits: int = 23) -> DataFrame:
    """Rows whose `column` may be among the long ids of the one-column ``ids``; the others are certainly not.

    A bit map of fixed size (2^bits bits in at most 2^(bits - 6) rows of 16
    bytes, so that it can always be broadcast) keeps most rows that a following
    join would drop out of its exchange.
    """
    def slot(name: str):
        return F.shiftrightunsigned(F.xxhash64(F.col(name).cast("long"), F.lit(7)), 64 - bits)

    marks = ids.toDF("_i").select(slot("_i").alias("_s")).groupBy(F.shiftright("_s", 6).alias("_word"))
    marks = marks.agg(F.expr("bit_or(shiftleft(1L, cast(_s & 63 as int)))").alias("_marks"))
    slotted = df.withColumn("_slot", slot(column)).withColumn("_word", F.shiftright("_slot", 6))
    kept = slotted.join(F.broadcast(marks), "_word").filter("_marks & shiftleft(1L, cast(_slot & 63 as int)) <> 0")
    return kept.select(*df.columns)
