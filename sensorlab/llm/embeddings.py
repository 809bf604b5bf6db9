"""Near-duplicate embeddings: tiles of vectors compared in the order of principal components.

Vectors are scaled to unit length and turned to the principal axes of all
vectors (second moments are summed by Spark; only dimension x dimension numbers
reach the driver). Equal vectors of one label are one class with a weight.
Classes are dealt into blocks along the first axis, and two blocks of a label
meet in a tile only if they lie close enough there. A tile multiplies some
leading dimensions at a time; by Cauchy-Schwarz the rest of a product is at
most the product of the suffix norms, so pairs, and whole tiles, stop as soon
as that bound cannot reach the threshold. What is left is computed anew from
the given components in double precision.

A tile returns, for each class, its number of links and the root of its
component within the tile: a row per class, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlab.llm.common import components, map_arrow, runs, small_batches, stored

BLOCK = 1_000
BINS = 4_096
STEP = 16
SPARSE = 0.02


def _cleaned(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Double components as bytes, null for vectors that link with nothing."""
    out = []
    for vector in batch.column("_vector"):
        values = vector.as_py()
        ok = bool(values) and None not in values
        x = np.array(values, np.float64) if ok else np.empty(0)
        top = np.abs(x).max(initial=0.0)
        if 0 < top < np.inf and not 1e-140 < top < 1e140:
            x = np.ldexp(x, -int(np.frexp(top)[1]))  # squares must neither overflow nor vanish; this is exact
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((x * x).sum())
        out.append((x + 0.0).tobytes() if ok and np.isfinite(x).all() and np.isfinite(norm) and norm > 0 else None)
    return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(out, pa.binary())], ["_id", "_label", "_x"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes by falling second moment for each number of dimensions; columns are axes."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column("_x").to_pylist()
            for d in {len(r) // 8 for r in rows}:
                x = _unit(np.frombuffer(b"".join(r for r in rows if len(r) == 8 * d), np.float64).reshape(-1, d))
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(np.arange(d * d)), pa.array(m.ravel())], ["d", "at", "m"])

    found = vectors.select("_x").mapInArrow(moments, "d long, at long, m double").groupBy("d", "at").agg(F.sum("m").alias("m")).toPandas()
    axes = {}
    for d, part in found.groupby("d"):
        m = np.zeros(d * d)
        m[part["at"].to_numpy()] = part["m"].to_numpy()
        values, vectors_ = np.linalg.eigh(m.reshape(d, d))
        axes[int(d)] = vectors_[:, np.argsort(-values)]
    return axes


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y whose cosine is at least `least`."""
    a, b = _unit(x) @ axes, _unit(y) @ axes
    d = a.shape[1]
    ra, rb = (np.sqrt(np.maximum(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1], 0)) for m in (a, b))
    product, slack = np.zeros((len(a), len(b))), 1e-9
    i = j = None
    for k in range(0, d, STEP):
        end = min(k + STEP, d)
        product += a[:, k:end] @ b[:, k:end].T
        rest = ra[:, end][:, None] * rb[:, end][None, :] if end < d else 0.0
        i, j = np.nonzero(product + rest >= least - slack)
        if len(i) <= SPARSE * product.size or end == d:
            break
    if not len(i):
        return i, j
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 100_000):
        p, q = x[i[s : s + 100_000]], y[j[s : s + 100_000]]
        keep[s : s + 100_000] = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) >= least
    return i[keep], j[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93
) -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``.

    Vectors of the same label, not null, and the same number of dimensions are
    linked if their cosine is at least `least`. Null or zero vectors and those
    with a null or non-finite component have no links. Several rows of one id
    are one vector, the least of them; rows with a null id give one row each,
    with no links and no component, and are kept.
    """
    spark = small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_vector"))
    label_type = rows.schema["_label"].dataType.simpleString()
    single = rows.filter("_id is not null").groupBy("_id").agg(F.min(F.struct("_label", "_vector")).alias("r")).select("_id", "r.*")
    clean = stored(map_arrow(single, _cleaned, f"_id long, _label {label_type}, _x binary"), "vectors")
    usable = clean.filter("_label is not null and _x is not null")
    classes = usable.groupBy("_label", "_x").agg(F.min("_id").alias("_class"), F.count("*").alias("_copies"))
    classes = stored(classes, "classes")
    axes = principal_axes(classes)

    def leading(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows_ = batch.column("_x").to_pylist()
        first = np.array([float((x := np.frombuffer(r, np.float64)) @ axes[len(x)][:, 0] / np.sqrt((x * x).sum())) for r in rows_])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], [*batch.schema.names, "_lead"])

    placed = map_arrow(classes, leading, f"_label {label_type}, _x binary, _class long, _copies long, _lead double")
    group = ["_label", "_d"]
    placed = placed.withColumn("_d", F.octet_length("_x")).withColumn("_bin", F.floor((F.col("_lead") + 1.001) / 2.002 * BINS))
    placed = stored(placed, "placed")
    # Blocks of BLOCK classes along the first axis; a crowded bin is dealt to several.
    bins = placed.groupBy(*group, "_bin").agg(F.count("*").alias("_m"))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    number = F.floor((F.col("_before") + F.pmod(F.xxhash64("_class"), "_m")) / BLOCK)
    placed = stored(placed.join(bins, [*group, "_bin"]).withColumn("_block", number).drop("_bin", "_m", "_before"), "blocks")
    blocks = placed.groupBy(*group, "_block").agg(F.min("_lead").alias("_low"), F.max("_lead").alias("_high"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6)
    other = blocks.select(*group, *(F.col(c).alias(c + "2") for c in ("_block", "_low", "_high")))
    pairs = blocks.join(other, group).filter(
        (F.col("_block") <= F.col("_block2")) & (F.col("_low2") - F.col("_high") <= reach) & (F.col("_low") - F.col("_high2") <= reach)
    )
    ends = pairs.select(*group, F.col("_block"), F.col("_block").alias("_b1"), F.col("_block2").alias("_b2"))
    ends = ends.union(pairs.filter("_block < _block2").select(*group, "_block2", "_block", "_block2"))
    keys = [*group, "_b1", "_b2", "_block"]
    tiles = placed.join(ends, [*group, "_block"]).repartition(*group, "_b1", "_b2").sortWithinPartitions(*keys, "_class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, [*group, "_b1", "_b2"]):
            block, b1 = tile["_block"].to_numpy(), tile["_b1"][0].as_py()
            ids, copies, x = tile["_class"].to_numpy(), tile["_copies"].to_numpy(), _matrix(tile["_x"])
            left = np.flatnonzero(block == b1)
            right = left if tile["_b2"][0].as_py() == b1 else np.flatnonzero(block != b1)
            i, j = linked_pairs(x[left], x[right], axes[x.shape[1]], least)
            i, j = left[i], right[j]
            other_ = i != j
            i, j = i[other_], j[other_]
            links = np.bincount(i, copies[j], len(ids))
            if right is not left:
                links += np.bincount(j, copies[i], len(ids))
            root = _roots(len(ids), i, j)
            own = links > 0
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]]), pa.array(links[own].astype(np.int64))], ["a", "b", "n"])

    found = stored(tiles.select(*keys, "_class", "_copies", "_x").mapInArrow(compare, "a long, b long, n long"), "links")
    joined = components(found.select("a", "b")).toDF("_class", "_component")
    links = found.groupBy("a").agg(F.sum("n").alias("_n")).withColumnRenamed("a", "_class")
    summary = classes.join(joined, "_class", "left").join(links, "_class", "left").select(
        "_label", "_x", (F.coalesce("_n", F.lit(0)) + F.col("_copies") - 1).alias("_n"), F.coalesce("_component", "_class").alias("_component")
    )
    linked = usable.join(summary, ["_label", "_x"]).select("_id", "_n", "_component")
    out = clean.select("_id").join(linked, "_id", "left").select(
        F.col("_id").alias(id_col), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_component", "_id").alias("component_id"), (F.coalesce("_component", "_id") == F.col("_id")).alias("kept"),
    )
    none = rows.filter("_id is null").select(F.col("_id").alias(id_col), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(True))
    return out.union(none)
