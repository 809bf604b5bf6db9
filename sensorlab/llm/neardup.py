"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity.

1. Every document becomes the set of its word shingles. Documents with equal
   sets (equal 128-bit digests of the whole set) are copies; the one with the
   smallest id stands for them.
2. Circulant MinHash: one permutation of the 32-bit numbers spreads the
   shingles, a second one, shifted by k, gives coordinate k of the signature.
   Bands of ROWS coordinates are hashed; there are enough bands that a pair at
   the threshold is missed with a probability below MISS.
3. Documents that share a band share a bucket. Each document goes with the
   smallest id of all its buckets. Such a family is cut into blocks of bounded
   size, and every block is compared within itself in one go: exact
   intersections are a product of 0/1 matrices. Only a spanning forest of the
   links leaves the task. Blocks of one family share a few pivot documents.
4. Buckets that still hold several components are compared whole, block against
   block, but for blocks that lie within one component. Of buckets with the
   same members one is enough.

No step needs all members of a bucket or family in one task, and no pairs are
written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import components, list_array, map_arrow, maybe_in, run_firsts, runs, small_batches, stored
from sensorlab.llm.words import distinct_sorted, mix64, shingle_hashes, word_hashes

ROWS = 6
MISS = 1e-5
BLOCK_SHINGLES = 400_000
PER_DOCUMENT = 1_000
PIVOTS = 32
COLUMNS = 4_096
NO_POOL = -(2**63)


def bands_for(percent: int) -> int:
    """The least number of bands that misses a pair at the threshold with probability below MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def circulant_minhash(values: np.ndarray, ends: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of `coordinates` minima for each set that isn't empty."""
    starts = np.concatenate([[0], ends])[:-1]
    starts = starts[starts < ends]
    spread = (mix64(values) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), coordinates), np.uint32)
    for k in range(coordinates):
        x = spread - np.uint32(k)
        x *= np.uint32(0x85EBCA6B)  # fixed values: odd multipliers of a common 32-bit finaliser
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(13)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _signatures(batch: pa.RecordBatch, size: int, bands: int) -> pa.RecordBatch:
    sets, ends = distinct_sorted(*shingle_hashes(*word_hashes(batch.column("_text")), size))
    n = np.diff(ends, prepend=0)
    full = n > 0
    starts = np.concatenate([[0], ends])[:-1][full]
    digests = np.zeros((2, len(n)), np.uint64)
    keys = np.empty((0, bands), np.uint64)
    if full.any():
        for k, seed in enumerate((0x5BD1E995, 0x1B873593)):
            digests[k, full] = np.add.reduceat(mix64(sets ^ np.uint64(seed)), starts)
        minima = circulant_minhash(sets, ends, bands * ROWS).astype(np.uint64)
        keys = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(minima), axis=0)
        for r in range(ROWS):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("_id"),
            pa.array(n),
            pa.array(digests[0].view(np.int64)),
            pa.array(digests[1].view(np.int64)),
            list_array(keys.view(np.int64).ravel(), np.cumsum(full * bands)),
        ],
        ["_id", "_n", "_d1", "_d2", "_bands"],
    )


def linked_roots(sets: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    """For each set, the first set that it reaches by links; links are exact."""
    n = len(ends)
    sizes = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(sets, kind="stable")
    values, owner = sets[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(column) else fresh
    column, owner = column[shared], owner[shared]
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((n, n), np.float64)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + COLUMNS + 1, COLUMNS))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[a:b], column[a:b] % COLUMNS] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = (100 * common >= percent * union) & (union > 0)
    np.fill_diagonal(linked, True)
    root = np.arange(n)
    while True:
        low = np.where(linked, root[None, :], n).min(axis=1)
        if (low == root).all():
            return root
        root = low


def _bucket_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with two or more documents, from rows sorted by ``_key, _id``, with the smallest id."""
    last, waiting = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            last, waiting = None, None
        key, ids = batch.column("_key").to_numpy(), batch.column("_id").to_numpy()
        fresh, first = run_firsts(key, ids, last)
        keep = ~fresh
        keep[:-1] |= ~fresh[1:]
        if fresh[-1]:  # its bucket may go on in the next batch
            waiting = batch.slice(batch.num_rows - 1)
            keep[-1] = False
        last = (key[-1], first[-1])
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns), pa.array(first).filter(keep)], ["_key", "_id", "_n", "_hub"])


def _compared(tiles: DataFrame, docs: DataFrame, keys: list[str], size: int, percent: int) -> DataFrame:
    """Edges ``a, b`` of a spanning forest of the links within each tile (rows ``keys, _id``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, keys):
            ids = tile.column("_id").combine_chunks().to_numpy()
            ids, first = np.unique(ids, return_index=True)
            texts = tile.column("_text").combine_chunks().take(pa.array(first))
            sets, ends = distinct_sorted(*shingle_hashes(*word_hashes(texts), size))
            root = linked_roots(sets, ends, percent)
            own = root != np.arange(len(root))
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])

    small_batches(docs.sparkSession)
    tiles = stored(tiles, "tiles")
    rows = maybe_in(docs, "_id", tiles.select("_id")).join(tiles, "_id").repartition(*keys).sortWithinPartitions(*keys, "_id")
    return rows.select(*keys, "_id", "_text").mapInArrow(run, "a long, b long")


def _blocks(n: Column, weight: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil((weight + n * PER_DOCUMENT) / BLOCK_SHINGLES)).cast("int")


def _deal(blocks: str, seed: int) -> Column:
    return F.expr(f"pmod(xxhash64(_id, {seed}), {blocks})").cast("int")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept``.

    Documents are linked if 100 * intersection >= percent * union of their sets
    of `size`-word shingles; a component's id is the smallest id in it, and that
    document is kept. A text with fewer words is one shingle; an empty or null
    text has none and is linked with nothing. Rows with a null id take no part
    and are kept, with a null component. Rows with the same id are the same
    document, of which the row with the most shingles counts.
    """
    bands = bands_for(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sketch = stored(
        map_arrow(
            texts,
            lambda batch: _signatures(batch, size, bands),
            "_id long, _n long, _d1 long, _d2 long, _bands array<long>",
        ),
        "signatures",
    )
    ids = sketch.filter("_id is not null and _n > 0")
    digest = ["_n", "_d1", "_d2"]
    copies = ids.select("_id", *digest).join(ids.groupBy(*digest).agg(F.min("_id").alias("_rep")), digest)
    copies = stored(copies.select("_id", "_n", "_rep"), "copies")

    first = copies.filter("_id = _rep").select("_id", "_n").distinct()
    keys = ids.join(first, ["_id", "_n"], "left_semi").select(F.explode("_bands").alias("_key"), "_id", "_n")
    keys = keys.repartition("_key").sortWithinPartitions("_key", "_id")
    members = stored(keys.mapInArrow(_bucket_members, "_key long, _id long, _n long, _hub long"), "buckets")
    placed = members.groupBy("_id").agg(F.max("_n").alias("_n"), F.min("_hub").alias("_family"))
    total = placed.groupBy("_family").agg(_blocks(F.count("*"), F.sum("_n")).alias("_blocks"), F.count("*").alias("_size"))
    placed = placed.join(total, "_family")

    pivot = F.expr(f"_blocks > 1 and pmod(xxhash64(_id, 1), cast(ceil(_size / {PIVOTS}) as int)) = 0")
    everywhere = F.sequence(F.lit(0), F.col("_blocks") - 1)
    tiles = placed.select("_id", "_family", F.explode(F.when(pivot, everywhere).otherwise(F.array(_deal("_blocks", 0)))).alias("_block"))
    known = texts.filter("_id is not null")
    state = components(_compared(tiles, known, ["_family", "_block"], size, percent)).toDF("_id", "_component")
    state = stored(state, "components")
    near = state.select(F.col("_id").alias("a"), F.col("_component").alias("b"))
    joined = components(near.union(_across(members, state, known, size, percent))).toDF("_rep", "_component")

    rows = copies.join(joined, "_rep", "left").groupBy("_id").agg(F.min(F.coalesce("_component", "_rep")).alias("_component"))
    rows = sketch.filter("_id is not null").groupBy("_id").agg(F.max("_n").alias("_n")).join(rows, "_id", "left")
    component = F.coalesce("_component", "_id")
    found = rows.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), (component == F.col("_id")).alias("kept"))
    return found.union(
        sketch.filter("_id is null").select(F.col("_id"), F.col("_n"), F.lit(None).cast("long"), F.lit(True))
    )


def _across(members: DataFrame, state: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the components that a bucket still has."""
    rows = members.select("_key", "_id", "_n").join(state, "_id", "left")
    rows = rows.withColumn("_component", F.coalesce("_component", "_id"))
    mixed = rows.groupBy("_key").agg(
        F.min("_component").alias("_c1"), F.max("_component").alias("_c2"), F.count("*").alias("_m"),
        F.sum(F.xxhash64("_id").cast("decimal(38,0)")).alias("_all"),
    ).filter("_c1 < _c2")
    mixed = mixed.groupBy("_m", "_all").agg(F.min("_key").alias("_key"))
    rows = stored(rows.join(mixed.select("_key"), "_key", "left_semi"), "mixed")
    # Components that fill a block get blocks of their own; the others share blocks.
    part = rows.groupBy("_key", "_component").agg(F.count("*").alias("_size"), F.sum("_n").alias("_sum"))
    own = F.expr(f"_sum + _size * {PER_DOCUMENT} >= {BLOCK_SHINGLES // 2}")
    part = part.withColumn("_pool", F.when(own, F.col("_component")).otherwise(F.lit(NO_POOL)))
    pools = part.groupBy("_key", "_pool").agg(_blocks(2 * F.sum("_size"), 2 * F.sum("_sum")).alias("_blocks"))
    part = part.select("_key", "_component", "_pool").join(pools, ["_key", "_pool"])
    rows = rows.join(part, ["_key", "_component"]).select("_id", "_key", "_pool", _deal("_blocks", 2).alias("_block"), "_blocks")
    rows = stored(rows, "mixed")
    blocks = rows.select("_key", "_pool", "_block").distinct()
    pairs = blocks.toDF("_key", "_p1", "_b1").join(blocks.toDF("_key", "_p2", "_b2"), "_key")
    pairs = pairs.filter(f"struct(_p1, _b1) <= struct(_p2, _b2) and (_p1 <> _p2 or _p1 = {NO_POOL})")
    tile = F.xxhash64("_p1", "_b1", "_p2", "_b2").alias("_tile")
    ends = pairs.select("_key", F.col("_p1").alias("_pool"), F.col("_b1").alias("_block"), tile).union(
        pairs.select("_key", F.col("_p2"), F.col("_b2"), tile)
    )
    tiles = rows.join(ends.distinct(), ["_key", "_pool", "_block"]).select("_id", "_key", "_tile")
    return _compared(tiles, known, ["_key", "_tile"], size, percent)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near-duplicates: of each group the one with the smallest id; rows with a null id stay.

    Of several rows with a kept id one stays.
    """
    kept = near_duplicates(docs, id_col, text_col, size, percent).filter("kept").select(F.col(id_col).alias("_kept"))
    named = docs.filter(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("_kept"), "left_semi")
    return named.dropDuplicates([id_col]).unionByName(docs.filter(F.col(id_col).isNull()))
