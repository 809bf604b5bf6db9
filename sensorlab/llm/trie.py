"""Prefix trie of conversations: how often each beginning occurs and what sharing it saves.

Texts stay in the JVM: a turn becomes 16 bytes of the SHA-256 of its role and
text, and a count of words. Conversations, rows of turn ids, are range-sharded
by their ids, so that a shard's rows are neighbours in the trie; copies of one
conversation may spread over shards. In a shard a padded matrix of turn ids is
put in order by numpy's lexsort; columns that differ from the row above,
accumulated by OR from left to right, mark where nodes start at each depth, and
reduceat sums over the marked runs. Matrices are built some columns at a time,
of the rows long enough for them, so that padding stays small.

Only nodes on a shard's first or last row can go on in other shards. Their
counts are sent off in parts under a digest of their path and added up; what
both neighbours counted twice at a rim is taken off. Ids that end in a node are
hashed in rising order, streamed from shard to shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlab.llm.common import stored

ID_BYTES = 16
COLUMNS = 64
SHARD_TURNS = 200_000
NO_IDS = hashlib.sha256().hexdigest()
#: Sides of a shard at which a node may go on.
INNER, FIRST, LAST, RIM = 0, 1, 2, 3

_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_PART = f"{_NODE}, ends_sha256 string, parent_conv_id long, shard long, side int, parent_side int, path binary, ids string, last_ids binary, words array<int>"
_MERGED = f"path binary, {_NODE}, ends_sha256 string"


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that equal turns share."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID_BYTES))


def turn_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def turn_lists(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turns``: the turns of every conversation in order, each as id and words."""
    slim = turns.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        turn_id(F.col(role_col), F.col(text_col)).alias("id"),
        turn_words(F.col(text_col)).alias("words"),
    ).filter("conv is not null")
    listed = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "id", "words")))
    return slim.groupBy("conv").agg(F.transform(listed, lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(lists: DataFrame, group: int = 20) -> DataFrame:
    """Each conversation begins with up to three turns of the first one of its group of ids.

    Conversation c takes the first h = crc32(c) % 4 turns of c - c % group, then
    its own turns after its first h.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    heads = lists.filter(F.col("conv") % group == 0).select(F.col("conv").alias("_base"), F.slice("turns", 1, 3).alias("_head"))
    own = lists.withColumn("_base", F.col("conv") - F.col("conv") % group).withColumn("_h", h.cast("int"))
    none = F.slice("turns", 1, 0)
    begin = F.slice(F.coalesce("_head", none), 1, F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return own.join(heads, "_base", "left").select("conv", F.concat(begin, rest).alias("turns"))


def flat(lists: DataFrame) -> DataFrame:
    """``conv, ids, words``: the ids of a conversation as one string of bytes, which sorts like the turns."""
    ids = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    return lists.select("conv", ids.alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"))


class _Rows:
    """The conversations of a shard in the order of their turn ids, then of their own ids."""

    def __init__(self, table: pa.Table) -> None:
        conv = table["conv"].to_numpy()
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), ">u8").reshape(-1, 2)
        lists = table["words"].combine_chunks()
        words = lists.flatten().to_numpy().astype(np.int64)
        lengths = np.diff(lists.offsets.to_numpy().astype(np.int64))
        begins = np.cumsum(lengths) - lengths
        # Dense numbers that sort like the ids.
        order = np.lexsort((ids[:, 1], ids[:, 0]))
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[order[1:]] != ids[order[:-1]]).any(axis=1)
        number = np.empty(len(ids), np.int64)
        number[order] = np.cumsum(fresh) - 1
        self.number, self.words_ = number, words
        self.conv, self.lengths, self.begins = conv, lengths, begins
        order = np.argsort(conv, kind="stable")
        for start in range((int(lengths.max()) - 1) // COLUMNS * COLUMNS if len(ids) else 0, -1, -COLUMNS):
            self._use(order)
            long = self.lengths > start
            at = np.flatnonzero(long)
            block = self.block(at, start)
            order = np.concatenate([np.flatnonzero(~long), at[np.lexsort(block.T[::-1])]])
        self._use(order)
        self.raw = ids
        self.weight = np.concatenate([[0], np.cumsum(self.words_)])

    def _use(self, order: np.ndarray) -> None:
        self.conv, self.lengths, self.begins = self.conv[order], self.lengths[order], self.begins[order]

    def block(self, rows: np.ndarray, start: int) -> np.ndarray:
        """Turn numbers of some rows from column `start` on, padded with -1."""
        place = np.arange(start, start + COLUMNS)
        inside = place < self.lengths[rows][:, None]
        at = np.where(inside, self.begins[rows][:, None] + place, 0)
        return np.where(inside, self.number[at], -1)

    def first_words(self, row: int) -> list[int]:
        begin = self.begins[row]
        return self.words_[begin : begin + self.lengths[row]].tolist()

    def words(self, rows: np.ndarray, after: int | np.ndarray) -> np.ndarray:
        """Words of each row's turns behind the first `after`."""
        return self.weight[self.begins[rows] + self.lengths[rows]] - self.weight[self.begins[rows] + np.minimum(after, self.lengths[rows])]

    def path(self, row: int) -> bytes:
        begin = self.begins[row]
        return self.raw[begin : begin + self.lengths[row]].tobytes()

    def starts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each depth: the rows that reach it, and whether each starts a node there."""
        rows, carried = np.arange(len(self.conv)), np.zeros(len(self.conv), bool)
        carried[0] = True
        yield 0, rows, carried
        deepest = int(self.lengths.max())
        for start in range(0, deepest, COLUMNS):
            keep = np.flatnonzero(self.lengths[rows] > start)
            # A row differs from the kept one above it if any row on the way differs from its own upper neighbour.
            sums = np.concatenate([[0], np.cumsum(carried)])
            carried = sums[keep + 1] > sums[np.concatenate([[0], keep[:-1] + 1])]
            rows = rows[keep]
            block = self.block(rows, start)
            change = np.ones(block.shape, bool)
            change[1:] = block[1:] != block[:-1]
            change[:, 0] |= carried
            change = np.logical_or.accumulate(change, axis=1)
            for k in range(min(COLUMNS, deepest - start)):
                reach = np.flatnonzero(block[:, k] >= 0)
                yield start + k + 1, rows[reach], change[reach, k]
            carried = change[:, -1]


def _digests(path: bytes) -> list[bytes]:
    """A digest of every beginning of a path of turn ids, from the empty one on."""
    running, out = hashlib.sha256(), []
    out.append(running.digest())
    for at in range(0, len(path), ID_BYTES):
        running.update(path[at : at + ID_BYTES])
        out.append(running.digest())
    return out


def shard_nodes(table: pa.Table, shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard's conversations by depth, and a row for its rims.

    Nodes on its first or last row are parts, with a digest of their path and
    the ids that end in them. All numbers are those of this shard alone.
    """
    r = _Rows(table)
    n = len(r.conv)
    paths = {FIRST: _digests(r.path(0)), LAST: _digests(r.path(n - 1))}
    # How many turns each row shares with the one above.
    common = np.zeros(n, np.int64)
    for depth, rows, fresh in r.starts():
        common[rows[~fresh]] = depth
    # A row's own nodes are those deeper than that; its last one is a leaf unless the next row goes on from it or equals it.
    own_words = np.concatenate([[0], np.cumsum(r.words(np.arange(n), common))])
    leaves = np.concatenate([[0], np.cumsum(np.append(common[1:] < r.lengths[:-1], True))])
    above = None
    for depth, rows, fresh in r.starts():
        at = np.flatnonzero(fresh)
        low, high = rows[at], rows[np.append(at[1:], len(rows)) - 1] + 1
        behind = max(depth - 1, 0)
        distinct = own_words[high] - own_words[low + 1] + r.words(low, behind)
        node = {
            "depth": depth, "low": low, "high": high,
            "conv": np.minimum.reduceat(r.conv[rows], at),
            "ends": np.add.reduceat((r.lengths[rows] == depth).astype(np.int64), at),
            "leaves": leaves[high] - leaves[low],
            "saved": np.add.reduceat(r.words(rows, behind), at) - distinct,
            "side": np.where(low == 0, FIRST, np.where(high == n, LAST, INNER)),
        }
        if above is None:
            node["parent"], node["parent_side"] = np.zeros(1, np.int64), np.full(1, FIRST)
        else:
            parent = np.searchsorted(above["low"], low, side="right") - 1
            node["parent"], node["parent_side"] = above["conv"][parent], above["side"][parent]
            yield _batch(r, above, np.bincount(parent, minlength=len(above["low"])), shard, paths)
        above = node
    yield _batch(r, above, np.zeros(len(above["low"]), np.int64), shard, paths)
    rim = {"shard": shard, "side": RIM, "path": r.path(0), "last_ids": r.path(n - 1), "words": r.first_words(0)}
    yield pa.RecordBatch.from_pylist([rim], _schema())


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _PART.split(", ")])


def _batch(r: _Rows, node: dict, children: np.ndarray, shard: int, paths: dict[int, list[bytes]]) -> pa.RecordBatch:
    depth, m = node["depth"], len(node["low"])
    digest, joined, path = [NO_IDS] * m, [None] * m, [None] * m
    for i in np.flatnonzero((node["ends"] > 0) | (node["side"] != INNER)).tolist():
        low, side = int(node["low"][i]), int(node["side"][i])
        # Rows that end here come first in their node, by rising ids.
        ids = ",".join(map(str, r.conv[low : low + int(node["ends"][i])].tolist()))
        if side == INNER:
            digest[i] = hashlib.sha256(ids.encode()).hexdigest()
        else:
            digest[i], joined[i], path[i] = None, ids, paths[side][depth]
    numbers = [node["conv"], np.full(m, depth), node["high"] - node["low"], children, node["leaves"], node["saved"]]
    columns = [
        *(pa.array(np.asarray(x, np.int64)) for x in numbers), pa.array(digest, pa.string()),
        pa.array(np.asarray(node["parent"], np.int64), mask=node["parent_side"] != INNER), pa.array(np.full(m, shard)),
        pa.array(node["side"].astype(np.int32)), pa.array(node["parent_side"].astype(np.int32)), pa.array(path, pa.binary()),
        pa.array(joined, pa.string()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_schema())


def _packed(batches: Iterator[pa.RecordBatch], least: int = 5_000) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _rims(parts: DataFrame) -> DataFrame:
    """What two neighbouring shards both counted, as parts to be taken off; a row per shard that isn't empty goes in."""
    order = Window.orderBy("shard")
    rims = parts.filter(F.col("side") == RIM).select(
        "shard", "last_ids", F.lead("path").over(order).alias("next_ids"), F.lead("words").over(order).alias("next_words")
    )

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = row["last_ids"], row["next_ids"]
                size = min(len(a), len(b)) // ID_BYTES
                x, y = (np.frombuffer(ids, ">u8", 2 * size).reshape(-1, 2) for ids in (a, b))
                differs = np.flatnonzero((x != y).any(axis=1))
                depth = int(differs[0]) if len(differs) else size
                words = np.array(row["next_words"][:depth], np.int64)
                # Words of the shared path from each depth on; the root has none of its own.
                twice = np.concatenate([np.cumsum(words[::-1])[::-1], [0]])
                twice = np.concatenate([[twice[0]], twice[:-1]]) if depth else np.zeros(1, np.int64)
                m = depth + 1
                ended = len(a) == depth * ID_BYTES
                zero = np.zeros(m, np.int64)
                columns = [np.full(m, np.iinfo(np.int64).max), np.arange(m), zero, np.where(np.arange(m) < depth, -1, 0), np.full(m, -int(ended)), twice]
                arrays = [pa.array(np.asarray(c, np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(np.full(m, row["shard"])), pa.array(_digests(a[: depth * ID_BYTES]), pa.binary()), pa.array([None] * m, pa.string())],
                    ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "shard", "path", "ids"],
                )

    return rims.filter("next_ids is not null").mapInArrow(overlap, f"{_NODE}, shard long, path binary, ids string")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes from their parts, which arrive in the order of path and shard; ids are hashed as they pass."""

    def parts():
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ids")]
            yield from zip(*columns, strict=True)

    out: list[tuple] = []
    for (path, depth), rows in groupby(parts(), key=lambda p: p[:2]):
        conv, sums, running, comma = None, [0, 0, 0, 0], hashlib.sha256(), b""
        for _, _, c, *counts, ids in rows:
            conv = c if conv is None or c < conv else conv
            sums = [a + b for a, b in zip(sums, counts, strict=True)]
            if ids:
                running.update(comma + ids.encode())
                comma = b","
        out.append((path, conv, depth, *sums, running.hexdigest()))
        if len(out) >= 10_000:
            yield _merged(out)
            out = []
    if out:
        yield _merged(out)


def _merged(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), *[pa.int64()] * 6, pa.string()]
    names = [c.split()[0] for c in _MERGED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int | None = 20
) -> DataFrame:
    """One row per distinct beginning of the conversations, the empty one included.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Turns are
    ordered by their number, null first; turns of one number by role and id.
    Null roles and texts are empty. Rows with a null conversation are left out;
    with no conversation there is no node. With ``group``, conversations are
    first rebuilt, see `rebuilt`; None takes them as they are. A conversation's
    ids and word counts, but never its texts, pass through one task.
    """
    spark = turns.sparkSession
    lists = turn_lists(turns, conv_col, turn_col, role_col, text_col)
    if group is not None:
        lists = rebuilt(stored(lists, "turns"), group)
    rows = stored(flat(lists), "conversations")
    size = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_TURNS))
    sharded = rows.repartitionByRange(shards, "ids", "conv").sortWithinPartitions("ids", "conv")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _packed(shard_nodes(pa.Table.from_batches(held), TaskContext.get().partitionId()))

    parts = stored(sharded.mapInArrow(nodes, _PART), "nodes")
    opened = parts.filter(F.col("side").isin(FIRST, LAST))
    names = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "shard", "path", "ids"]
    pieces = opened.select(*names).unionByName(_rims(parts).select(*names))
    merged = stored(pieces.repartition("path").sortWithinPartitions("path", "depth", "shard").mapInArrow(_merge, _MERGED), "merged")
    # What each shard calls its open nodes, by which the nodes below find their parent.
    spots = opened.join(merged.select("path", F.col("conv_id").alias("_parent")), "path")
    spots = stored(spots.select(*(F.col(c).alias(f"_{c}") for c in ("shard", "side", "depth")), "_parent"), "spots")
    found = lambda left: (
        (left["shard"] == spots["_shard"]) & (left["parent_side"] == spots["_side"]) & (left["depth"] - 1 == spots["_depth"])
    )
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = parts.filter(F.col("side") == INNER)
    done = inner.filter("parent_conv_id is not null").select(*order)
    rest = inner.filter("parent_conv_id is null").drop("parent_conv_id")
    rest = rest.join(spots, found(rest)).withColumnRenamed("_parent", "parent_conv_id").select(*order)
    # The node above an open one is open, too; any of its parts tells which it is.
    up = opened.filter("depth > 0").groupBy("path").agg(F.min(F.struct("shard", "parent_side", "depth")).alias("u")).select("path", "u.*")
    up = up.join(spots, found(up)).select("path", F.col("_parent").alias("parent_conv_id"))
    return done.unionByName(rest).unionByName(merged.join(up, "path", "left").select(*order))
