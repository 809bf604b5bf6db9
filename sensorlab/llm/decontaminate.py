"""Benchmark decontamination by spaced seeds.

A stretch in which four of five words agree has, among its neighbouring fives,
one with at most one other word. So the four masks that look at four words of
five, each leaving out one place or an end, find every such stretch: no pattern
of substitutions escapes. Items too short for that are looked up whole.

Seeds of all benchmark items and of all documents are joined by hash. A joint
seed tells a document, an item and how they are shifted against each other; the
whole item is then laid along the document's words, and the longest overlap in
which at least `percent` of the words agree is taken. It counts from `least`
words on, or from the whole item if that is shorter.

Before the join a bit map of the benchmark's hashes, of fixed size, drops most
of the documents' seeds where they are made. It has no false negatives; if a
huge benchmark fills it, more rows reach the join, and the result is the same.
Documents with a joint seed are read once more, so that no text is shipped for
a seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import list_array, map_arrow, maybe_in, small_batches, stored
from sensorlab.llm.words import hash_words, mix64, plain_words, split_words

#: Every choice of four words of five, up to shifts.
MASKS = ("1111", "11101", "11011", "10111")
SPAN = 5
MAP_BITS = 26


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, ends = split_words(texts)
    coded = words.dictionary_encode()
    known = hash_words(plain_words(coded.dictionary))
    return known[coded.indices.to_numpy()] if len(words) else known, ends


def masks_for(short: list[int]) -> list[str]:
    """The spaced masks, and a full mask for each item length below SPAN."""
    return [*MASKS, *("1" * n for n in sorted(set(short)) if n < SPAN and "1" * n not in MASKS)]


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each place it fits, texts' limits left aside."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(len(mask) * 131 + int(mask, 2)))
    for k, bit in enumerate(mask):
        if bit == "1":
            out += hashes[k : k + n] * np.uint64(2 * k * k + 6 * k + 0x9E3779B97F4A7C15)
    return mix64(out)


def _places(ends: np.ndarray, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text of each place, and whether `width` words from there lie in it."""
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: max(total, 0)]
    return text, ends[text] - np.arange(len(text)) >= width


def longest_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[int, int, int]:
    """Start, length and matches of the longest stretch of two aligned rows in which `percent` agree; ties the first.

    It begins and ends with a match, and its running score doesn't end below
    where it began; the first beginning that low is found in the running least.
    """
    same = a == b
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    score = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
    least = np.minimum.accumulate(score[at])
    first = np.searchsorted(-least, -score[at + 1], side="left")
    # A match by itself is a stretch, so no beginning lies behind its end.
    length = at + 1 - at[np.minimum(first, np.arange(len(at)))]
    end = int(length.argmax())
    start = int(at[end] + 1 - length[end])
    return start, int(length[end]), int(same[start : at[end] + 1].sum())


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", least: int = 13, percent: int = 80, shortest: int = 1,
) -> DataFrame:
    """Pairs ``id_col, item_col, start, n_words, n_matches``: where a document repeats a benchmark item.

    `start` counts words of the document. Words are compared in lower case and
    without punctuation at their ends. Null ids and null or empty texts match
    nothing. Items of fewer than ``shortest`` words are not searched. Repeated
    rows of a document or an item give one pair; each pair gets its longest
    overlap, ties the first one. Needs ``percent`` of 80 or more.
    """
    if percent < 80:
        raise ValueError("four words of five find overlaps of 80 % and more")
    spark = docs.sparkSession
    small_batches(spark)

    def item_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, ends = _hashes(batch.column("_text"))
        return pa.RecordBatch.from_arrays([batch.column("_item"), list_array(hashes.view(np.int64), ends)], ["_item", "_words"])

    items = benchmark.select(F.col(item_col).cast("long").alias("_item"), F.col(item_text_col).alias("_text"))
    items = map_arrow(items.filter("_item is not null"), item_words, "_item long, _words array<long>")
    items = stored(items.filter(F.size("_words") >= max(shortest, 1)).distinct(), "items")
    # Distinct lengths below SPAN: four numbers at most.
    short = [r["n"] for r in items.filter(F.size("_words") < SPAN).select(F.size("_words").alias("n")).distinct().collect()]
    masks = masks_for(short)

    def item_seeds(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("_words")
        hashes = lists.flatten().to_numpy().view(np.uint64)
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        size, first = np.diff(ends, prepend=0), np.concatenate([[0], ends])[:-1]
        found, at = [], []
        for mask in masks:
            seeds = seed_hashes(hashes, mask)
            text, fits = _places(ends, len(seeds), len(mask))
            # The shorter full masks are for items of just their length.
            place = np.flatnonzero(fits & ((size[text] == len(mask)) | (mask in MASKS)))
            found.append(seeds[place])
            at.append(place)
        place = np.concatenate(at)
        text = np.searchsorted(ends, place, side="right")
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(found).view(np.int64)), batch.column("_item").take(pa.array(text)), pa.array((place - first[text]).astype(np.int32))],
            ["_seed", "_item", "_from"],
        )

    seeds = stored(map_arrow(items, item_seeds, "_seed long, _item long, _from int").distinct(), "seeds")
    # The bit map: 2^MAP_BITS bits as at most 2^(MAP_BITS - 6) numbers.
    slot = F.shiftrightunsigned("_seed", 64 - MAP_BITS)
    marked = seeds.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("w"))
    marked = marked.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("b"))
    words = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for row in marked.collect():
        words[row["w"]] = row["b"]
    marks = spark.sparkContext.broadcast(words.view(np.uint8))

    def hits(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Seeds that the bit map lets through, with their places."""
        hashes, ends = _hashes(batch.column("_text"))
        found, at, of = [], [], []
        for mask in masks:
            seed = seed_hashes(hashes, mask)
            slots = seed >> np.uint64(64 - MAP_BITS)
            bits = marks.value[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)
            place = np.flatnonzero(bits & 1)
            text = np.searchsorted(ends, place, side="right")
            inside = ends[text] - place >= len(mask)
            place, text = place[inside], text[inside]
            found.append(seed[place])
            at.append(place - np.concatenate([[0], ends])[text])
            of.append(text)
        text = pa.array(np.concatenate(of))
        return pa.RecordBatch.from_arrays(
            [batch.column("_id").take(text), batch.column("_key").take(text), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(at))],
            ["_id", "_key", "_seed", "_at"],
        )

    # Equal texts of one id are one document.
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null and _text is not null")
    texts = texts.withColumn("_key", F.unhex(F.md5(F.col("_text").cast("binary"))))
    near = map_arrow(texts, hits, "_id long, _key binary, _seed long, _at long")
    lines = near.join(seeds, "_seed").select("_id", "_key", "_item", (F.col("_at") - F.col("_from")).alias("_shift"))
    lines = stored(lines.distinct(), "lines")

    # A document comes first, then its lines, each with its item.
    asked = lines.join(items.withColumnRenamed("_words", "_item_words"), "_item").withColumn("_text", F.lit(None).cast("string"))
    # A bit map again, of some 64 bits for each of these documents: the few others that pass have no lines.
    n = lines.select("_id").distinct().count()
    read = maybe_in(texts, "_id", lines.select("_id"), bits=min(max((64 * n).bit_length(), 16), 27)).dropDuplicates(["_id", "_key"])
    both = read.unionByName(asked, allowMissingColumns=True).withColumn("_line", F.col("_item").isNotNull())
    both = both.repartition("_id", "_key").sortWithinPartitions("_id", "_key", "_line", "_item", "_shift")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_, doc = None, np.empty(0, np.uint64)
        for batch in batches:
            rows = []
            columns = [batch.column(c) for c in ("_line", "_text", "_id", "_item", "_shift", "_item_words")]
            for line, text, id_, item_id, shift, words_ in zip(*columns, strict=True):
                if not line.as_py():
                    text_ = text.as_py()
                    continue
                if text_ is not None:
                    (doc, _), text_ = _hashes(pa.array([text_])), None
                item, at = words_.values.to_numpy().view(np.uint64), shift.as_py()
                low, high = max(0, -at), min(len(item), len(doc) - at)
                start, n, same = longest_overlap(doc[low + at : high + at], item[low:high], percent)
                if n >= min(least, len(item)):
                    rows.append((id_.as_py(), item_id.as_py(), low + at + start, n, same))
            if rows:
                columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, item_col, "start", "n_words", "n_matches"])

    found = both.mapInArrow(aligned, f"`{id_col}` long, `{item_col}` long, start long, n_words long, n_matches long")
    best = F.max_by(F.struct("start", "n_words", "n_matches"), F.struct("n_words", "n_matches", -F.col("start"))).alias("b")
    return found.groupBy(id_col, item_col).agg(best).select(id_col, item_col, "b.*")


#: For an item of fewer words no document is dropped; chance would do for that.
FEWEST = 5


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that repeat no benchmark item of at least FEWEST words; rows with a null id stay."""
    leaks = find_leaks(docs, benchmark, id_col, text_col, shortest=FEWEST).select(F.col(id_col).alias("_leak")).distinct()
    return docs.join(leaks, F.col(id_col) == F.col("_leak"), "left_anti")
