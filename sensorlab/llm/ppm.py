"""Prediction by partial matching over bytes, trained and applied as Spark jobs.

A text is lower-cased (A-Z) and read as its bytes and an end. A byte's context
are the ORDER bytes before it, across words and lines; marks stand before the
text's start. The trie's nodes are these contexts with the counts of the bytes
that followed. A byte is coded at the longest context that has seen it; each
longer one is left by an escape, and bytes seen there are excluded below. Below
the empty context all bytes not yet excluded are alike. Escapes are estimated by
method D: of 2n, a symbol seen c times has 2c - 1 and the escape one for each
different symbol. A text's score is the sum over its bytes and its end; the
probabilities of what may follow a context sum to 1 (`score_bytes`).

Nothing is kept whole in one place. Blocks of documents have dictionaries of
their words and of their byte sequences (context and byte); the texts stay with
their block. Counts of a sequence are summed over blocks where all contexts that
share their last two bytes meet, which is all that a byte's chain of contexts
needs but for the counts of single bytes and pairs (at most 256 and 65,536
numbers). The logarithms go back the same way.

`score_texts` is another model with the same chain: contexts stop at the start
of a unit (a word with the space or line feed that ends it, or with the end of
the text), and above the bytes stands one context of no limited length, the unit
from its start. A unit seen in training is coded there as a whole, a new one
escapes to its bytes. By update exclusion the contexts below count every unit
once. It does not tell a text from its words in another order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import discard, list_array, runs, small_batches, stored
from sensorlab.llm.words import hash_words, split_words, sums

ORDER = 5
START, END = 0xFE, 0xFF  # no byte of UTF-8
SYMBOLS = 255
ENTRIES = 400_000
CHUNK = 10_000
BLOCK_ENTRIES = 1 << 20  # words or sequences of a block of texts
BLOCK_BYTES = 1 << 27  # of a block's texts, about
BUNDLE = 1 << 23  # bytes of text at a time
WINDOW = 1 << 20  # byte sequences at a time
BUCKETS = 1024  # of words
SLICE = 64  # blocks of which a task looks up sequences at a time


def bundles(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def coded_rows(
    rows: DataFrame, items_of: Callable[[pa.RecordBatch], tuple[pa.Array, np.ndarray]], kind: str, bundle: int, label: str
) -> DataFrame:
    """Stored blocks of rows (``_row, _weight, _codes``) and of their dictionaries (``_from, _items, _counts``).

    A block is what one task met until its dictionary had ENTRIES entries.
    `_counts` sum the weights of the rows by item.
    """
    item_type = {"string": pa.string(), "long": pa.int64()}[kind]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        known: dict = {}
        counts: list[np.ndarray] = []
        block = task << 24

        def dictionary() -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(known), np.int64)
            for part in counts:
                total[: len(part)] += part
            items = list(known)
            for a in range(0, len(items), CHUNK):
                part = items[a : a + CHUNK]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]), pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()),
                        pa.array([None], pa.list_(pa.int32())), pa.array([a], pa.int32()), pa.array([part], pa.list_(item_type)),
                        pa.array([total[a : a + CHUNK]], pa.list_(pa.int64())),
                    ],
                    names,
                )

        for batch in bundles(batches, bundle):
            if not batch.num_rows:
                continue
            items, ends = items_of(batch)
            coded = items.dictionary_encode()
            entries = coded.dictionary.to_pylist()
            for entry in entries:
                if entry not in known:
                    known[entry] = len(known)
            codes = np.fromiter((known[e] for e in entries), np.int32, len(entries))[coded.indices.to_numpy()]
            weight = batch.column("_weight").to_numpy()
            part = np.bincount(codes, np.repeat(weight, np.diff(ends, prepend=0)), len(known)).astype(np.int64)
            counts = [*counts, part] if len(counts) < 8 else [*counts[:-1], part + np.pad(counts[-1], (0, len(part) - len(counts[-1])))]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, block)), pa.array(np.zeros(n, np.int32)), batch.column("_row"), batch.column("_weight"), list_array(codes, ends),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(item_type)), pa.nulls(n, pa.list_(pa.int64())),
                ],
                names,
            )
            if len(known) >= ENTRIES:
                yield from dictionary()
                known, counts, block = {}, [], block + 1
        if known:
            yield from dictionary()

    names = ["_block", "_kind", "_row", "_weight", "_codes", "_from", "_items", "_counts"]
    small_batches(rows.sparkSession)
    schema = f"_block long, _kind int, _row long, _weight long, _codes array<int>, _from int, _items array<{kind}>, _counts array<long>"
    return stored(rows.mapInArrow(encode, schema), label)


def entries(coded: DataFrame) -> DataFrame:
    """``_block, _code, _item, _count`` of every dictionary."""
    rows = coded.filter("_kind = 1").select("_block", "_from", F.posexplode(F.arrays_zip("_items", "_counts")).alias("p", "e"))
    return rows.select("_block", (F.col("_from") + F.col("p")).alias("_code"), F.col("e._items").alias("_item"), F.col("e._counts").alias("_count"))


def summed_rows(coded: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """``_row, _weight`` and the sums over each row's items of the ``names`` in ``_block, _code, *names``."""
    width = len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, table = None, np.zeros((0, width))
        for piece in runs(batches, ["_block", "_kind"]):
            piece = piece.combine_chunks()
            if piece["_kind"][0].as_py() < 0:
                block, codes = piece["_block"][0].as_py(), piece["_code"].to_numpy()
                table = np.zeros((codes.max() + 1, width))
                table[codes] = np.column_stack([piece[n].to_numpy() for n in names])
                continue
            for batch in piece.to_batches(max_chunksize=512):
                assert batch.column("_block")[0].as_py() == block or not len(batch.column("_codes").flatten())
                lists = batch.column("_codes")
                codes = lists.flatten().to_numpy()
                ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
                totals = [pa.array(sums(table[codes, k], ends)) if len(codes) else pa.array(np.zeros(len(ends))) for k in range(width)]
                yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_weight"), *totals], ["_row", "_weight", *names])

    rows = coded.filter("_kind = 0").select("_block", "_kind", "_row", "_weight", "_codes", F.lit(None).cast("int").alias("_code"), *(F.lit(None).cast("double").alias(n) for n in names))
    none = [F.lit(None).cast(t) for t in ("long", "long", "array<int>")]
    values = values.select("_block", F.lit(-1), *none, "_code", *names)
    both = rows.union(values).repartition("_block").sortWithinPartitions("_block", "_kind")
    return both.mapInArrow(add, "_row long, _weight long, " + ", ".join(f"{n} double" for n in names))


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of the texts, without the space that ends most; the last of a text ends in END's stand-in, U+FFFF after a mark.

    A unit's last character tells its end: a line feed, or 0 for a space, or 1
    for the end of the text; the character is appended, so it is never the text's own.
    """
    texts = pc.replace_substring(pc.ascii_lower(pc.fill_null(texts, "")), "\n", "\n ")
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
    mark = np.where(pc.ends_with(flat, "\n").to_numpy(zero_copy_only=False), "2", "0")
    mark[ends - 1] = "1"  # a text that ends in a line feed has an empty last piece
    return pc.binary_join_element_wise(flat, pa.array(mark), ""), ends


def unit_bytes(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each unit as the model sees them, START marks before, and their ends."""
    items = items.cast(pa.binary())
    size = pc.binary_length(items).to_numpy().astype(np.int64)
    offsets = np.frombuffer(items.buffers()[1], np.int32)[items.offset : items.offset + len(items) + 1]
    raw = np.frombuffer(items.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(items) else np.empty(0, np.uint8)
    ends = np.cumsum(size)
    marks = raw[ends - 1] if len(raw) else raw
    keep = np.ones(len(raw), bool)
    keep[ends[marks == ord("2")] - 1] = False  # the line feed is there already
    body = raw.copy()
    body[ends[marks == ord("0")] - 1] = 0x20
    body[ends[marks == ord("1")] - 1] = END
    size = size - (marks == ord("2"))
    out_ends = np.cumsum(size + ORDER)
    out = np.full(out_ends[-1] if len(size) else 0, START, np.uint8)
    text = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(text)) + ORDER * (text + 1)] = body[keep]
    return out, out_ends


def sequences(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of every byte of the units, ORDER + 1 bytes in one number, and each unit's end."""
    data, ends = unit_bytes(items)
    wide = data.astype(np.int64)
    n = len(data) - ORDER
    packed = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER + 1):
        packed |= wide[k : k + max(n, 0)] << (8 * (ORDER - k))
    size = np.diff(ends, prepend=0) - ORDER
    first = np.concatenate([[0], ends])[:-1].astype(np.int64)
    total = np.cumsum(size)
    index = np.repeat(first - (total - size), size) + np.arange(total[-1] if len(size) else 0)
    return packed[index], total


def sequence_logs(found: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of each byte's probability after its context, for sequences whose contexts share their last two bytes.

    `found` are all distinct sequences, with training counts that may be 0;
    `pairs[a, b]` counts b after a in training.
    """
    out = np.zeros(len(found))
    done = np.zeros(len(found), bool)
    distinct_above = np.zeros(len(found))  # different bytes seen at the longer context
    above_code = above_seen = None  # the longer order's sequences: code of each row, whether seen
    byte = found & 0xFF
    for order in range(ORDER, -1, -1):
        if order >= 2:
            key, code = np.unique(found & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
            c = np.bincount(code, counts, len(key))
            context, of_key = np.unique(key >> 8, return_inverse=True)
            total = np.bincount(of_key, c, len(context))[of_key][code]
            distinct = np.bincount(of_key, c > 0, len(context))[of_key][code]
            own = c[code]
        else:
            c = pairs.sum(axis=0) if order == 0 else pairs[(found[0] >> 8) & 0xFF] if len(found) else pairs[0]
            total = np.full(len(found), c.sum(), float)
            distinct = np.full(len(found), (c > 0).sum(), float)
            own = c[byte].astype(float)
        # What the longer context has seen is excluded: its bytes' counts here, once for each.
        excluded = np.zeros(len(found))
        if above_code is not None:
            first = np.unique(above_code, return_index=True)[1]
            mass = np.where(above_seen[first], own[first], 0.0)
            if order >= 1:
                group = np.unique(found[first] >> 8 & ((1 << (8 * (order + 1))) - 1), return_inverse=True)[1]
                excluded = np.zeros(len(found))
                by_group = np.bincount(group, mass)
                spread = np.zeros(above_code.max() + 1)
                spread[above_code[first]] = by_group[group]
                excluded = spread[above_code]
            else:
                excluded = np.full(len(found), c[pairs[(found[0] >> 8) & 0xFF] > 0].sum(), float) if len(found) else excluded
        free, fresh = total - excluded, distinct - distinct_above
        open_ = ~done & (fresh > 0)
        hit = open_ & (own > 0)
        out[hit] += np.log10((2 * own[hit] - 1) / (2 * free[hit]))
        miss = open_ & ~hit
        out[miss] += np.log10(fresh[miss] / (2 * free[miss]))
        done |= hit
        distinct_above = distinct
        if order >= 2:
            above_code, above_seen = code, own > 0
        elif order == 1:
            above_code, above_seen = byte, own > 0
    left = SYMBOLS - distinct_above
    out[~done] -= np.log10(left[~done])
    return out


def held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id's text, mod 7, is 2; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """The model of whole units, which no query uses: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows that aren't held out. `score` sums its units'
    logarithms over the whole lower-cased text and its end, `base_score` that of
    its words under the word counts of training, one added to each. Null texts
    count as empty, repeated rows count each time, a null id is scored as any.
    """
    held = held_out(id_col) if held is None else held
    rows = docs.select(
        F.col(id_col).cast("long").alias("_row"), (~held).cast("long").alias("_weight"), F.col(text_col).alias("_text")
    )
    coded = coded_rows(rows, lambda b: units(b.column("_text")), "string", 512, "units")
    places = entries(coded)
    known = stored(places.groupBy("_item").agg(F.sum("_count").alias("_weight")).withColumn("_row", F.xxhash64("_item")), "vocabulary")

    # Base: the words of each unit; the mark at a unit's end tells the text's end, a word of its own.
    text = F.expr("substring(_item, 1, length(_item) - 1)")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    words = F.when(F.col("_item").endswith("1"), F.array_append(words, F.lit(" "))).otherwise(words)
    words = stored(known.select("_row", "_weight", F.explode(words).alias("_word")), "words")
    counted = words.groupBy("_word").agg(F.sum("_weight").alias("_c"))
    counted = stored(counted, "counts")
    n, v = counted.filter("_c > 0").agg(F.coalesce(F.sum("_c"), F.lit(0)), F.count("*")).first()
    one = F.log10((F.col("_c") + 1) / F.lit(float(n + v + 1)))
    base = words.join(counted, "_word").groupBy("_row").agg(
        F.sum(one).alias("base"), F.count("*").cast("double").alias("tokens"), F.sum((F.col("_c") > 0).cast("double")).alias("known")
    )

    # The trie's sequences, from the vocabulary.
    deep = coded_rows(
        known.select("_row", F.least("_weight", F.lit(1)).alias("_weight"), "_item"), lambda b: (lambda s: (pa.array(s[0]), s[1]))(sequences(b.column("_item"))), "long", 16_384, "sequences"
    )
    found = entries(deep)
    last_two = F.shiftright("_item", 8).bitwiseAND(0xFFFF)
    pairs = np.zeros((256, 256), np.int64)
    for r in found.groupBy(last_two.bitwiseAND(0xFF).alias("a"), F.col("_item").bitwiseAND(0xFF).alias("b")).agg(F.sum("_count").alias("n")).collect():
        pairs[r["a"], r["b"]] = r["n"]

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["_near"]):
            item, at = np.unique(group["_item"].to_numpy(), return_inverse=True)
            value = sequence_logs(item, np.bincount(at, group["_count"].to_numpy(), len(item)), pairs)[at]
            yield from pa.table([group["_block"], group["_code"], pa.array(value)], ["_block", "_code", "score"]).combine_chunks().to_batches()

    near = found.withColumn("_near", last_two).repartition("_near").sortWithinPartitions("_near")
    scores = summed_rows(deep, near.mapInArrow(logs, "_block long, _code int, score double"), ["score"])

    names = ["score", "base", "tokens", "known"]
    seen, kinds = known.filter("_weight > 0").agg(F.coalesce(F.sum("_weight"), F.lit(0)), F.count("*")).first()
    escape = float(np.log10(kinds / (2 * seen))) if seen else 0.0
    whole = F.log10((2 * F.col("_weight") - 1) / F.lit(2.0 * max(seen, 1)))
    value = known.select("_row", "_weight").join(scores.select("_row", "score"), "_row").join(base, "_row", "left").na.fill(0.0)
    value = value.withColumn("score", F.when(F.col("_weight") > 0, whole).otherwise(F.col("score") + escape))
    value = stored(value.select("_row", *names), "values")
    discard(words, counted, deep, known)
    values = places.select("_block", "_code", F.xxhash64("_item").alias("_row")).join(value, "_row").select("_block", "_code", *names)
    out = summed_rows(coded, values, names)
    return out.select(
        F.col("_row").alias(id_col), (F.col("_weight") == 0).alias("held_out"), F.col("tokens").cast("long").alias("n_tokens"),
        F.col("known").cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str], size: int | None = None) -> Iterator[pa.Table]:
    """Tables of neighbouring rows with equal long keys; a table of `size` bytes or more gets no further batch."""
    held, held_bytes, last = [], 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        fresh = np.zeros(n - 1, bool)
        for c in columns:
            fresh |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(fresh) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = [c[a] for c in columns]
            if held and (key != last or size is not None and held_bytes >= size):
                yield pa.Table.from_batches(held).combine_chunks()
                held, held_bytes = [], 0
            held.append(batch.slice(a, b - a))
            held_bytes += held[-1].nbytes
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, ORDER START marks before and END behind each, and where each text ends."""
    before, end, none = (pa.scalar(b, pa.large_binary()) for b in (bytes([START]) * ORDER, bytes([END]), b""))
    marked = pc.binary_join_element_wise(before, texts.cast(pa.large_binary()), end, none)
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    return np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def byte_windows(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Context and byte, ORDER + 1 bytes in one number, of all bytes from ORDER on; with each window, the place of its first byte.

    Those of the marks before a text have START as their byte.
    """
    for a in range(0, len(data) - ORDER, WINDOW):
        part = data[a : a + WINDOW + ORDER]
        two = part[:-1].astype(np.uint16) << 8 | part[1:]
        four = two[:-2].astype(np.uint32) << 16 | two[2:]
        yield a + ORDER, (four[:-2].astype(np.uint64) << np.uint64(16) | two[4:]).view(np.int64)


def coded_texts(rows: DataFrame) -> DataFrame:
    """Stored blocks of rows ``_row, _weight, _text``, of lower-cased texts, and of their dictionaries.

    `_kind` 0 is a row; 1 the block's words of one bucket, `_near`, the text's
    end being the word " "; 2 its byte sequences whose contexts share their last
    two bytes, `_near`, which `_items` leave out; 3 its pairs of bytes. `_counts`
    sum the weights, 0 or 1, over the block's rows. A block is what one task met
    until a dictionary had BLOCK_ENTRIES entries or the texts BLOCK_BYTES; the
    task's number and the block's in it make `_block`, 24 bits for the latter.
    """
    kinds = {"_words": pa.list_(pa.string()), "_items": pa.list_(pa.int32()), "_counts": pa.list_(pa.int64())}
    fields = {"_block": pa.int64(), "_kind": pa.int32(), "_row": pa.int64(), "_weight": pa.int64(), "_text": pa.string(), "_near": pa.int64(), **kinds}

    def table(n: int, block: int, kind: int, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
        columns = {"_block": pa.array(np.full(n, block)), "_kind": pa.array(np.full(n, kind, np.int32)), **columns}
        yield pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in fields.items()], list(fields))

    def summed(parts: list[pa.Table]) -> list[pa.Table]:
        return [pa.concat_tables(parts).group_by("item", use_threads=False).aggregate([("n", "sum")]).rename_columns(["item", "n"])]

    def counted(texts: pa.Array, weight: int) -> tuple[pa.Table, list[pa.Table]]:
        found = split_words(texts, lower=False)[0].value_counts()
        item = pa.concat_arrays([found.field("values"), pa.array([" "])])
        n = np.append(found.field("counts").to_numpy(), len(texts)) * weight
        sequences = []
        for _, keys in byte_windows(text_bytes(texts)[0]):
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size, keys = np.diff(first, append=len(keys)) * weight, keys[first]
            real = keys & 0xFF != START
            sequences.append(pa.table({"item": keys[real], "n": size[real]}))
        return pa.table({"item": item, "n": n}), sequences

    def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """An order by key, where each key's entries end, and the keys."""
        order = np.argsort(key, kind="stable")
        key = key[order]
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        return order, ends, pa.array(key[ends - 1])

    def dictionaries(block: int, words: list[pa.Table], sequences: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        (found,) = summed(words)
        word = found["item"].combine_chunks()
        hashes = [hash_words(word.slice(a, CHUNK)) for a in range(0, len(word), CHUNK)]
        bucket = (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)
        order, ends, near = grouped(bucket)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), word.take(pa.array(order)))
        yield from table(len(ends), block, 1, _near=near, _words=lists, _counts=list_array(found["n"].to_numpy()[order], ends))
        (found,) = summed(sequences)
        item, n = found["item"].to_numpy(), found["n"].to_numpy()
        order, ends, near = grouped(item >> 8 & 0xFFFF)
        rest = (item >> 24 << 8 | item & 0xFF).astype(np.uint32).view(np.int32)
        yield from table(len(ends), block, 2, _near=near, _items=list_array(rest[order], ends), _counts=list_array(n[order], ends))
        pairs = np.bincount(item & 0xFFFF, n, 1 << 16).astype(np.int64)
        some = np.flatnonzero(pairs).astype(np.int32)
        yield from table(1, block, 3, _items=list_array(some, np.array([len(some)])), _counts=list_array(pairs[some], np.array([len(some)])))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 24, 0
        words: list[pa.Table] = []
        sequences: list[pa.Table] = []
        for piece in pieces(batches, [], BUNDLE):
            texts = pc.ascii_lower(pc.fill_null(piece["_text"].combine_chunks(), ""))
            size += texts.nbytes
            yield from table(len(texts), block, 0, _row=piece["_row"].combine_chunks(), _weight=piece["_weight"].combine_chunks(), _text=texts)
            for weight in (0, 1):
                some = texts.filter(pc.equal(piece["_weight"].combine_chunks(), weight))
                if len(some):
                    of_words, of_bytes = counted(some, weight)
                    words.append(of_words)
                    sequences.extend(of_bytes)
            full = False
            if max(sum(map(len, words)), sum(map(len, sequences))) >= 1.5 * BLOCK_ENTRIES:
                words, sequences = summed(words), summed(sequences)
                full = max(len(words[0]), len(sequences[0])) >= BLOCK_ENTRIES
            if full or size >= BLOCK_BYTES:
                yield from dictionaries(block, words, sequences)
                words, sequences, block, size = [], [], block + 1, 0
        if words:
            yield from dictionaries(block, words, sequences)

    small_batches(rows.sparkSession)
    schema = "_block long, _kind int, _row long, _weight long, _text string, _near long, _words array<string>, _items array<int>, _counts array<long>"
    return stored(rows.mapInArrow(encode, schema), "texts")


def whole_items(rest: np.ndarray, near: np.ndarray | int) -> np.ndarray:
    """Byte sequences, from their bytes but the context's last two, and these."""
    rest = rest.view(np.uint32).astype(np.int64)
    return rest >> 8 << 24 | near << 8 | rest & 0xFF


def text_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each text's values, 0 for a text without any."""
    starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
    out = np.zeros(len(ends))
    some = starts < ends
    if some.any():
        out[some] = np.add.reduceat(values, starts[some], dtype=np.float64)
    return out


def byte_scores(texts: pa.Array, index: pd.Index, logs: np.ndarray) -> np.ndarray:
    """Each text's sum of the `logs` of its byte sequences, which `index` holds; the last of `logs` is 0."""
    data, ends = text_bytes(texts)
    out = np.zeros(len(texts))
    for place, keys in byte_windows(data):
        at = index.get_indexer(keys)
        assert np.count_nonzero(at < 0) == np.count_nonzero(data[place : place + len(keys)] == START)
        first, last = np.searchsorted(ends, [place, place + len(keys) - 1], "right")
        out[first : last + 1] += np.add.reduceat(logs[at], np.concatenate([[0], ends[first:last] - place]))
    return out


def score_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows that aren't held out. `score` is the log10
    probability of all bytes of the lower-cased text and of its end, each after
    the ORDER bytes before it; `base_score` that of its words under the word
    counts of training, one added to each. Null texts count as empty, repeated
    rows count each time, a null id is scored as any.
    """
    held = held_out(id_col) if held is None else held
    rows = docs.select(
        F.col(id_col).cast("long").alias("_row"), (~held).cast("long").alias("_weight"), F.col(text_col).alias("_text")
    )
    coded = coded_texts(rows)

    # Base: each block's words with their counts in all blocks; a bucket's first row has its tokens and different words.
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in pieces(batches, ["_near"]):
            words = group["_words"].combine_chunks()
            word = words.flatten().dictionary_encode()
            at = word.indices.to_numpy()
            count = np.bincount(at, group["_counts"].combine_chunks().flatten().to_numpy(), len(word.dictionary)).astype(np.int64)
            first = np.arange(len(words)) == 0
            counts = list_array(count[at], np.cumsum(pc.list_value_length(words).to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [group["_block"].combine_chunks(), words, counts, pa.array(first * count.sum()), pa.array(first * np.count_nonzero(count))],
                ["_block", "_words", "_counts", "_tokens", "_kinds"],
            )

    words = coded.filter("_kind = 1").select("_block", "_near", "_words", "_counts").repartition("_near").sortWithinPartitions("_near")
    words = stored(words.mapInArrow(total, "_block long, _words array<string>, _counts array<long>, _tokens long, _kinds long"), "words")
    n, v = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("_tokens", "_kinds"))).first()

    # The trie's sequences, where contexts with the same last two bytes meet.
    pairs = np.zeros((256, 256), np.int64)
    two = coded.filter("_kind = 3").select(F.explode(F.arrays_zip("_items", "_counts")).alias("e")).groupBy(F.col("e._items").alias("ab"))
    for r in two.agg(F.sum("e._counts").alias("n")).collect():
        pairs[r["ab"] >> 8, r["ab"] & 0xFF] = r["n"]

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in pieces(batches, ["_near"]):
            near = group["_near"][0].as_py()
            parts = [group.slice(a, SLICE).to_batches()[0] for a in range(0, len(group), SLICE)]
            item, count = np.zeros(0, np.int64), np.zeros(0)
            for part in parts:
                items, counts = (part.column(c).flatten().to_numpy() for c in ("_items", "_counts"))
                item, at = np.unique(np.concatenate([item, whole_items(items, near)]), return_inverse=True)
                count = np.bincount(at, np.concatenate([count, counts]), len(item))
            value = sequence_logs(item, count, pairs)
            for part in parts:
                at = np.searchsorted(item, whole_items(part.column("_items").flatten().to_numpy(), near))
                values = list_array(value[at], np.cumsum(pc.list_value_length(part.column("_items")).to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column("_block"), part.column("_near"), part.column("_items"), values], ["_block", "_near", "_items", "_logs"])

    near = coded.filter("_kind = 2").select("_block", "_near", "_items", "_counts").repartition("_near").sortWithinPartitions("_near")
    near = near.mapInArrow(logs, "_block long, _near long, _items array<int>, _logs array<double>")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = ready = None
        for piece in pieces(batches, ["_block", "_kind"], BUNDLE):
            kind = piece["_kind"][0].as_py()
            if piece["_block"][0].as_py() != block:
                block, ready, known, found = piece["_block"][0].as_py(), None, [], []
            if kind == -2:
                known.append((piece["_words"].combine_chunks().flatten(), piece["_counts"].combine_chunks().flatten().to_numpy()))
                continue
            if kind == -1:
                items = piece["_items"].combine_chunks()
                near_of = np.repeat(piece["_near"].to_numpy(), pc.list_value_length(items).to_numpy())
                found.append((whole_items(items.flatten().to_numpy(), near_of), piece["_logs"].combine_chunks().flatten().to_numpy()))
                continue
            if ready is None:
                word, count = pa.concat_arrays([k[0] for k in known]), np.concatenate([k[1] for k in known])
                index = pd.Index(np.concatenate([f[0] for f in found]))
                ready = np.concatenate([*(f[1] for f in found), [0.0]])
                known, found = [], []
                one = np.log10((count + 1) / float(n + v + 1))
                end = pc.index(word, " ").as_py()
            texts = piece["_text"].combine_chunks()
            flat, ends = split_words(texts, lower=False)
            flat = flat.dictionary_encode()
            at = pc.index_in(flat.dictionary, value_set=word).to_numpy()[flat.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [
                    piece["_row"].combine_chunks(), piece["_weight"].combine_chunks(), pa.array(byte_scores(texts, index, ready)),
                    pa.array(text_sums(one[at], ends) + one[end]), pa.array(np.diff(ends, prepend=0) + 1),
                    pa.array(text_sums(count[at] > 0, ends).astype(np.int64) + int(count[end] > 0)),
                ],
                ["_row", "_weight", "score", "base", "tokens", "known"],
            )

    none = {"_row": "long", "_weight": "long", "_text": "string", "_near": "long", "_words": "array<string>", "_counts": "array<long>", "_items": "array<int>", "_logs": "array<double>"}

    def filled(df: DataFrame, kind: int) -> DataFrame:
        return df.select("_block", F.lit(kind).alias("_kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()))

    texts = coded.filter("_kind = 0").select("_block", "_row", "_weight", "_text")
    both = filled(texts, 0).union(filled(words, -2)).union(filled(near, -1))
    # The blocks are dealt out evenly: neighbouring tasks' to neighbouring partitions.
    deal = F.shiftright("_block", 24) + F.col("_block").bitwiseAND(0xFFFFFF) * 7919
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartitionById(partitions, (deal % partitions).cast("int")).sortWithinPartitions("_block", "_kind")
    out = both.mapInArrow(score, "_row long, _weight long, score double, base double, tokens long, known long")
    return out.select(
        F.col("_row").alias(id_col), (F.col("_weight") == 0).alias("held_out"), F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )
