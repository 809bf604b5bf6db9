import itertools

import numpy as np
import pytest
from samples import odd_texts, prose
from pyspark.sql import functions as F

from sensorlab.llm import neardup
from sensorlab.llm.common import components, maybe_in


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if union and 100 * common >= percent * union and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def family(n):
    """Copies with one or two edits: pairs on both sides of the threshold."""
    base = prose(7, 60).split()
    out = []
    for i in range(n):
        words = list(base)
        words[(i * 7) % 60] = f"edit{i}"
        if i % 3 == 0:
            words[(i * 11 + 5) % 60] = f"more{i}"
        out.append(" ".join(words))
    return out

@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
@pytest.mark.parametrize("block", [400_000, 3_000])
def test_equals_all_pairs(spark, documents, monkeypatch, size, percent, block):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)  # small blocks: pivots and the pass across buckets
    texts = dict(enumerate([*odd_texts(), *family(25), *(prose(100 + i, 40) for i in range(10)), prose(3, 50), prose(3, 50) + " tail"]))
    rows = documents(list(texts.items()))
    assert found(neardup.near_duplicates(rows, size=size, percent=percent)) == brute(texts, size, percent)


def test_null_ids_repeated_rows_and_clashing_columns(documents, clashing):
    text = prose(5, 50)
    df = clashing(documents([(3, text), (3, text), (None, text), (None, None), (1, text + " end"), (9, "other words here")]))
    rows = neardup.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None) == [(1, 1), (3, 1), (9, 9)]
    assert sum(r["doc_id"] is None and r["component_id"] is None and r["kept"] for r in rows) == 2
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "9", "None", "None"]


def test_empty_table(documents):
    assert neardup.near_duplicates(documents([])).count() == 0
    assert neardup.keep_one(documents([])).count() == 0


def test_bands_miss_rarely():
    for percent in (80, 85):
        assert (1 - (percent / 100) ** neardup.ROWS) ** neardup.bands_for(percent) <= neardup.MISS


def test_circulant_coordinates_agree_as_often_as_the_sets():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1300).astype(np.uint64)
    a, b = np.sort(x[:1000]), np.sort(x[300:])
    sketch = neardup.circulant_minhash(np.concatenate([a, b]), np.array([1000, 2000]), 1024)
    assert abs((sketch[0] == sketch[1]).mean() - 700 / 1300) < 0.06


def test_components_of_a_long_path_and_a_star(spark):
    edges = spark.range(60).select((F.col("id") * 7 % 61).alias("a"), ((F.col("id") + 1) * 7 % 61).alias("b"))
    star = spark.range(200).select((F.col("id") + 1000).alias("a"), F.lit(5000).cast("long").alias("b"))
    got = {r["id"]: r["component"] for r in components(edges.union(star).union(spark.sql("select 77L, 77L"))).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 61 + 201


def test_bit_map_keeps_all_wanted(spark):
    ids = spark.range(0, 1000, 7).toDF("i")
    kept = maybe_in(spark.range(1000).withColumn("x", F.lit(1)), "id", ids, bits=10)
    assert kept.columns == ["id", "x"] and kept.join(ids, F.col("id") == F.col("i")).count() == ids.count()
    assert maybe_in(spark.range(1000), "id", ids).count() < 200


def test_linked_roots_on_boundary():
    sets = [np.arange(85), np.arange(100), np.arange(84)]  # 85/100 is linked, 84/100 isn't, 84/85 is
    flat = np.concatenate(sets).astype(np.uint64)
    assert neardup.linked_roots(flat, np.cumsum([85, 100, 84]), 85).tolist() == [0, 0, 0]
    assert neardup.linked_roots(np.concatenate(sets[1:]).astype(np.uint64), np.array([100, 184]), 85).tolist() == [0, 1]
