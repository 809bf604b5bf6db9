import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sensorlab.llm import trie
from sensorlab.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, rebuild=True):
    """Every beginning in a dictionary, by the definition."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        base = {c: c - (c % 20 if c >= 0 else -(-c % 20)) for c in convs}
        convs = {c: convs.get(base[c], [])[: h[c]] + convs[c][h[c] :] for c in convs}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        m = members[path]
        words = len(WORD.findall(path[-1][1])) if path else 0
        out[path] = [m[0], len(path), members[path[:-1]][0] if path else None, len(m), 0, 0, (len(m) - 1) * words, ",".join(map(str, ends[path]))]
    for path in sorted(members, key=len, reverse=True):
        node = out[path]
        node[5] = node[5] or 1
        if path:
            up = out[path[:-1]]
            up[4] += 1
            up[5] += node[5]
            up[6] += node[6]
    return sorted((*n[:7], hashlib.sha256(n[7].encode()).hexdigest()) for n in out.values())


def nodes(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: (r[0], r[1]))


def check(spark, rows, rebuild=True, shards=7):
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        got = nodes(prefix_trie(spark.createDataFrame(rows, SCHEMA), group=20 if rebuild else None))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == brute(rows, rebuild)


def random_rows(seed, convs=60, choices=3, longest=6):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), " ".join(["w"] * rng.randrange(choices))) for c in range(-25, convs) for t in range(rng.randrange(longest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 2, 13])
@pytest.mark.parametrize("rebuild", [True, False])
def test_equals_brute_force(spark, shards, rebuild):
    check(spark, random_rows(shards), rebuild, shards)


def test_copies_over_many_shards(spark):
    """A third of all rows are one conversation, which goes on in some and ends in others."""
    rows = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(3)]
    rows += [(c, t, "user", f"turn {t}") for c in range(40, 60) for t in range(5 if c % 2 else 3)]
    rows += [(c, 0, "user", f"other {c}") for c in range(60, 70)]
    check(spark, rows, False, 16)
    check(spark, rows, True, 16)


def test_long_conversations_span_column_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "COLUMNS", 4)
    rows = [(c, t, "user", f"t {t if t < 5 * c else -c}") for c in range(12) for t in range(3 * c + 1)]
    rows += [(100, t, "user", f"t {t}") for t in range(300)]
    check(spark, rows, False, 5)


def test_odd_rows(spark, clashing):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (1, 3, "a", "1:b"), (2, 0, "a1:", "b"), (None, 0, "user", "x"), (3, 5, "user", " \t ")]
    rows += [(4, 0, "user", "é 漢字 😀" + " long" * 50_000), (24, 0, "user", "é 漢字 😀" + " long" * 50_000), (20, 1, "s", "q"), (20, None, "s", "r")]
    for rebuild in (True, False):
        check(spark, rows, rebuild)
    df = clashing(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("_row", "shard")
    assert nodes(prefix_trie(df)) == brute(rows)


def test_null_role_and_text_equal_empty_ones(spark):
    rows = [(1, 0, None, None), (2, 0, "", ""), (3, 0, "", None)]
    check(spark, rows, False)
    assert prefix_trie(spark.createDataFrame(rows, SCHEMA), group=None).filter("depth = 1").first()["n_convs"] == 3


def test_turnless_conversations(spark):
    """Own turns are dropped before h; with no first conversation of the group nothing replaces them."""
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 20)}
    rows = [(c, 0, "user", "x") for c in range(1, 20)]
    assert any(h.values())
    check(spark, rows)
    root = prefix_trie(spark.createDataFrame(rows, SCHEMA)).filter("depth = 0").first()
    assert root["n_convs"] == 19


def test_no_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 0, "a", "b")], SCHEMA)).count() == 0
