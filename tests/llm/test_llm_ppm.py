"""The byte model across words: against the definition, word order, blocks and batches of any size."""

import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import odd_texts, prose

from sensorlab.llm import ppm, queries

HIGH = 5  # bytes of context, as the operator's documentation says
SYMBOLS = [*range(254), "end"]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()


class Definition:
    """PPM by its definition: counts after every context of up to HIGH symbols, method D, exclusion."""

    def __init__(self, texts):
        self.after = {}
        for text in texts:
            symbols = ["start"] * HIGH + list(text) + ["end"]
            for k in range(HIGH, len(symbols)):
                for size in range(HIGH + 1):
                    self.after.setdefault(tuple(symbols[k - size : k]), Counter())[symbols[k]] += 1

    def share(self, history, symbol):
        share, excluded = 1.0, set()
        for size in range(HIGH, -1, -1):
            seen = self.after.get(tuple(history[len(history) - size :]), {})
            open_ = {s: c for s, c in seen.items() if s not in excluded}
            total = sum(open_.values())
            if symbol in open_:
                return share * (2 * open_[symbol] - 1) / (2 * total)
            if open_:
                share *= len(open_) / (2 * total)
                excluded |= set(open_)
        return share / (len(SYMBOLS) - len(excluded))

    def score(self, text):
        symbols = ["start"] * HIGH + list(text) + ["end"]
        return sum(math.log10(self.share(symbols[k - HIGH : k], symbols[k])) for k in range(HIGH, len(symbols)))


def trains(i):
    return zlib.crc32(str(i).encode()) % 7 != 2


def shuffled(text, seed):
    words = text.split(" ")
    random.Random(seed).shuffle(words)
    return " ".join(words)


@pytest.mark.parametrize("small", ["", "entries", "bytes"])
def test_scores_equal_the_definition(documents, clashing, monkeypatch, small):
    if small == "bytes":  # several blocks a task, by size
        monkeypatch.setattr(ppm, "BLOCK_BYTES", 500)
        monkeypatch.setattr(ppm, "BUNDLE", 1)
    if small == "entries":  # several blocks a task, windows that end inside texts, a batch at a time
        for name, value in {"BLOCK_ENTRIES": 60, "BUCKETS": 7, "BUNDLE": 1, "WINDOW": 13, "SLICE": 2}.items():
            monkeypatch.setattr(ppm, name, value)
    texts = dict(enumerate([t for t in odd_texts() if len(t or "") < 3_000] + [prose(i, 20) for i in range(40)] + [" a  b", "a\n\nb ", "\t", "A b A b"]))
    rows = ppm.score_bytes(clashing(documents(list(texts.items()))).repartition(3)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    model = Definition([lowered(t) for i, t in texts.items() if trains(i)])
    words = {i: [*lowered(t).split(), None] for i, t in texts.items()}  # bytes are cut at the six characters only
    count = Counter(w for i in texts if trains(i) for w in words[i])
    n, v = sum(count.values()), len(count)
    for r in rows:
        i = r["doc_id"]
        assert r["held_out"] == (not trains(i))
        assert r["score"] == pytest.approx(model.score(lowered(texts[i])), rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words[i]), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words[i]), sum(count[w] > 0 for w in words[i]), n)


def test_definition_sums_to_one():
    model = Definition([lowered(prose(i, 8)) for i in range(5)])
    for history in (["start"] * HIGH, list(b"n the"), list(b"zz th"), list(b"\x00\x01\x02\x03\x04")):
        assert sum(model.share(history, s) for s in SYMBOLS) == pytest.approx(1.0, rel=1e-9)


def test_word_order_counts(spark, tmp_path):
    held = [i for i in range(2_000) if not trains(i)]
    taught = [i for i in range(2_000) if trains(i)]
    rows = []
    for k in range(40):
        text = prose(k, 30)
        rows += [(taught[k], text), (held[2 * k], text), (held[2 * k + 1], shuffled(text, k))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    score = {r["doc_id"]: r["score"] for r in queries.op4_byte_ppm(spark, str(tmp_path)).collect()}
    pairs = [(score[held[2 * k]], score[held[2 * k + 1]]) for k in range(40)]
    assert sum(straight > mixed for straight, mixed in pairs) == 40


def test_few_rows(documents):
    assert ppm.score_bytes(documents([])).count() == 0
    rows = ppm.score_bytes(documents([(None, "no id"), (5, "a b"), (5, "a b"), (6, None)])).collect()
    assert len(rows) == 4 and all(r["score"] < 0 for r in rows)
    none = ppm.score_bytes(documents(["a b", "", None]), held=F.lit(True)).collect()
    assert [(r["train_tokens"], r["n_known"]) for r in none] == [(0, 0)] * 3
    assert sorted(r["score"] for r in none) == pytest.approx(sorted([-4 * math.log10(255), -math.log10(255), -math.log10(255)]))


def test_pieces_are_runs_of_equal_keys():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2, 2]), pa.array([0, 1, 1, 1, 1])], ["a", "b"])
    more = pa.RecordBatch.from_arrays([pa.array([2, 3]), pa.array([1, 1])], ["a", "b"])
    sizes = [len(p) for p in ppm.pieces(iter([batch, batch.slice(0, 0), more]), ["a", "b"])]
    assert sizes == [1, 1, 4, 1]
    assert [len(p) for p in ppm.pieces(iter([batch, more]), ["a", "b"], 1)] == [1, 1, 3, 1, 1]
