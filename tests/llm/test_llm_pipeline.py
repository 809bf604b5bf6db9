"""Stages of the corpus pipeline, each against plain loops over its own input, and the whole run."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from samples import prose
from test_llm_text_filters import brute_leaks

import corpus_pipeline
from sensorlab.llm import toxicity, weaklabel
from sensorlab.llm.tokens import encoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of 300 documents: prose, toxic ones, junk, copies, passages of the benchmark, nulls."""
    rng = random.Random(1)
    items = {i: prose(900 + i, 20 + i) for i in range(5)}
    texts = [prose(i, 60) for i in range(200)]
    toxic = {}
    for i in range(0, 60, 2):
        words = texts[i].split()
        words[rng.randrange(60)] = rng.choice(["worthless", "pathetic", "disgusting"])
        texts[i], toxic[i] = " ".join(words), 1
    texts += ["### *** %%% " * 30 + str(i) for i in range(20)]
    texts += [texts[100 + i] for i in range(20)] + [texts[120 + i] + " more" for i in range(20)]
    texts += [prose(400 + i, 30) + " " + items[i % 5] + " " + prose(500 + i, 30) for i in range(15)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(None, prose(7000, 50), "en", None, 9), (800, None, None, "src0", None), (801, "", "en", "src1", 0), (5, texts[5], "en", "src2", 1)]
    place = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    labels = [(i, 1, toxic.get(i, 0)) for i in range(180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place), items, toxic


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    place = folder[0]
    docs = spark.read.parquet(f"{place}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        target = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, place).write.parquet(target)
        after = spark.read.parquet(target)
        out[name] = docs, after
        docs = after
    return out


def test_stages_are_in_order_and_keep_the_columns(stages):
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns == COLUMNS
            kept = rows_of(after)
            everything = rows_of(before)
            assert all(kept.count(r) <= everything.count(r) for r in set(kept)) and 0 < len(kept) <= len(everything)


def test_toxicity_stage(spark, folder, stages):
    """A document stays if its score alone, text by text, is below a half."""
    before, after = stages["toxicity"]
    _, scores = toxicity.fit_toxicity(before, spark.read.parquet(f"{folder[0]}/labels.parquet"))
    wanted = [r for r in rows_of(before) if scores(pa.array([r[1]], pa.string()))[0] < 0.5]
    assert rows_of(after) == wanted
    kept = {r[0] for r in wanted}
    caught = [i for i in folder[2] if i not in kept]
    assert len(caught) >= 0.9 * len(folder[2]) and len(wanted) >= len(rows_of(before)) - len(caught) - 3


def test_quality_stage(stages):
    before, after = stages["quality"]
    _, scores = weaklabel.fit_quality(before)
    assert rows_of(after) == [r for r in rows_of(before) if scores(pa.array([r[1]], pa.string()))[0] >= 0.5]
    assert not any("%%%" in (r[1] or "") for r in rows_of(after))


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} if words else set()


def test_near_duplicate_stage(stages):
    """Groups by comparing all pairs; the least id of each stays."""
    before, after = stages["near_duplicates"]
    texts = {}
    for r in sorted(rows_of(before), key=str):
        if r[0] is not None:
            texts.setdefault(r[0], shingles(r[1]))
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = texts[i], texts[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    assert {r[0] for r in rows_of(after) if r[0] is not None} == {i for i in ids if find(i) == i}
    assert len(ids) - len({find(i) for i in ids}) >= 30


def test_decontamination_stage(folder, stages):
    before, after = stages["decontamination"]
    texts = {r[0]: r[1] for r in rows_of(before) if r[0] is not None}
    leaks = {d for d, _ in brute_leaks(texts, folder[1])}
    assert rows_of(after) == [r for r in rows_of(before) if r[0] not in leaks] and len(leaks) >= 10


def test_packing_stage(stages):
    """Every id of every document is in one piece; sequences have no gaps."""
    before, after = stages["packing"]
    coder, want = encoder(corpus_pipeline.TOKENIZER), defaultdict(list)
    for r in rows_of(before):
        ids, _ = coder.encode_all(pa.array([r[1]], pa.string()))
        want[r[0]].append([*ids.tolist(), 0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in after.collect():
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for doc, found in pieces.items():
        joined = [i for _, ids in sorted(found) for i in ids]
        assert sorted(joined) == sorted(i for ids in want[doc] for i in ids)
        if len(want[doc]) == 1:
            assert joined == want[doc][0]
    for number, found in sequences.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == 1024 or number == max(sequences)


def test_run_is_the_stages_one_after_another(spark, folder, stages):
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    run = corpus_pipeline.run(spark, folder[0])
    key = lambda df: sorted((tuple(r) for r in df.select("doc_id", "start", "length", "doc_tokens").collect()), key=str)
    done = stages["packing"][1]
    assert set(names) <= set(run.columns)
    assert sum(r[2] for r in key(run)) == sum(r[2] for r in key(done))
    assert {r[0] for r in key(run)} == {r[0] for r in key(done)}


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns(spark, folder, clashing):
    docs = clashing(spark.read.parquet(f"{folder[0]}/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns, name
