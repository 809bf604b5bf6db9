"""Decontamination, quality, toxicity, licences."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import odd_texts, prose

from sensorlab.llm import decontaminate, licenses, toxicity, weaklabel
from sensorlab.llm.common import hash_share

BENCH = "item_id long, text string"


def leak_pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def longest_by_trying(a, b, percent=80):
    """Length and matches of the longest aligned stretch of two rows of words, all beginnings and ends tried; ties the first."""
    same = [x == y for x, y in zip(a, b, strict=True)]
    best = (0, 0)
    for i in range(len(same)):
        for j in range(i + 1, len(same) + 1):
            n = sum(same[i:j])
            if same[i] and same[j - 1] and 100 * n >= percent * (j - i) and j - i > best[0]:
                best = (j - i, n)
    return best


def plain(text):
    return [w.strip(".!").lower() for w in (text or "").split()]


def brute_leaks(texts, items, least=13):
    """Every shift of every item along every text."""
    want = {}
    for d, text in texts.items():
        for i, item in items.items():
            a, b = plain(text), plain(item)
            longest = (0, 0)
            for shift in range(-len(b) + 1, len(a)):
                low, high = max(0, -shift), min(len(b), len(a) - shift)
                if sum(x == y for x, y in zip(a[low + shift : high + shift], b[low:high], strict=True)):
                    longest = max(longest, longest_by_trying(a[low + shift : high + shift], b[low:high]))
            if b and longest[0] >= min(least, len(b)):
                want[d, i] = longest
    return want


def test_leaks_equal_brute_force(spark, documents):
    items = {i: prose(500 + i, 15 + 3 * i) for i in range(8)} | {20: prose(600, 7), 21: "only four words here", 22: "unheard-of", 23: "two here"}
    texts = {}
    rng = random.Random(1)
    for i in range(8):
        words = items[i].split()
        for _ in range(i):  # substitutions, more with each item
            words[rng.randrange(len(words))] = "other"
        texts[i] = prose(i, 40) + " " + " ".join(words).upper() + "! " + prose(50 + i, 40)
        texts[100 + i] = " ".join(items[i].split()[: 9 + i])
    texts |= {30: "x " + items[20] + " y", 31: "only four words here", 32: "ta unheard-of re", **{200 + i: t for i, t in enumerate(odd_texts())}}
    short = {d: t for d, t in texts.items() if len(t or "") < 5_000}
    found = decontaminate.find_leaks(documents(list(texts.items())), spark.createDataFrame(list(items.items()), BENCH)).collect()
    got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["n_matches"]) for r in found if r["doc_id"] in short}
    assert got == brute_leaks(short, items) and len(got) > 12


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 11, 12, 13])
def test_no_pattern_of_substitutions_escapes(spark, documents, n):
    """All ways to replace a fifth of the words of a short item."""
    words = [f"w{n}x{i}" for i in range(n)]
    texts = []
    for places in itertools.combinations(range(n), n // 5):
        copy = list(words)
        for p in places:
            copy[p] = f"other{p}"
        texts.append("before it " + " ".join(copy) + " behind it")
    found = decontaminate.find_leaks(documents(texts), spark.createDataFrame([(1, " ".join(words))], BENCH)).collect()
    # A substitution at an end shortens the overlap: then the item isn't there as a whole.
    whole = {i for i, t in enumerate(texts) if longest_by_trying(t.split()[2:-2], words)[0] >= min(13, n)}
    assert {r["doc_id"] for r in found} == whole and len(whole) > 0


def test_sampled_substitutions_of_longer_items(spark, documents):
    rng = random.Random(4)
    items = {n: " ".join(f"i{n}w{k}" for k in range(n)) for n in range(14, 41)}
    texts = []
    for n, item in items.items():
        for _ in range(12):
            copy = item.split()
            for p in rng.sample(range(n), n // 5):
                copy[p] = "other"
            texts.append((len(texts), " ".join(copy)))
    want = {(d, n) for d, t in texts for n in [int(next(w for w in t.split() if w != "other").split("w")[0][1:])] if longest_by_trying(t.split(), items[n].split())[0] >= 13}
    found = decontaminate.find_leaks(documents(texts), spark.createDataFrame(list(items.items()), BENCH)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(want) > 250


def test_a_long_item_and_a_repetitive_one(spark, documents):
    """20,000 words, every tenth replaced; and one word repeated, which hits at all shifts."""
    rng = random.Random(5)
    item = [f"v{rng.randrange(5_000)}" for _ in range(20_000)]
    copy = [w if i % 10 else "other" for i, w in enumerate(item)]
    docs = documents([(1, "x " * 50 + " ".join(copy)), (2, "ta " * 3_000), (3, "clean")])
    rows = decontaminate.find_leaks(docs, spark.createDataFrame([(1, " ".join(item)), (2, "ta " * 400)], BENCH)).collect()
    found = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], r["n_matches"]) for r in rows}
    assert found == {(1, 1): (51, 19_999, 18_000), (2, 2): (0, 400, 400)}


def test_longest_overlap_is_the_longest():
    rng = np.random.default_rng(3)
    for _ in range(300):
        same = rng.random(rng.integers(1, 40)) < rng.choice([0.3, 0.7, 0.85])
        a, b = np.ones(len(same)), np.where(same, 1, 0)
        start, n, matches = decontaminate.longest_overlap(a, b, 80)
        assert (n, matches) == longest_by_trying(a.tolist(), b.tolist())
        assert n == 0 or (same[start] and same[start + n - 1] and same[start : start + n].sum() == matches)


def test_leaks_of_odd_tables(spark, documents, clashing):
    item = prose(9, 20)
    bench = clashing(spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, "")], BENCH))
    docs = clashing(documents([(5, item), (5, item), (None, item), (6, None), (7, "clean text")]))
    assert leak_pairs(decontaminate.find_leaks(docs, bench)) == {(5, 1)}
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["6", "7", "None"]
    assert decontaminate.find_leaks(documents([]), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def junk(i):
    kind, rng = i % 4, random.Random(i)
    words = prose(i, 60).split()
    if kind == 0:
        return " ".join(w + rng.choice(["***", "###", "%%%"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " | ".join(a.strip(".") + b.strip(".") + "stqua" for a, b in zip(words[::2], words[1::2], strict=True))  # cells hold long words
    return " ".join([w for w in words[:6] for _ in range(12)])


def test_quality_tells_junk_from_prose_without_labels(documents):
    texts = [junk(i) for i in range(60)] + [prose(1000 + i, 5 + 3 * i).capitalize() + "." for i in range(140)]
    rows = {r["doc_id"]: r for r in weaklabel.score_quality(documents(texts)).collect()}
    wrong = sum(rows[i]["predicted"] != (i >= 60) for i in range(200))
    assert wrong <= 4
    assert all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows.values())
    kept = weaklabel.keep_good(documents(texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["predicted"]}


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = (rng.random(20_000) < 0.7).astype(int)
    right = [0.95, 0.9, 0.8, 0.7]
    votes = np.column_stack([np.where(rng.random(20_000) < p, truth, 1 - truth) for p in right])
    votes[rng.random(votes.shape) < 0.2] = weaklabel.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, says = weaklabel.estimate(patterns, counts)
    assert np.abs(says[1, :, 1] - right).max() < 0.03
    index = (patterns[None] == votes[:, None]).all(axis=2).argmax(axis=1)
    assert ((posterior[index] >= 0.5) == truth).mean() > 0.93


@pytest.mark.parametrize("texts", [[], [None], odd_texts()])
def test_quality_of_odd_tables(documents, clashing, texts):
    rows = clashing(documents([*texts, *([(None, "a row without id")] if texts else [])]))
    assert weaklabel.score_quality(rows).count() == rows.count()
    assert weaklabel.keep_good(rows).columns == rows.columns
    weaklabel.keep_good(rows).collect()


def test_votes_ignore_order_of_batch():
    texts = odd_texts()
    one = np.vstack([weaklabel.votes(pa.array([t], pa.string())) for t in texts])
    assert (weaklabel.votes(pa.array(texts, pa.string())) == one).all()


def edits(word):
    yield from (word[:i] + word[i + 1 :] for i in range(len(word)))
    yield from (word[:i] + c + word[i + k :] for i in range(len(word) + 1) for c in "abtz" for k in (0, 1) if i + k <= len(word))


def test_automaton_equals_edit_distance():
    terms = {"stupid": (3.0, False), "moron": (2.0, False), "tras": (4.0, True), "bad": (1.0, False)}
    lexicon = toxicity.Lexicon(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    words = {w for t in ("stupid", "moron", "trash", "bad", "tra") for e in edits(t) for w in (t, e, *list(edits(e))[::9])}
    for word in words:
        weight, kind = lexicon.look_up(word)
        exact = [w for t, (w, open_) in terms.items() if word == t or open_ and word.startswith(t)]
        near = [w for t, (w, open_) in terms.items() if not open_ and len(t) >= toxicity.FUZZY_FROM and distance(word, t) == 1]
        assert (weight, kind) == ((max(exact), 1) if exact else (max(near), 2) if near else (0.0, 0)), word


@pytest.fixture
def labelled(spark, documents):
    rng, rows = random.Random(4), []
    for i in range(400):
        words = prose(3000 + i, 40).split()
        if i % 4 == 0:
            for w in rng.sample(["stupid", "moron", "wretch", "filth"], 2):
                words.insert(rng.randrange(40), w)
        elif i % 40 == 1:  # quoted, not meant
            words.insert(20, '"stupid"')
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    return documents(rows), labels


def test_toxicity_learns_from_training_labels_only(spark, documents, labelled):
    docs, labels = labelled
    more = documents([(900, "ta re stupd mi"), (901, "ta re mi so"), (902, 'ta "stupid" mi'), (903, "you stupid moron")])
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(docs.union(more), labels).collect()}
    held = [r for i, r in rows.items() if i < 400 and r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.97
    assert rows[903]["score"] > rows[902]["score"] and rows[901]["predicted"] == 0 and rows[900]["score"] >= rows[901]["score"]
    lied = labels.withColumn("toxic", (toxicity.held_out("doc_id") != (labels.toxic == 1)).cast("int"))
    lied = labels.filter(~toxicity.held_out("doc_id")).unionByName(lied.filter(toxicity.held_out("doc_id")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.union(more), lied).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in rows.items())


def test_toxicity_of_odd_tables(spark, documents, labelled, clashing):
    docs, labels = labelled
    odd = clashing(docs.union(documents([(1000 + i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (1000, None)])))
    nulls = clashing(labels.union(spark.createDataFrame([(1, None, None), (None, 1, 1)], labels.schema)))
    assert toxicity.score_toxicity(odd, nulls).count() == odd.count()
    kept = toxicity.drop_toxic(odd, nulls)
    assert kept.columns == odd.columns and 290 < kept.count() < 320
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r["predicted"] for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    assert toxicity.score_toxicity(documents([]), labels).count() == 0


def test_licences_equal_brute_force(documents):
    texts = [*odd_texts(), *(f"{prose(i, i)} {t} {prose(90 + i, 60)}" for i, t in enumerate(licenses.NOTICES.values()))]
    broken = licenses.NOTICES["GPL-3.0 header"].split()
    texts += [" ".join(broken[:-3]), " ".join(broken[:10]), licenses.NOTICES["MIT"].upper() + " and " + licenses.NOTICES["MIT"]]

    def grams(text):
        words = [w.strip(licenses_marks).lower() for w in (text or "").split()]
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    licenses_marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    want = {(d, n) for d, t in enumerate(texts) for n, s in licenses.NOTICES.items() if len(grams(t) & grams(s)) >= 0.8 * len(grams(s))}
    rows = licenses.scan_licenses(documents(texts)).collect()
    assert {(r["doc_id"], r["license"]) for r in rows} == want and len(want) >= 10
    for r in rows:
        part = " ".join(texts[r["doc_id"]].split()[r["start"] : r["start"] + r["n_words"]])
        assert len(grams(part) & grams(licenses.NOTICES[r["license"]])) >= 0.8 * len(grams(licenses.NOTICES[r["license"]]))


def test_licences_of_odd_tables(documents, clashing):
    text = licenses.NOTICES["MIT"]
    rows = licenses.scan_licenses(clashing(documents([(1, text), (1, text), (None, text), (2, None)]))).collect()
    assert [(r["doc_id"], r["start"], r["containment"]) for r in sorted(rows, key=lambda r: r["doc_id"] or 0)] == [(None, 0, 1.0), (1, 0, 1.0), (1, 0, 1.0)]
    assert licenses.scan_licenses(documents([])).count() == 0
    assert licenses.scan_licenses(documents([text]), notices={"none": "", "null": None}).count() == 0


@pytest.mark.parametrize("total", [10, 10**4, 10**10, 10**15])
def test_samples_of_any_share(spark, total):
    """Of 10^10 and more rows a few thousand are one in millions: the share is as fine as the hash."""
    spark_rows = 200_000
    wanted = 8_000
    share = min(1.0, wanted / total)
    expected = spark_rows * share
    n = spark.range(spark_rows).filter(hash_share(F.col("id"), wanted, total)).count()
    assert abs(n - expected) <= 5 * max(expected, 1) ** 0.5
    if total > wanted:
        text = hash_share(F.col("id"), wanted, total)._jc.toString()
        assert str(-(2**63) + (wanted << 64) // total) in text and (wanted << 64) // total >= 2**64 * 8_000 // 10**15


def test_lexicon_forgets_states(monkeypatch):
    lexicon = toxicity.Lexicon({"worthless": (3.0, False), "clown": (2.0, True)})
    words = ["".join(random.Random(i).choices("worthlescln", k=9)) for i in range(300)] + ["worthles", "clowns", "wortless"]
    whole = [lexicon.look_up(w) for w in words]
    monkeypatch.setattr(toxicity, "STATES", 5)
    assert [lexicon.look_up(w) for w in words] == whole and len(lexicon._states) < 60
    assert whole[-3:] == [(3.0, 2), (2.0, 1), (3.0, 2)]


def one_edit(a, b):
    """Whether one word comes from the other by at most one insertion, deletion or substitution."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def test_terms_and_scores_by_brute_force(spark, documents):
    """Every term's counts, test and weight from plain loops; then hits of all words against all terms."""
    rng = random.Random(8)
    bad = ["worthless", "pathetic", "loser"]
    texts, toxic = [], {}
    for i in range(120):
        words = prose(i, 25).split()
        if i % 3 == 0:
            toxic[i] = 1
            words[rng.randrange(25)] = rng.choice(bad)
        else:
            toxic[i] = 0
        texts.append(" ".join(words))
    rows = spark.createDataFrame([(t, toxic[i]) for i, t in enumerate(texts)], "_text string, _toxic int")
    lexicon = toxicity.learn_lexicon(rows)
    n = {k: sum(v == k for v in toxic.values()) for k in (0, 1)}
    times = {}
    for i, text in enumerate(texts):
        words = {w.strip(".").lower() for w in text.split()}
        terms = words | {w[:k] + "*" for w in words for k in toxicity.BEGINNINGS if len(w) >= k}
        for term in terms:
            times.setdefault(term, [0, 0])[toxic[i]] += 1
    tested = {term: v for term, v in times.items() if v[1] >= toxicity.SUPPORT and len(term) >= 3}
    want = set()
    for term, (c, t) in tested.items():
        share = (t + c) / 120
        gain = t * np.log(t / (n[1] * share)) + (c * np.log(c / (n[0] * share)) if c else 0)
        weight = np.log((t + 0.5) / (n[1] + 1)) - np.log((c + 0.5) / (n[0] + 1))
        if 2 * gain >= 2 * np.log(len(tested)) + toxicity.MARGIN and weight >= 1.5:
            want.add(term)
    assert {t for t in lexicon.terms} <= {t.removesuffix("*") for t in want}
    assert set(bad) & {t for t in want} and all(lexicon.look_up(w)[1] for w in bad if w in want)
    words = [w[:k] + c + w[k + d :] for w in bad for k in range(len(w)) for c in ("", "x", w[k] + "y") for d in (0, 1)] + prose(1, 50).replace(".", "").split()
    for word in words:
        exact = [v for t, (v, is_open) in lexicon.terms.items() if word == t or (is_open and word.startswith(t))]
        near = [v for t, (v, is_open) in lexicon.terms.items() if not is_open and len(t) >= toxicity.FUZZY_FROM and one_edit(t, word)]
        assert lexicon.look_up(word)[1] == (1 if exact else 2 if near else 0), word


def test_expectation_maximisation_by_brute_force():
    """One round of the estimates of the labellers, from the definition, changes nothing at the end."""
    rng = np.random.default_rng(2)
    truth = rng.random(4_000) < 0.6
    accuracy = [0.9, 0.8, 0.7, 0.85]
    votes = np.stack([np.where(rng.random(4_000) < 0.3, 2, np.where(rng.random(4_000) < a, truth, ~truth)) for a in accuracy], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, says = weaklabel.estimate(patterns, counts)
    expected = np.zeros(len(patterns))
    for p, pattern in enumerate(patterns):
        good = bad = 1.0
        for j, vote in enumerate(pattern):
            good, bad = good * says[1, j, vote], bad * says[0, j, vote]
        w = (posterior * counts).sum()
        prior = (w + 1) / (counts.sum() + 2)
        expected[p] = good * prior / (good * prior + bad * (1 - prior))
    assert np.allclose(posterior, expected, atol=1e-6)
    found = posterior[[int(np.flatnonzero((patterns == v).all(axis=1))[0]) for v in votes]] >= 0.5
    assert (found == truth).mean() > 0.88
