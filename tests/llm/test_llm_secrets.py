import hashlib
import itertools
import random
import re
import string

import numpy as np
import pytest
from samples import odd_texts, prose

from sensorlab.llm.secrets import KINDS, SYMBOLS, _symbols, find_secrets, infer, learn, secret_digests


def by_rules(text):
    """The rules, written from their definition."""
    text = text or ""
    name = "(?:%s)" % "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
    found = []
    for m in re.finditer(name + "[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        found += [(m.start(), 0, m.end())] * (len(m[1]) >= 12)
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(found)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def token(rng, n=36, alphabet=string.ascii_letters + string.digits):
    return "".join(rng.choice(alphabet) for _ in range(n))


def corpus(rng, n=200):
    """Prose; in every text one labelled credential of a format with a fixed beginning."""
    return [f"{prose(i, 40)} token = \"ghp-{token(rng)}\" {prose(i + 1000, 40)}" for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_rules_on_random_texts(documents, seed):
    rng = random.Random(seed)
    parts = ["password", "PassWD", "secret", "Token", "api_key", "apikey", "API_KEY", "paßword", "toKen", "=", ":", " ", '"', "'", "  ", "é", "😀", "AKIA", "AKIAAKIA"]
    parts += ["0123456789abcdef", "deadbeef", "ABCDEF0123456789", "abc", "a1b2c3d4e5f6", "Zx+/_.=-", "\n", "secret=token=abcdefghijkl", "password: secret : abcdefghijklmnop"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(200)]
    rows = {r["doc_id"]: r for r in secret_digests(find_secrets(documents(texts))).collect()}
    for i, text in enumerate(texts):
        want = by_rules(text)
        assert [rows[i][f"n_{k}"] for k in KINDS] == [sum(s[1] == j for s in want) for j in range(3)]
        assert rows[i]["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(filter(None, joined(want).split(","))) <= set(rows[i]["spans"].split(","))


def test_learned_format_is_found_without_its_label(documents):
    rng = random.Random(1)
    texts = corpus(rng)
    bare = [f"{prose(9000 + i, 30)} ghp-{token(rng)} {prose(i, 30)}" for i in range(4)]
    clean = [prose(5000 + i, 60) + " unterschiedlichkeiten 2024-01-01T12:30:00 www.example.org/some/long-path/index.html +49170123456789" for i in range(30)]
    rows = {r["doc_id"]: r["spans"] for r in find_secrets(documents(texts + bare + clean)).collect()}
    for i, text in enumerate(bare):
        start = text.index("ghp-")
        assert [(s["start"], s["end"], s["base"]) for s in rows[200 + i]] == [(start, start + 40, False)]
    assert not any(rows[204 + i] for i in range(30))
    assert all([s["base"] for s in rows[i]] == [True] for i in range(200))


def test_probabilities_sum_to_one():
    """Over all strings: ends and steps of every state, and, summed out, the first lengths of a small language."""
    rng = random.Random(2)
    automaton = infer([_symbols("A" + token(rng, rng.randrange(1, 9), "bc")) for _ in range(300)])
    p, end = np.exp2(automaton.bits), np.exp2(automaton.end)
    assert np.allclose(p[:, 1:].sum(axis=1) + end, 1)
    weight, total = np.zeros(len(end)), 0.0
    weight[0] = 1
    for _ in range(400):
        total += (weight * end).sum()
        moved = np.zeros_like(weight)
        for s in range(1, SYMBOLS):
            np.add.at(moved, automaton.step[:, s], weight * p[:, s])
        weight = moved
    assert total == pytest.approx(1, abs=1e-6)


def test_score_is_the_product_of_steps():
    rng = random.Random(3)
    values = ["AK" + token(rng, 6, "XYZ") for _ in range(200)]
    automaton = infer([_symbols(v) for v in values])
    tried = ["AKXYZXYZ", "AK", "XYZ", "", "q" * 500, "AKXXXXXXqX"]
    text = np.concatenate([[0], *(np.append(_symbols(v), 0) for v in tried)]).astype(np.uint8)
    ends = np.cumsum([len(v) + 1 for v in tried])
    got = automaton.score(text, ends - np.array([len(v) for v in tried]), ends)
    for value, score in zip(tried, got, strict=True):
        state, want = 0, 0.0
        for s in _symbols(value):
            want += automaton.bits[state, s]
            state = automaton.step[state, s]
        assert score == pytest.approx(want + automaton.end[state])
    assert got[0] > got[5]


def test_merging_finds_the_states_of_a_format():
    """Two fixed characters, then any number of digits: three states; strings of the language outweigh others by far."""
    rng = random.Random(4)
    automaton = infer([_symbols("Qz" + token(rng, 8 + min(int(rng.expovariate(0.2)), 20), "0123456789")) for _ in range(1500)])
    assert 3 <= len(automaton.step) <= 6
    assert len(set(automaton.step[0].tolist())) == 1
    text = np.concatenate([[0], _symbols("Qz4821990317"), [0], _symbols("48219903Qz17"), [0]]).astype(np.uint8)
    a, b = automaton.score(text, np.array([1, 14]), np.array([13, 26]))
    assert a > b + 20


def test_learning_does_not_depend_on_order_or_partitions(spark):
    rng = random.Random(5)
    texts = corpus(rng, 150) * 3
    models = []
    for rows, n in ((texts, 3), (texts[::-1], 11)):
        models.append(learn(spark.createDataFrame([(t,) for t in rows], "t string").repartition(n)))
    (a, least), (b, other) = models[0].automata[0], models[1].automata[0]
    assert least == pytest.approx(other) and (a.step == b.step).all() and np.allclose(a.bits, b.bits)


def test_odd_texts(documents, clashing):
    rng = random.Random(6)
    long = prose(3, 30_000) + " x" * 3 + "a" * 200_000 + " AKIA" + "B" * 5_000
    texts = [*odd_texts(), *corpus(rng, 40), long, "password=" + "k" * 100_000, "Schlüssel 😀 token: 'Aé'"]
    df = clashing(documents(texts + [(None, texts[-3]), (3, "again")]))
    rows = secret_digests(find_secrets(df)).collect()
    assert len(rows) == len(texts) + 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert sorted(r["base_sha256"] for r in rows) == sorted(hashlib.sha256(joined(by_rules(t)).encode()).hexdigest() for t in [*texts, texts[-3], "again"])


def test_no_rows(documents):
    assert secret_digests(find_secrets(documents([]))).count() == 0
    assert secret_digests(find_secrets(documents([None, ""]))).filter("spans = ''").count() == 2


def test_findings_do_not_overlap(documents):
    rng = random.Random(7)
    texts = corpus(rng) + [f"ghp-{token(rng)}.ghp-{token(rng)} {prose(i, 9)}" for i in range(20)]
    for row in find_secrets(documents(texts)).collect():
        spans = [s for s in row["spans"] if not s["base"]]
        assert all(a["end"] <= b["start"] for a, b in itertools.pairwise(spans))
