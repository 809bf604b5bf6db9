"""Tokens, packing, chat windows, PPM, embeddings, pages."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import odd_texts, prose

from sensorlab.llm import chat, embeddings, html, packing, ppm
from sensorlab.llm.tokens import Encoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPACES = ["a  b", " lead", "trail ", "a \n b\n\n c", "x\t y  z　 w", "\r\n x\x0b y\x1c z\x85 q", "don't  we'll\n  go", "   ", "  a  b"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers_library(reference):
    texts = [*odd_texts(), *SPACES]
    coder = Encoder(PATH)
    for _ in range(2):  # the second time from the cache
        ids, ends = coder.encode_all(pa.array(texts, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert got == [e.ids for e in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoder(PATH) is encoder(PATH)


def unpacked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        held = out.setdefault(r["doc_id"], [])
        assert r["start"] == len(held)
        held.extend(ids)
    return out


@pytest.mark.parametrize("mixture", [None, {"src0": 0.5, "src1": 0.3}, {"src0": 0.0, "none": 0.4}])
@pytest.mark.parametrize("parts", [1, 5])
def test_packing_round_trip(documents, clashing, reference, mixture, parts):
    texts = [*odd_texts(), *(prose(i, 40 * i) for i in range(25))]
    rows = packing.pack(clashing(documents(texts)).repartition(parts), PATH, mixture).collect()
    want = {i: [*e.ids, 0] for i, e in enumerate(reference.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert unpacked(rows) == want and all(r["doc_tokens"] == len(want[r["doc_id"]]) for r in rows)
    at = 0
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert (r["sequence_id"], r["offset"]) == divmod(at, 1024)
        at += r["length"]
        assert r["offset"] + r["length"] <= 1024
    assert at == sum(map(len, want.values()))


def test_deficits_stay_below_a_few_units(documents, reference):
    """After any window a queue has been served its share, but for units that wait or were taken early."""
    texts = [prose(i, 400 if i % 7 else 4000) for i in range(90)]
    share = {"src0": 0.5, "src1": 0.3, "src2": 0.2}
    rows = packing.pack(documents(texts).repartition(4), PATH, share).collect()
    held, sizes = Counter(), Counter()
    for r in rows:
        held[r["sequence_id"], r["doc_id"] % 3] += r["length"]
        sizes[r["doc_id"] % 3] += r["length"]
    for source, part in enumerate(share.values()):
        served = 0
        for k in range(max(k for k, _ in held) + 1):
            served += held[k, source]
            # Until some queue is empty, which fills the windows of the others.
            if any(sum(held[j, q] for j in range(k + 1)) >= sizes[q] - 1024 for q in range(3)):
                break
            assert abs(served - part * 1024 * (k + 1)) <= 3 * 1024


def brute_schedule(units, place, window):
    """Windows filled one after another from a plain list."""
    todo, out = [list(u) for u in units], []
    while todo:
        room = window - place % window
        near = todo[: packing.LOOK]
        chosen = [u for u in near if u[2] <= room or u[3]] or near[:1]
        key, start, n, _ = unit = chosen[0]
        size = min(n, room)
        out.append((key, start, size, place))
        place += size
        if size < n:
            unit[1:3] = [start + size, n - size]
        else:
            todo.remove(unit)
    return out


@pytest.mark.parametrize("look", [1, 3, 64])
def test_schedule(monkeypatch, look):
    monkeypatch.setattr(packing, "LOOK", look)
    rng = np.random.default_rng(look)
    for _ in range(60):
        units = [(i, 0, int(rng.integers(1, 30)), bool(rng.random() < 0.2)) for i in range(rng.integers(0, 50))]
        place = int(rng.integers(0, 40))
        done = list(packing.schedule(units, place, 16))
        assert done == brute_schedule(units, place, 16)
        assert sum(d[2] for d in done) == sum(u[2] for u in units)
        at = place
        for _, _, size, where in done:
            assert where == at and where // 16 == (where + size - 1) // 16
            at += size


def test_documents_that_fit_are_seldom_cut(documents):
    rng = np.random.default_rng(3)
    texts = [prose(i, int(n)) for i, n in enumerate(rng.choice([40, 90, 200, 3000], 150))]
    rows = packing.pack(documents(texts).repartition(3), PATH).collect()
    pieces = Counter(r["doc_id"] for r in rows)
    fitting = {r["doc_id"] for r in rows if r["doc_tokens"] <= 1024}
    assert len(fitting) > 80 and sum(pieces[d] > 1 for d in fitting) <= 0.15 * len(fitting)
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 1024)


def test_packing_of_null_sources_repeated_rows_and_no_rows(documents):
    df = documents([(1, "same text"), (1, "same text"), (None, "no id"), (2, None)]).withColumn("source", F.lit(None).cast("string"))
    rows = packing.pack(df, PATH).collect()
    assert len(rows) == 4 and sum(r["length"] for r in rows) == rows[-1]["sequence_id"] * 1024 + max(r["offset"] + r["length"] for r in rows)
    assert packing.pack(documents([]), PATH).count() == 0


def test_many_sources(spark):
    """Every source has a queue of its own, however many there are."""
    rows = [(i, prose(i, 20), f"source {i}") for i in range(400)]
    done = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), PATH, {"source 7": 0.5}).collect()
    assert {r["doc_id"] for r in done} == set(range(400))
    assert min(r["sequence_id"] for r in done if r["doc_id"] == 7) == 0


CHATS = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    (1, 0, "sys\ntem\\n", "x\\n<|turn|>user\nhi<|end|>\n\\"), (1, 1, "assistant", "<<|<||>\\<|"), (1, 2, "assistant", None), (1, None, None, "q"),
    (2, 0, "system", "only"), (3, 0, "system", "s " * 1500), (3, 1, "system", "again"), (3, 2, "assistant", "long " * 3000), (3, 3, "assistant", "é😀"),
    (None, 3, "assistant", "no id"), (4, 1, "user", "twice"), (4, 1, "user", "twice"), (4, 1, "assistant", "tie"), (5, 0, "", ""),
    *((6, i, "assistant" if i % 2 else "user", "word " * (i * 37 % 300)) for i in range(80)),
]


def test_chats_read_back(spark, clashing):
    turns = clashing(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string"))
    windows = chat.format_chats(turns, PATH)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for conv in {c[0] for c in CHATS}:
        rows = sorted((r for r in CHATS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(rows) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{ro or ''}\n{t or ''}\n" for _, _, ro, t in rows).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    table = windows.collect()
    assert sum(r["formatted_chars"] for r in got.values()) == sum(len(w["text"]) for w in table)
    long = [w for w in table if w["conv_id"] == 6]
    assert len(long) > 5 and all(w["n_tokens"] <= chat.BUDGET for w in long) and any(w["n_system_and_repeated"] > 0 for w in long)
    for w in table:
        assert not any(c in part[1] for part in [(0, w["text"].replace(chat.TURN, "").replace("<|end|>", ""))] for c in chat.CONTROL)
    assert all(len(chat.parse(w["text"])[0][1]) > 1000 for w in table if w["conv_id"] == 3)  # the system turn stays
    assert chat.read_back(chat.format_chats(turns.limit(0), PATH)).count() == 0


def ppm_brute(texts, trained):
    low = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for i, t in texts.items()}

    def units(t):
        out, cur = [], b""
        for ch in t.encode():
            cur += bytes([ch])
            if ch in (10, 32):
                out.append(cur)
                cur = b""
        return [*out, cur + b"\xff"]

    top = Counter(u for i in trained for u in units(low[i]))
    follow = {}
    for u in top:
        p = b"\xfe" * ppm.ORDER + u
        for k in range(ppm.ORDER, len(p)):
            for o in range(ppm.ORDER + 1):
                follow.setdefault(p[k - o : k], Counter())[p[k]] += 1

    def byte(context, symbol):
        out, gone = 0.0, set()
        for o in range(ppm.ORDER, -1, -1):
            left = {s: c for s, c in follow.get(context[ppm.ORDER - o :], {}).items() if s not in gone}
            if left and symbol in left:
                return out + math.log10((2 * left[symbol] - 1) / (2 * sum(left.values())))
            if left:
                out += math.log10(len(left) / (2 * sum(left.values())))
                gone |= set(left)
        return out - math.log10(ppm.SYMBOLS - len(gone))

    n = sum(top.values())

    def unit(u):
        if u in top:
            return math.log10((2 * top[u] - 1) / (2 * n))
        p = b"\xfe" * ppm.ORDER + u
        return (math.log10(len(top) / (2 * n)) if n else 0.0) + sum(byte(p[k - ppm.ORDER : k], p[k]) for k in range(ppm.ORDER, len(p)))

    return {i: sum(map(unit, units(t))) for i, t in low.items()}


@pytest.mark.parametrize("small_blocks", [False, True])
def test_ppm_equals_brute_force(documents, clashing, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(ppm, "ENTRIES", 50)
        monkeypatch.setattr(ppm, "CHUNK", 7)
    texts = dict(enumerate([t for t in odd_texts() if len(t or "") < 5_000] + [prose(i, 20) for i in range(40)] + SPACES[:5]))
    rows = {r["doc_id"]: r for r in ppm.score_texts(clashing(documents(list(texts.items()))).repartition(3)).collect()}
    trained = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    assert {i for i, r in rows.items() if not r["held_out"]} == set(trained)
    want = ppm_brute(texts, trained)
    words = {i: "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (t or "").lower()).split(" ") for i, t in texts.items()}
    words = {i: [*(w for w in ws if w), None] for i, ws in words.items()}
    count = Counter(w for i in trained for w in words[i])
    n, v = sum(count.values()), len(count)
    for i, r in rows.items():
        assert r["score"] == pytest.approx(want[i], rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words[i]), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words[i]), sum(count[w] > 0 for w in words[i]), n)


def test_ppm_sums_to_one():
    rng = np.random.default_rng(0)
    pairs = np.zeros((256, 256), np.int64)
    data = rng.integers(97, 102, 400)
    seen = Counter(tuple(data[k - ppm.ORDER : k + 1]) for k in range(ppm.ORDER, len(data)))
    for s, c in seen.items():
        pairs[s[-2], s[-1]] += c
    context = next(iter(seen))[:-1]
    near = [s for s in seen if s[-3:-1] == context[-2:]]
    rows = {(*s[:-1], b) for s in [*near, (*context, 0)] for b in range(ppm.SYMBOLS)}
    pack = lambda s: sum(int(b) << (8 * (ppm.ORDER - k)) for k, b in enumerate(s))
    found = sorted(rows, key=pack)
    logs = ppm.sequence_logs(np.array([pack(s) for s in found]), np.array([seen.get(s, 0) for s in found]), pairs)
    total = sum(10**x for s, x in zip(found, logs, strict=True) if s[:-1] == context)
    assert total == pytest.approx(1.0, rel=1e-9)


def test_ppm_of_few_rows(documents):
    assert ppm.score_texts(documents([])).count() == 0
    rows = ppm.score_texts(documents([(None, "no id"), (5, "a b"), (5, "a b")])).collect()
    assert len(rows) == 3 and all(r["score"] < 0 for r in rows)


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        base = rng.normal(size=24) if i % 4 == 0 else base + rng.normal(size=24) * 0.22  # noqa: F821
        rows.append((i, [float(np.float32(x)) for x in base], i % 3 if i % 7 else 1))
    rows += [(200 + i, rows[8][1], rows[8][2]) for i in range(50)]  # copies
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, [None] * 24, 1), (304, rows[8][1], None), (305, [1.0, 2.0], 1), (306, [], 1), (307, [float("inf")] * 24, 1)]
    df = spark.createDataFrame([*rows, rows[8], (None, rows[8][1], 1)], "vec_id long, embedding array<float>, label int")
    df = df.withColumn("_id", F.lit("x")).withColumn("_block", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
    good = {i: (np.array(e), label) for i, e, label in rows if label is not None and e and None not in e and np.isfinite(e).all() and np.abs(e).sum() > 0}
    links = {i: [] for i, _, _ in rows}
    for i, (x, a) in good.items():
        for j, (y, b) in good.items():
            if i != j and a == b and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                links[i].append(j)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        assert got[i] == (len(links[i]), min(seen), min(seen) == i), i
    assert got[None] == (0, None, True) and len(got) == len(links) + 1
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_vectors_whose_squares_overflow_or_vanish(spark):
    base = [3.0, -1.0, 2.0]
    rows = [(i, [x * scale for x in base], 1) for i, scale in enumerate([1.0, 1e200, 1e-200, 1e-310, 7e150])]
    rows += [(9, [1e200, 1e200, -1e200], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (4, 0), 9: (0, 9)}


def test_pairs_stop_early_but_miss_none():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 64)) * np.linspace(3, 0.1, 64)
    y = x[:40] + rng.normal(size=(40, 64)) * 0.2
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j = embeddings.linked_pairs(x, y, axes, 0.9)
    a, b = (m / np.linalg.norm(m, axis=1)[:, None] for m in (x, y))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(a @ b.T >= 0.9)), strict=True))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="masthead">Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, a lot of them, really.</div>
{}<aside>Side</aside><form><label>Mail</label><input></form><div id="comments"><p>First! A reader's comment that is rather long, too.</p></div>
<footer>&copy; me</footer></body></html>"""


def test_article_is_extracted_whole():
    body = "<h1>Head &amp; line</h1><p>One\n  two&nbsp;three <b>bold<br>next<p>unclosed <a href=x>link</a><div class='ad'>Buy</div><p>Sh.</p><ul><li>item<li>last</ul>"
    want = "Head & line\nOne two three bold next\nunclosed link\nSh.\nitem\nlast"
    assert html.main_text(PAGE.format(f"<article>{body}</article>")) == want
    assert html.main_text(PAGE.format(f"<article>{body}")).startswith(want)
    assert html.main_text(PAGE.format("<main></main>")) == ""


def test_regions_without_marks():
    paragraphs = [prose(i, 60) for i in range(6)] + ["Short one."] + [prose(9, 50)]
    links = "".join(f"<div><a href='/{i}'>go {i}</a> <a href='/x'>x</a></div>" for i in range(12))
    page = f"<body><div>{links}</div><div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div>{links}</div></body>"
    assert html.main_text(page) == "\n".join(paragraphs)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text"), (None, "u", "<p>a<p>b"), (3, "u", "just text"), (4, "u", "<" * 500), (5, "u", "<article>" + "<div>" * 3000 + "deep"), (6, "u", "<p>&#xD800; &bogus; x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == "" and by[3] == "just text" and by[None] == "a\nb" and by[5] == "deep"
    assert html.extract_pages(df.limit(0)).count() == 0
