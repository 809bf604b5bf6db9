"""Secret scans: automata inferred from labelled credentials judge every candidate by its format's likelihood.

Three rules find credentials that give themselves away; their matches are the
labels. From a sample of them a prefix tree is built for each kind, and states
whose ends and next characters occur in statistically compatible shares
(Hoeffding's bound) are merged, from the root outwards, to a probabilistic
automaton. It knows fixed prefixes, character sets and where they change, and
gives every string a probability. All runs of credential characters in all
texts are candidates. Their evidence is the logarithm, in bits, of that
probability over the one under the pairs of characters of the whole corpus. A
candidate is a finding if it has enough evidence and is, per character, about
as likely as labelled credentials that the automaton has not seen.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import small_batches

KINDS = ("assign", "access", "hex")
# The rules, and the least lengths of what they match.
_RULES = (
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
)
LEAST = (12, 18, 16)
#: Texts in which no rule can match are told by these, which may match too much.
_HINTS = ("(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", "AKIA[A-Z0-9]{14}", "[0-9a-f]{16}")

#: Credential characters; symbol 0 is every other byte.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SYMBOLS = len(ALPHABET) + 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(ALPHABET)] = np.arange(1, SYMBOLS)
_INNER = np.zeros(256, bool)
_INNER[[c for c in ALPHABET if chr(c).isalnum()]] = True

CANDIDATE = 12
#: Distinct credentials of each kind that an automaton is made of, and their greatest length there.
SAMPLE, LONGEST = 2_000, 256
#: Automata need this many credentials.
ENOUGH = 20
ALPHA = 0.05
#: Bits of evidence a finding needs; share of the labelled credentials that may be less likely per character than it, and bits it may lack.
EVIDENCE = 30.0
QUANTILE, SLACK = 0.02, 16.0


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``start, kind, end, start of the credential`` of the rules' matches, in order."""
    found = []
    for kind, rule in enumerate(_RULES):
        for m in rule.finditer(text):
            value = m.start(2) if kind == 0 else m.start()
            if m.end() - value >= LEAST[kind]:
                found.append((m.start(), kind, m.end(), value))
    return sorted(found)


def _hinted(texts: pa.Array) -> np.ndarray:
    """Texts in which a rule may match."""
    any_ = np.zeros(len(texts), bool)
    for hint in _HINTS:
        any_ |= pc.match_substring_regex(texts, hint).to_numpy(zero_copy_only=False)
    return any_


@dataclass
class _Batch:
    """Texts as one array of bytes, each followed by a zero byte, and the rules' matches."""

    texts: pa.Array

    def __post_init__(self) -> None:
        texts = self.texts
        self.base = [base_spans(t) if hit else [] for t, hit in zip(texts.to_pylist(), _hinted(texts), strict=True)]
        joined = pc.binary_join_element_wise(texts.cast(pa.binary()), pa.scalar(b""), pa.scalar(b"\x00")).to_pylist()
        self.bytes = np.frombuffer(b"\x00" + b"".join(joined), np.uint8)
        self.ends = 1 + np.cumsum([len(t) for t in joined]) if joined else np.zeros(0, np.int64)
        self.starts = np.concatenate([[1], self.ends[:-1]]).astype(np.int64) if joined else self.ends
        self.symbols = _SYMBOL[self.bytes]
        lead = (self.bytes & 0xC0) != 0x80
        #: Code points before each byte.
        self.points = np.cumsum(lead) - lead
        covered = np.zeros(len(self.bytes) + 1, np.int32)
        for i, spans in enumerate(self.base):
            if spans:
                own = self.starts[i] + np.flatnonzero(lead[self.starts[i] : self.ends[i]])
                for start, _, end, _ in spans:
                    covered[own[start]] += 1
                    covered[own[end]] -= 1  # the zero byte follows the last one
        self.covered = np.cumsum(covered[:-1]) > 0

    def pairs(self) -> np.ndarray:
        """How often each symbol follows each, outside of the rules' matches."""
        free = ~(self.covered[1:] | self.covered[:-1])
        code = self.symbols[:-1].astype(np.int32) * SYMBOLS + self.symbols[1:]
        return np.bincount(code[free], minlength=SYMBOLS * SYMBOLS)

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all runs of credential characters, and of letters and digits within, free of the rules' matches."""
        starts, ends = [], []
        for mask in (self.symbols > 0, _INNER[self.bytes]):
            turn = np.flatnonzero(np.diff(mask.astype(np.int8))) + 1
            a, b = turn[::2], turn[1::2]
            long = b - a >= CANDIDATE
            starts.append(a[long])
            ends.append(b[long])
        if len(ends[1]):  # a run without signs is in both
            same = np.isin(starts[0], starts[1]) & np.isin(ends[0], ends[1])
            starts[0], ends[0] = starts[0][~same], ends[0][~same]
        a, b = np.concatenate(starts), np.concatenate(ends)
        taken = np.concatenate([[0], np.cumsum(self.covered)])
        free = taken[a] == taken[b]
        return a[free], b[free]


@dataclass
class Automaton:
    """A deterministic probabilistic automaton over symbols: next states, bits of each step and of an end."""

    step: np.ndarray
    bits: np.ndarray
    end: np.ndarray

    def score(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Base-2 logarithm of the probability of each run of symbols, all advanced together."""
        order = np.argsort(starts - ends, kind="stable")
        a, length = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(a), np.int32), np.zeros(len(a))
        at, active = 0, len(a)
        while True:
            active = int(np.searchsorted(-length[:active], -at, side="left"))
            if not active:
                break
            s = symbols[a[:active] + at]
            total[:active] += self.bits[state[:active], s]
            state[:active] = self.step[state[:active], s]
            at += 1
        out = np.empty(len(a))
        out[order] = total + self.end[state]
        return out


def infer(strings: list[np.ndarray], alpha: float = ALPHA) -> Automaton:
    """Merge the compatible states of the strings' prefix tree.

    States accepted so far are red; their other successors are blue. The blue
    state reached most often is compared with every red one: the shares of ends
    and of each next symbol, and so on below, may differ by Hoeffding's bound at
    most. It is folded into the most alike compatible one, or else becomes red.
    """
    arrivals, stops, edges, flow = [len(strings)], [0], [{}], [{}]
    for string in strings:
        at = 0
        for s in string.tolist():
            to = edges[at].get(s)
            if to is None:
                to = edges[at][s] = len(edges)
                arrivals.append(0)
                stops.append(0)
                edges.append({})
                flow.append({})
            flow[at][s] = flow[at].get(s, 0) + 1
            arrivals[to] += 1
            at = to
        stops[at] += 1
    log = np.sqrt(0.5 * np.log(2 / alpha))

    def unlike(a: int, b: int) -> float | None:
        """How far two states differ, None if more than chance allows."""
        far, todo, top = 0.0, [(a, b)], True
        while todo:
            p, q = todo.pop()
            n, m = arrivals[p], arrivals[q]
            bound = log * (n**-0.5 + m**-0.5)
            if abs(stops[p] / n - stops[q] / m) > bound:
                return None
            for s in flow[p].keys() | flow[q].keys():
                gap = abs(flow[p].get(s, 0) / n - flow[q].get(s, 0) / m)
                if gap > bound:
                    return None
                far += gap if top else 0.0
                x, y = edges[p].get(s), edges[q].get(s)
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
            top = False
        return far

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            arrivals[p] += arrivals[q]
            stops[p] += stops[q]
            for s, y in edges[q].items():
                flow[p][s] = flow[p].get(s, 0) + flow[q][s]
                x = edges[p].setdefault(s, y)
                if x != y:
                    todo.append((x, y))

    red = [0]
    while True:
        known = set(red)
        blue = [(arrivals[q], -p, -s, q) for p in red for s, q in edges[p].items() if q not in known]
        if not blue:
            break
        _, p, s, q = max(blue)
        gaps = [(gap, r) for r in red if (gap := unlike(r, q)) is not None]
        if gaps:
            r = min(gaps)[1]
            edges[-p][-s] = r
            fold(r, q)
        else:
            red.append(q)
    number = {q: i for i, q in enumerate(red)}
    step = np.zeros((len(red), SYMBOLS), np.int32)
    counts = np.zeros((len(red), SYMBOLS))
    ends = np.array([stops[q] for q in red], float)
    for q, i in number.items():
        # An unseen character goes the usual way.
        step[i] = number[edges[q][max(flow[q], key=flow[q].get)]] if flow[q] else i
        for s, to in edges[q].items():
            step[i, s], counts[i, s] = number[to], flow[q][s]
    # All unseen characters and an unseen end share half a count.
    unseen = (counts[:, 1:] == 0).sum(axis=1) + (ends == 0)
    spare = 0.5 / np.maximum(unseen, 1)
    scale = ends + counts.sum(axis=1) + np.where(unseen > 0, 0.5, 0.0)
    bits = np.log2(np.where(counts > 0, counts, spare[:, None]) / scale[:, None])
    return Automaton(step, bits, np.log2(np.where(ends > 0, ends, spare) / scale))


def _symbols(value: str) -> np.ndarray:
    return _SYMBOL[np.frombuffer(value.encode(), np.uint8)]


@dataclass
class Model:
    """Automata and least bits per character by kind, and bits of every pair of symbols in the corpus."""

    automata: dict[int, tuple[Automaton, float]]
    pairs: np.ndarray

    def plain(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each run under the pairs of characters, from the one before it to the one behind it."""
        total = np.concatenate([[0.0], np.cumsum(self.pairs[symbols[:-1].astype(np.int32) * SYMBOLS + symbols[1:]])])
        return total[ends] - total[starts - 1]

    def findings(self, batch: _Batch) -> list[list[tuple[int, int, int]]]:
        """``start, kind, end`` of the candidates of each text that an automaton recognises, the likeliest kind of each."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in batch.base]
        a, b = batch.candidates()
        if not len(a) or not self.automata:
            return out
        best, of = np.zeros(len(a)), np.full(len(a), -1)
        plain = self.plain(batch.symbols, a, b)
        for kind, (automaton, least) in self.automata.items():
            bits = automaton.score(batch.symbols, a, b)
            evidence = bits - plain
            better = (evidence >= EVIDENCE) & (evidence > best) & (bits + SLACK >= least * (b - a))
            best[better], of[better] = evidence[better], kind
        hit = np.flatnonzero(of >= 0)
        # Of a run with signs and the runs within it, the likeliest stands.
        taken = np.zeros(len(batch.bytes), bool)
        kept: list[int] = []
        for i in hit[np.argsort(-best[hit], kind="stable")].tolist():
            if not taken[a[i] : b[i]].any():
                taken[a[i] : b[i]] = True
                kept.append(i)
        text = np.searchsorted(batch.ends, a[np.array(kept, np.int64)], side="right")
        for i, t in zip(kept, text.tolist(), strict=True):
            first = batch.points[batch.starts[t]]
            out[t].append((int(batch.points[a[i]] - first), int(of[i]), int(batch.points[b[i]] - first)))
        return out


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's texts: the SAMPLE distinct credentials of each kind with the least hashes, and the counts of pairs."""
    held: list[dict[str, int]] = [{} for _ in KINDS]
    pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for record in batches:
        batch = _Batch(record.column(0))
        pairs += batch.pairs()
        for text, spans in zip(record.column(0), batch.base, strict=True):
            text = text.as_py() if spans else ""
            for _, kind, end, value in spans:
                if end - value <= LONGEST:
                    found = text[value:end]
                    held[kind][found] = int.from_bytes(hashlib.blake2b(found.encode(), digest_size=7).digest(), "big")
        for kind, values in enumerate(held):
            if len(values) > 4 * SAMPLE:
                held[kind] = dict(heapq.nsmallest(SAMPLE, values.items(), key=lambda v: v[1]))
    rows = [(k, v, h) for k, values in enumerate(held) for v, h in heapq.nsmallest(SAMPLE, values.items(), key=lambda v: v[1])]
    rows += [(-1, str(i), int(pairs[i])) for i in np.flatnonzero(pairs).tolist()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)], ["kind", "value", "n"])


def learn(texts: DataFrame) -> Model:
    """An automaton for each kind of credential in the one-column ``texts``.

    Each is made of at most SAMPLE distinct credentials, the ones with the
    least hashes: a uniform sample that every task narrows down by itself. A
    fifth of them is held back to tell how likely such credentials are. A kind with fewer
    than ENOUGH credentials has none. Pairs of characters are counted over all
    texts, outside of the rules' matches; a format that is itself a large part
    of the unlabelled text is part of what counts as usual.
    """
    facts = texts.mapInArrow(_facts, "kind int, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"), F.min("n").alias("hash"))
    counts = np.full(SYMBOLS * SYMBOLS, 0.5)
    facts = facts.persist()
    try:
        for row in facts.filter("kind = -1").collect():
            counts[int(row["value"])] += row["n"]
        samples = {k: [r["value"] for r in facts.filter(F.col("kind") == k).orderBy("hash", "value").limit(SAMPLE).collect()] for k in range(len(KINDS))}
    finally:
        facts.unpersist()
    table = counts.reshape(SYMBOLS, SYMBOLS)
    table[0, 0] = 0.5
    model = Model({}, np.log2(table / table.sum(axis=1, keepdims=True)).ravel())
    for kind, values in samples.items():
        if len(values) < ENOUGH:
            continue
        held = values[::5]
        automaton = infer([_symbols(v) for i, v in enumerate(values) if i % 5])
        joined = np.concatenate([[0], *(np.append(_symbols(v), 0) for v in held)]).astype(np.uint8)
        ends = np.cumsum([len(v) + 1 for v in held])
        starts = ends - np.array([len(v) for v in held])
        model.automata[kind] = (automaton, float(np.quantile(automaton.score(joined, starts, ends) / (ends - starts), QUANTILE)))
    return model


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col, spans``, an array of ``start, end, kind, base``.

    ``base`` tells the rules' matches from the automata's findings. Offsets are
    in code points, ends exclusive, spans in order of start and kind. A null or
    empty text has none. A finding overlaps no match of a rule and no other
    finding; it is a run of at least CANDIDATE credential characters, or of
    letters and digits within one. Rows of one id stay apart; null ids too.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    model = model or learn(rows.select("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            batch = _Batch(record.column("_text"))
            out = []
            for base, more in zip(batch.base, shared.value.findings(batch), strict=True):
                spans = sorted([(s, k, e, True) for s, k, e, _ in base] + [(s, k, e, False) for s, k, e in more])
                out.append([{"start": s, "end": e, "kind": KINDS[k], "base": b} for s, k, e, b in spans])
            yield pa.RecordBatch.from_arrays([record.column("_id"), pa.array(out, pa.list_(span))], ["_id", "spans"])

    found = rows.mapInArrow(scan, "_id long, spans array<struct<start: int, end: int, kind: string, base: boolean>>")
    return found.select(F.col("_id").alias(id_col), "spans")


def _equals(kind: str):
    return lambda k: k == kind


def secret_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the rules' matches by kind, a digest of them, and all spans as text."""
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
