"""Toxicity: a lexicon learned from labels, misspellings by Levenshtein automata, context windows.

1. Words, and beginnings of words, that occur in toxic documents far more often
   than in clean ones (log-likelihood ratio, see `learn_lexicon`) make the
   lexicon. Near copies count once, so that copies of one text don't make its
   words evidence.
2. The lexicon is a trie. The Levenshtein automaton of a word that allows one
   edit is intersected with it; the product's states are made when first met,
   so that most words end after two or three steps. A beginning counts for any
   continuation, without edits.
3. Every hit is scored with its window of neighbouring hits, apart for hits
   between quotation marks, which a logistic model weighs against those
   outside: it learns from the labelled documents how far each tells abuse.

Only labels of the training rows, at most `max_labelled` of them, are used
(documented bound; picked by a hash of the id). Language, source and id are no
inputs. An empty or null text has no hits and gets the model's score for that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import hash_share, keep_rows, map_arrow, stored
from sensorlab.llm.linear import fit_dense, sigmoid
from sensorlab.llm.words import plain_words, shingle_hashes, split_words, word_hashes

#: Least toxic texts of a term; likelihood ratio beyond that of the luckiest of all tested terms.
MARGIN = 4.0
SUPPORT = 3
FUZZY_FROM = 5
#: So many states of the product are kept.
STATES = 200_000
BEGINNINGS = (4, 5, 6, 7)
WINDOW = 8
QUOTES = '["“”„«»]'


@dataclass
class Lexicon:
    """A trie of terms with weights; `open` terms match any word that begins with them."""

    terms: dict[str, tuple[float, bool]]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[tuple[float, bool, int] | None] = field(default_factory=lambda: [None])

    def __post_init__(self) -> None:
        for term, (weight, is_open) in sorted(self.terms.items()):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            self.ends[node] = (weight, is_open, len(term))
        self._forget()

    def _forget(self) -> None:
        """Begin with the first state alone."""
        self._ids: dict[frozenset, int] = {}
        self._states: list[frozenset] = []
        self._next: list[dict[str, int]] = []
        self._found: list[tuple[float, int]] = []
        self._open: list[float] = []
        self._id(self._closed({(0, 0)}))

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With the states that leave out the term's next character."""
        for node, errors in list(states):
            if errors == 0:
                states.update((child, 1) for child in self.children[node].values())
        return frozenset((n, e) for n, e in states if e == 0 or (n, 0) not in states)

    def _id(self, states: frozenset) -> int:
        if states not in self._ids:
            self._ids[states] = len(self._states)
            self._states.append(states)
            self._next.append({})
            exact = [self.ends[n][0] for n, e in states if e == 0 and self.ends[n]]
            near = [self.ends[n][0] for n, e in states if e == 1 and self.ends[n] and not self.ends[n][1] and self.ends[n][2] >= FUZZY_FROM]
            self._found.append((max(exact), 1) if exact else (max(near), 2) if near else (0.0, 0))
            self._open.append(max((self.ends[n][0] for n, e in states if e == 0 and self.ends[n] and self.ends[n][1]), default=0.0))
        return self._ids[states]

    def _step(self, state: int, c: str) -> int:
        after = set()
        for node, errors in self._states[state]:
            child = self.children[node].get(c)
            if child is not None:
                after.add((child, errors))
            if errors == 0:
                after.add((node, 1))
                after.update((other, 1) for other in self.children[node].values())
        self._next[state][c] = at = self._id(self._closed(after)) if after else -1
        return at

    def look_up(self, word: str) -> tuple[float, int]:
        """Weight and kind of the best match: 1 exact or by its beginning, 2 by one edit, 0 none."""
        if len(self._states) > STATES:
            self._forget()
        state, begun = 0, 0.0
        for c in word:
            step = self._next[state].get(c)
            state = self._step(state, c) if step is None else step
            if state < 0:
                return (begun, 1) if begun else (0.0, 0)
            begun = self._open[state] or begun
        weight, kind = self._found[state]
        return (weight, 1) if kind == 1 else (begun, 1) if begun else (weight, kind)


def _entries(texts: pa.Array, beginnings: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms of a batch, and the distinct pairs (text, term): words as they are, beginnings with a final `*`."""
    words, ends = split_words(texts)
    coded = words.dictionary_encode()
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    plain = plain_words(coded.dictionary)
    kinds = [plain]
    for k in BEGINNINGS if beginnings else ():
        long = pc.greater_equal(pc.utf8_length(plain), k)
        kinds.append(pc.if_else(long, pc.binary_join_element_wise(pc.utf8_slice_codeunits(plain, 0, k), "*", ""), ""))
    terms = pa.concat_arrays([k.cast(pa.string()) for k in kinds]).dictionary_encode()
    codes = terms.indices.to_numpy().reshape(len(kinds), -1)[:, coded.indices.to_numpy()]
    pairs = np.unique(text[None, :] * np.int64(len(terms.dictionary) + 1) + codes)
    return terms.dictionary, pairs // (len(terms.dictionary) + 1), pairs % (len(terms.dictionary) + 1)


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Lexicon from ``_text, _toxic`` rows: every term in SUPPORT or more toxic texts is tested.

    The likelihood ratio of its shares in toxic and other texts must exceed
    what the best of that many terms reaches by chance. Near copies count once:
    of texts with the same least shingle hash, the least text.
    """
    def key(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, ends = shingle_hashes(*word_hashes(batch.column("_text")), 5)
        least = np.zeros(len(ends), np.uint64)
        starts = np.concatenate([[0], ends])[:-1]
        full = starts < ends
        if full.any():
            least[full] = np.minimum.reduceat(values, starts[full])
        return pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), batch.column("_text"), batch.column("_toxic")], ["_near", "_text", "_toxic"])

    rows = map_arrow(labelled, key, "_near long, _text string, _toxic int")
    rows = stored(rows.groupBy("_near", "_toxic").agg(F.min("_text").alias("_text")).select("_text", "_toxic"), "labelled")
    n = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon({})

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic = batch.column("_toxic").to_numpy()
        terms, text, codes = _entries(batch.column("_text"))
        times = [np.bincount(codes[toxic[text] == kind], minlength=len(terms)) for kind in (1, 0)]
        return pa.RecordBatch.from_arrays([terms, *map(pa.array, times)], ["term", "t", "c"])

    counts = map_arrow(rows, count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = stored(counts.filter((F.col("t") >= SUPPORT) & (F.length("term") >= 3)), "terms")
    tested = counts.count()
    t, c = F.col("t"), F.col("c")
    share = (t + c) / (n[0] + n[1])
    gain = t * F.log(t / (n[1] * share)) + F.when(c > 0, c * F.log(c / (n[0] * share))).otherwise(0.0)
    weight = F.log((t + 0.5) / (n[1] + 1)) - F.log((c + 0.5) / (n[0] + 1))
    passed = counts.withColumn("weight", weight).filter((2 * gain >= 2 * np.log(max(tested, 1)) + MARGIN) & (weight >= 1.5))
    passed = passed.collect()  # terms of at most max_labelled texts
    terms: dict[str, tuple[float, bool]] = {}
    longer = {(r["term"].removesuffix("*")[:k], r["t"], r["c"]) for r in passed for k in BEGINNINGS if len(r["term"].removesuffix("*")) > k}
    for r in sorted(passed, key=lambda r: r["term"]):
        term = r["term"].removesuffix("*")
        if r["term"].endswith("*") and (term, r["t"], r["c"]) in longer:
            continue  # every word with this beginning goes on alike
        terms[term] = max(terms.get(term, (0.0, False)), (float(r["weight"]), r["term"].endswith("*")))
    return Lexicon(terms)


def hit_features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: exact hits outside and inside quotes, hits by one edit outside and inside, strongest hit and window."""
    words, ends = split_words(texts, lower=False)
    out = np.zeros((len(ends), 6))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    plain = plain_words(coded.dictionary).dictionary_encode()
    found = np.array([lexicon.look_up(w) for w in plain.dictionary.to_pylist()] or [(0.0, 0)])
    found = found[plain.indices.to_numpy()] if len(codes) else found
    at = np.flatnonzero(found[:, 1][codes] > 0) if len(codes) else np.empty(0, int)
    if not len(at):
        return out
    text = np.searchsorted(ends, at, side="right")
    weight, kind = found[codes[at], 0], found[codes[at], 1].astype(int)
    marks = pc.count_substring_regex(coded.dictionary, QUOTES).to_numpy()[codes]
    before = np.concatenate([[0], np.cumsum(marks)])
    starts = np.concatenate([[0], ends])[:-1]
    inside = (before[at] - before[starts[text]]) % 2 == 1
    first = pc.match_substring_regex(coded.dictionary, "^" + QUOTES).to_numpy(zero_copy_only=False)[codes[at]]
    quoted = inside | first
    total = np.concatenate([[0.0], np.cumsum(np.where(quoted, 0.0, weight))])
    low = np.searchsorted(at, np.maximum(at - WINDOW, starts[text]))
    high = np.searchsorted(at, np.minimum(at + WINDOW + 1, ends[text]))
    np.add.at(out, (text, 2 * (kind - 1) + quoted), weight)
    np.maximum.at(out[:, 4], text, np.where(quoted | (kind == 2), 0.0, weight))
    np.maximum.at(out[:, 5], text, total[high] - total[low])
    out[:, :4] = np.log1p(out[:, :4])
    return out


def held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id's text, mod 5, is 0; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_labelled: int = 50_000,
) -> tuple[Lexicon, Callable[[pa.Array], np.ndarray]]:
    """The lexicon, and a function from texts to scores."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    truth = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    truth = truth.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    truth = truth.filter(hash_share(F.col("_id"), max_labelled, truth.count()))
    # At most about max_labelled rows of 12 bytes: small enough to broadcast.
    labelled = stored(texts.join(F.broadcast(truth), "_id").select("_text", "_toxic"), "labelled")
    lexicon = learn_lexicon(labelled)

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = hit_features(batch.column("_text"), lexicon)
        return pa.RecordBatch.from_arrays([pa.array(list(rows)), batch.column("_toxic")], ["features", "toxic"])

    table = map_arrow(labelled, measured, "features array<double>, toxic int").toArrow().combine_chunks()
    rows = table["features"].combine_chunks().flatten().to_numpy().reshape(-1, 6) if table.num_rows else np.zeros((0, 6))
    target = table["toxic"].to_numpy().astype(float)
    scale = rows.std(axis=0) + 1e-6 if len(rows) else np.ones(6)
    weights = fit_dense(rows / scale, target)
    if not len(target) or target.min() == target.max():
        share = target.mean() if len(target) else 0.0
        weights = np.append(np.zeros(6), np.log((share + 1e-9) / (1 - share + 1e-9)))

    def scores(texts_: pa.Array) -> np.ndarray:
        return sigmoid((hit_features(texts_, lexicon) / scale) @ weights[:-1] + weights[-1])

    return lexicon, scores


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_labelled: int = 50_000,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, held_out, score, predicted``.

    Learns from labelled rows that aren't held out. Without labels of both kinds
    the score is the share of toxic labels, or 0 without any. Null labels are no
    labels; of several labels of one id the largest counts.
    """
    _, scores = fit_toxicity(docs, labels, id_col, text_col, label_col, max_labelled)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = scores(batch.column("_text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_held"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            [id_col, "held_out", "score", "predicted"],
        )

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), held_out(id_col).alias("_held"))
    return map_arrow(texts, scored, f"`{id_col}` long, held_out boolean, score double, predicted int")


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_labelled: int = 50_000,
) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5."""
    _, scores = fit_toxicity(docs, labels, id_col, text_col, label_col, max_labelled)
    return keep_rows(docs, text_col, lambda texts: scores(texts) < 0.5)
