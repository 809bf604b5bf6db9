"""Document quality without hand-made labels: heuristic labellers, EM, a hashed linear scorer.

1. Eight heuristics look at the whole text and vote bad (0), good (1) or abstain (2).
2. The votes of all documents are counted by pattern; there are at most 3^8
   patterns, whatever the number of documents. Expectation-maximisation over
   the counts estimates what each labeller says of good and of bad documents,
   and so the posterior of every pattern.
3. A linear scorer over hashed words and word shapes learns the posteriors from
   at most `sample` documents (picked by a hash of the id, 8,000 by default)
   and scores every document.

EM trusts agreement: a rare fault that one labeller sees and no other supports
may be taken for that labeller's error.

An empty or null text gets abstentions, the posterior of that pattern and the
scorer's bias. Rows with a null id are scored like others, but not sampled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import hash_share, keep_rows, list_array, map_arrow
from sensorlab.llm.linear import fit_sparse, sigmoid
from sensorlab.llm.words import hash_words, split_words, sums

LABELLERS = ["symbols", "capitals", "bars", "repeats", "variety", "length", "sentences", "function_words"]
FAULTS = 4
BUCKETS = 1 << 15
SCALE = 20.0
BAD, GOOD, ABSTAIN = 0, 1, 2


def _share(flags: pa.Array, codes: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    return sums(np.asarray(flags.to_numpy(zero_copy_only=False), np.float64)[codes], ends) / n


def votes(texts: pa.Array) -> np.ndarray:
    """One row per text, one column per labeller."""
    words, ends = split_words(texts, lower=False)
    coded = words.dictionary_encode()
    known, codes = coded.dictionary, coded.indices.to_numpy()
    count = np.diff(ends, prepend=0)
    n = np.maximum(count, 1)
    text = np.repeat(np.arange(len(ends)), count)
    chars = pc.utf8_length(known)
    symbols = _share(pc.match_substring_regex(known, r"""[^\pL\pN.,;:!?'"()|/@+=\-]"""), codes, ends, n)
    capitals = _share(pc.and_(pc.utf8_is_upper(known), pc.greater(chars, 1)), codes, ends, n)
    bars = _share(pc.invert(pc.match_substring_regex(known, r"[\pL\pN]")), codes, ends, n)
    length = _share(chars, codes, ends, n)
    stops = _share(pc.match_substring_regex(known, r"""[.?]["')]?$"""), codes, ends, n)
    small = _share(pc.match_substring_regex(known, r"^\pL{1,3}$"), codes, ends, n)
    same = np.zeros(len(codes))
    same[1:] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
    repeats = sums(same, ends) / n
    pairs = np.unique(text * np.int64(len(known) + 1) + codes)
    distinct = np.bincount(pairs // (len(known) + 1), minlength=len(ends))
    variety = np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 2))

    def vote(bad: np.ndarray, good: np.ndarray, at_least: int = 1) -> np.ndarray:
        return np.where(count < at_least, ABSTAIN, np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)))

    cast = np.column_stack([
        vote(symbols > 0.25, symbols < 0.08),
        vote(capitals > 0.4, capitals < 0.15, 3),
        vote(bars > 0.2, bars < 0.05),
        vote(repeats > 0.25, repeats < 0.08, 5),
        vote(variety < 0.7, variety > 0.8, 20),
        vote((length < 2) | (length > 25), np.zeros(len(n), bool)),
        vote(stops == 0, (stops > 0.01) & (stops < 0.4), 40),
        vote(small < 0.05, (small > 0.12) & (small < 0.8), 20),
    ])
    # What speaks for prose in general abstains where a fault is plain.
    fault = (cast[:, :FAULTS] == BAD).any(axis=1)
    cast[:, FAULTS:][fault[:, None] & (cast[:, FAULTS:] == GOOD)] = ABSTAIN
    return cast


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and shapes of all texts, two for each word, and the texts' ends among them.

    A shape keeps only the kinds of characters; a word that repeats the one
    before it has a shape of its own.
    """
    words, ends = split_words(texts, lower=False)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    shape = pc.replace_substring_regex(coded.dictionary, r"\p{Ll}+", "a")
    shape = pc.replace_substring_regex(shape, r"\p{Lu}+", "A")
    shape = pc.replace_substring_regex(shape, r"\pN+", "0")
    shape = hash_words(pc.binary_join_element_wise(shape, "shape", " "))
    known = hash_words(coded.dictionary)
    repeated = np.zeros(len(codes), bool)
    repeated[1:] = codes[1:] == codes[:-1]
    starts = np.concatenate([[0], ends])[:-1]
    repeated[starts[starts < ends]] = False
    out = np.empty((len(codes), 2), np.int64)
    out[:, 0] = known[codes] % np.uint64(BUCKETS - 1) + np.uint64(1)
    out[:, 1] = np.where(repeated, 0, (shape[codes] % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int64))
    return out.ravel(), ends * 2


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "good" for each pattern, and P(vote | class, not abstaining) as [class, labeller, vote].

    EM starts from a guess: one fault, of which the first FAULTS labellers tell,
    or two other votes for bad make a document bad.
    """
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    fault = (patterns[:, :FAULTS] == BAD).any(axis=1)
    posterior = np.where(fault | (bad >= 2), 0.05, np.where(bad == 1, 0.5, np.where(good > 0, 0.95, 0.5)))
    says = np.zeros((2, patterns.shape[1], 3))
    says[:, :, ABSTAIN] = 1  # abstaining tells nothing: short texts abstain often
    for _ in range(rounds):
        weights = np.stack([1 - posterior, posterior]) * counts
        for vote in (BAD, GOOD):
            says[:, :, vote] = weights @ (patterns == vote) + 0.5
        says[:, :, :2] /= says[:, :, :2].sum(axis=2, keepdims=True)
        prior = (weights.sum(axis=1) + 1) / (counts.sum() + 2)
        chosen = np.log(says)[:, np.arange(patterns.shape[1])[None, :], patterns].sum(axis=2)
        odds = chosen[1] - chosen[0] + np.log(prior[1] / prior[0])
        updated = sigmoid(odds)
        if np.abs(updated - posterior).max() < 1e-9:
            break
        posterior = updated
    return posterior, says


def _encoded(votes_: np.ndarray) -> np.ndarray:
    return votes_ @ (3 ** np.arange(votes_.shape[1]))


def _decoded(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS))[None, :] % 3


def fit_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 8_000, sample_bytes: int = 64_000_000
) -> tuple[Callable[[pa.Array], np.ndarray], Callable[[pa.Array], np.ndarray]]:
    """Functions from texts to posteriors and to scores, learned from all documents' votes and a sample's words.

    The sample has about `sample` documents, or fewer where these would have
    more than about `sample_bytes` of text.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def vote_codes(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = _encoded(votes(batch.column("_text")))
        size = pc.fill_null(pc.binary_length(batch.column("_text")), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(codes), size], ["pattern", "size"])

    found = map_arrow(texts.select("_text"), vote_codes, "pattern long, size long").groupBy("pattern")
    found = found.agg(F.count("*").alias("count"), F.sum("size").alias("size")).toPandas()
    found = found.sort_values("pattern")
    codes, counts = found["pattern"].to_numpy(), found["count"].to_numpy()
    patterns = _decoded(codes) if len(codes) else np.zeros((0, len(LABELLERS)), int)
    posterior, _ = estimate(patterns, counts) if len(codes) else (np.zeros(0), None)

    def posteriors(texts_: pa.Array) -> np.ndarray:
        return posterior[np.searchsorted(codes, _encoded(votes(texts_)))]

    def sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, ends = features(batch.column("_text"))
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        pairs, times = np.unique(text * BUCKETS + index, return_counts=True)
        cuts = np.searchsorted(pairs, (np.arange(len(ends)) + 1) * BUCKETS)
        value = SCALE * times / np.maximum(np.diff(ends, prepend=0), 1)[pairs // BUCKETS]
        return pa.RecordBatch.from_arrays(
            [
                list_array((pairs % BUCKETS).astype(np.int32), cuts),
                list_array(value.astype(np.float32), cuts),
                pa.array(posteriors(batch.column("_text"))),
            ],
            ["index", "value", "target"],
        )

    total, size = int(counts.sum()), int(found["size"].sum())
    wanted = min(sample, total * sample_bytes // max(size, 1))
    chosen = texts.filter(hash_share(F.col("_id"), wanted, total) & F.col("_id").isNotNull())
    table = map_arrow(chosen, sampled, "index array<int>, value array<float>, target double").toArrow().combine_chunks()
    cuts = np.cumsum(pc.list_value_length(table["index"]).to_numpy()) if table.num_rows else np.zeros(0, np.int64)
    weights = fit_sparse(
        table["index"].combine_chunks().flatten().to_numpy().astype(np.int64),
        table["value"].combine_chunks().flatten().to_numpy().astype(np.float64),
        cuts, table["target"].to_numpy(), BUCKETS,
    ).astype(np.float32)

    def scores(texts_: pa.Array) -> np.ndarray:
        index, ends = features(texts_)
        return sigmoid(SCALE * sums(weights[index], ends) / np.maximum(np.diff(ends, prepend=0), 1) + weights[-1])

    return posteriors, scores


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 8_000) -> DataFrame:
    """One row per row of ``docs``: ``id_col, posterior, score, predicted``.

    `posterior` is what EM makes of the labellers' votes, `score` the linear
    scorer's probability that the document is good, `predicted` 1 if that is at
    least 0.5.
    """
    posteriors, scores = fit_quality(docs, id_col, text_col, sample)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = scores(batch.column("_text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(posteriors(batch.column("_text"))), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            [id_col, "posterior", "score", "predicted"],
        )

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return map_arrow(texts, scored, f"`{id_col}` long, posterior double, score double, predicted int")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 8_000) -> DataFrame:
    """The rows of ``docs`` whose score is at least 0.5."""
    _, scores = fit_quality(docs, id_col, text_col, sample)
    return keep_rows(docs, text_col, lambda texts: scores(texts) >= 0.5)
