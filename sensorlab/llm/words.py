"""Words and shingles of many texts at once, as flat arrays.

A word is a run of characters other than space and the five control characters
from tab to carriage return; A-Z is lower-cased, nothing else is. A null text
counts as empty. Arrays of a batch are flat: `ends[i - 1]` to `ends[i]` belong
to text i.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„‘’«»…–—"
MIX_A = np.uint64(0xFF51AFD7ED558CCD)  # fixed values: odd multipliers of a common 64-bit finaliser
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output looks random."""
    x = x ^ (x >> np.uint64(33))
    x *= MIX_A
    x ^= x >> np.uint64(33)
    x *= MIX_B
    x ^= x >> np.uint64(33)
    return x


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words end."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # splitting leaves empty strings at the rims
        dropped = np.concatenate([[0], np.cumsum(empty)])
        ends = ends - dropped[ends]
        flat = flat.filter(pa.array(~empty))
    return flat, ends


def plain_words(words: pa.Array) -> pa.Array:
    """Lower-cased, without punctuation at either end."""
    return pc.utf8_lower(pc.utf8_trim(words, MARKS))


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words hash alike in every process."""
    if not len(words):
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return known[coded.indices.to_numpy()]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, ends = split_words(texts)
    return hash_words(words), ends


def shingle_hashes(hashes: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and each text's end among them.

    A text with fewer words has one shingle, the whole sequence; a text without
    words has none.
    """
    starts = np.concatenate([[0], ends])[:-1]
    n_words = ends - starts
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    out_ends = np.cumsum(n)
    first = np.repeat(starts - (out_ends - n), n) + np.arange(out_ends[-1] if len(n) else 0)
    last = np.repeat(ends, n)
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        at = first + k
        inside = at < last
        word = hashes[np.minimum(at, max(len(hashes) - 1, 0))] if len(hashes) else out
        out = mix64(out * np.uint64(31) + np.where(inside, word, np.uint64(0x9E3779B97F4A7C15)))
    return out, out_ends


def distinct_sorted(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in rising order, and their ends."""
    values = values.copy()
    start = 0
    for end in ends.tolist():
        values[start:end].sort()
        start = end
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
    fresh[starts[starts < ends]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return values[fresh], kept[ends]


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends])[:-1].astype(np.int64)]
