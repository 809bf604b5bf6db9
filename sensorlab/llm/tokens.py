"""Token ids of a byte-level BPE vocabulary, many texts at once.

The vocabulary's file is a parameter and is read where a task runs. A text is
cut before every single space that follows and precedes other characters; no
token crosses such a place, so each distinct piece is encoded once. A worker
keeps the ids of the pieces it has met, at most CACHE of them.
"""

from __future__ import annotations

import json
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 800_000
# Fixed value: how byte-level BPE vocabularies of this kind split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A piece that begins so may share a run of white space with the one before.
UNSAFE = r"^$|^[\s\pZ\x{0B}\x{1C}-\x{1F}\x{85}]"


def _byte_of() -> dict[str, int]:
    """The byte each character of the vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by the vocabulary in a `tokenizers` file (byte-level BPE without prefix space)."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        byte_of = _byte_of()
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self._coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = set(special)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        # The ids of all known pieces, and where each piece's ids end, with room to grow.
        self._ids, self._ends = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self._special):
            return self._coder.encode(text, allowed_special="all")
        return self._coder.encode_ordinary(text)

    def _places(self, pieces: list[str]) -> np.ndarray:
        if len(self._known) > CACHE:
            self._forget()
        known = self._known
        found = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            new = list(dict.fromkeys(pieces[i] for i in lacking.tolist()))
            # Control strings are rare: one look at all pieces tells that none needs care.
            joined = "\x00".join(new)
            plain = not any(s in joined for s in self._special)
            ids = [*map(self._coder.encode_ordinary if plain else self.encode, new)]
            self._add(np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            found[lacking] = [known[pieces[i]] for i in lacking.tolist()]
        return found

    def _add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Behind what is there; twice the room whenever it is used up."""
        k = len(self._known)
        before = int(self._ends[k])
        if before + len(ids) > len(self._ids):
            self._ids = np.resize(self._ids, 2 * (before + len(ids)))
        if k + 1 + len(ends) > len(self._ends):
            self._ends = np.resize(self._ends, 2 * (k + 1 + len(ends)))
        self._ids[before : before + len(ids)] = ids
        self._ends[k + 1 : k + 1 + len(ends)] = before + ends

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids end; a null text has none."""
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        flat = parts.flatten()
        ends = parts.offsets.to_numpy()[1:].astype(np.int64) - parts.offsets[0].as_py()
        starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
        first = np.zeros(len(flat), bool)
        first[starts] = True
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        unsafe = pc.match_substring_regex(coded.dictionary, UNSAFE).to_numpy(zero_copy_only=False)[codes] & ~first
        odd = np.add.reduceat(unsafe, starts) > 0
        heads = np.unique(codes[starts[~odd]])
        head_at = np.zeros(len(words), np.int64)
        if len(heads):
            head_at[heads] = np.arange(len(heads))
        whole = texts.filter(pa.array(odd)).to_pylist()
        n = len(words)
        places = self._places([*(" " + w for w in words), *(words[h] for h in heads), *whole])
        at = places[np.where(first, n + head_at[codes], codes)]
        lone = np.flatnonzero(odd)
        keep = ~(np.repeat(odd, ends - starts) & ~first)
        at[starts[lone]] = places[n + len(heads) + np.arange(len(lone))]
        at, text = at[keep], np.repeat(np.arange(len(ends)), ends - starts)[keep]
        ids, bounds = self._ids, self._ends
        begin, size = bounds[at], bounds[at + 1] - bounds[at]
        total = np.cumsum(size)
        index = np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)
        return ids[index], np.cumsum(np.bincount(text, size, len(ends))).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
