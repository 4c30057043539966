"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (splitmix's finaliser)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n``."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


@dataclass
class Shingles:
    """Distinct shingles of a run of documents: those of document i lie at ``start[i]:start[i + 1]``, ascending."""

    start: np.ndarray
    hashes: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.start)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.start[i] : self.start[i + 1]]


def shingles(texts: Sequence[str | None], k: int) -> Shingles:
    """Lower-cases A-Z, takes runs of characters that are no ASCII white space as words and hashes every ``k`` words in a
    row; a text of fewer words gives one shingle of all, one without words none.

    Words are hashed as polynomials of their bytes through running sums over the whole run, a shingle from its words'
    hashes and their places.
    """
    parts = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    power, inverse = _power_tables(len(data) + 1)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    first, last = edges[0::2], edges[1::2]  # the end is white space, so every word ends
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    word = mix((running[last] - running[first]) * inverse[first] + (last - first).astype(np.uint64))
    doc = np.searchsorted(begin, first, side="right") - 1
    counts = np.bincount(doc, minlength=len(parts)) if len(doc) else np.zeros(len(parts), np.int64)
    at = np.concatenate([[0], np.cumsum(counts)])
    n = max(0, len(word) - k + 1)
    sums = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        sums += word[j : j + n] * _PLACE[j]
    inside = doc[:n] == doc[len(word) - n :] if n else np.zeros(0, bool)
    hashes, owner = mix(sums[inside], 1), doc[:n][inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        alone = [np.sum(word[at[i] : at[i + 1]] * _PLACE[: counts[i]], dtype=np.uint64) for i in short]
        hashes = np.concatenate([hashes, mix(np.array(alone, np.uint64), 2 + k) + counts[short].astype(np.uint64)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[new], minlength=len(parts)) if len(hashes) else np.zeros(len(parts), np.int64)
    return Shingles(np.concatenate([[0], np.cumsum(sizes)]), hashes[new])
