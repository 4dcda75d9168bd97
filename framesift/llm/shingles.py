"""Sets of word shingles as sorted 64-bit hashes, made by numpy inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
# Bytes' values, powers of a base for places in a word, and powers for words in a shingle.
_BYTES = _RANDOM.integers(0, 2**64, 256, U, endpoint=False)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_BASE, _STEP = (int(x) | 1 for x in _RANDOM.integers(0, 2**63, 2))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Texts are hashed in slices of about so many bytes.
SLICE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    out[1:] = base
    return np.multiply.accumulate(out)


_POWERS = powers(_BASE, 64)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text, in order, with A-Z in lower case."""
    found, start = [], 0
    while start < len(text):
        end = min(len(text), start + SLICE)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        found.append(_slice_hashes(np.frombuffer(text, np.uint8, end - start, start)))
        start = end
    return np.concatenate(found) if found else np.zeros(0, U)


def _slice_hashes(seen: np.ndarray) -> np.ndarray:
    global _POWERS
    space = _SPACE[seen]
    word = ~space
    begins = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    if not len(begins):
        return np.zeros(0, U)
    place = np.arange(begins[0], len(seen)) - np.repeat(begins, np.diff(begins, append=len(seen)))
    place[space[begins[0]:]] = 0
    most = int(place.max()) + 1
    if most > len(_POWERS):
        _POWERS = powers(_BASE, 2 * most)
    values = _BYTES[seen[begins[0]:]] * _POWERS[place]
    values[space[begins[0]:]] = 0
    return mixed(np.add.reduceat(values, begins - begins[0]))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of so many words; with
    fewer words, that of the whole sequence; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(words, len(w))
    n = len(w) - size + 1
    total = np.full(n, size, U)
    for k, power in enumerate(powers(_STEP, size)):
        total += w[k : k + n] * power
    found = np.sort(mixed(total))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]
