"""Vectorised hashes over texts, for use inside tasks: words, shingles and byte windows.

A string of bytes b0..bn hashes to sum(R[bi] * P**i) modulo 2**64, with random R and an odd P,
so that every substring's hash follows from prefix sums: (S[e] - S[s]) * P**-s.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n, kept for the longest n so far."""
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", _P), ("i", _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * p, out=out[1:])
    return out


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of data[i : i + width] for each i."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = prefix_sums(data)
    _, inverse = powers(n)
    return mix((s[width:] - s[:n]) * inverse)


def range_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[begin:end] for arrays of ends, from prefix_sums(data)."""
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes between white space, with A-Z lower-cased, in order."""
    data = _LOWER[data]
    word = ~SPACE_BYTES[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return range_hashes(prefix_sums(data), begin, end)


def text_words(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """word_hashes() of a text of any length, a piece of about 1 MB at a time."""
    if len(text) <= piece:
        return word_hashes(np.frombuffer(text, np.uint8))
    data, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        stop = min(len(data), at + piece)
        while stop < len(data):  # move on to a white space
            more = np.flatnonzero(SPACE_BYTES[data[stop : stop + piece]])
            if len(more):
                stop += int(more[0])
                break
            stop = min(len(data), stop + piece)
        out.append(word_hashes(data[at:stop]))
        at = stop
    return np.concatenate(out)


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; fewer words are one run, no words none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _FACTORS[i]
    return np.unique(mix(total))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each full window of this width (two running minima over blocks)."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    padded = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).reshape(-1)[:n]
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    return np.minimum(right[: n - width + 1], left[width - 1 :])
