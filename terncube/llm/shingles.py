"""Hashed word shingles of texts, computed for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, p in enumerate((_PRIME, _INVERSE)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and the number of words of each text."""
    data = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up, dtype=np.uint64)])
    hashed = mix((total[ends] - total[starts]) * down[starts])
    upto = np.cumsum([len(t) + 1 for t in texts])
    return hashed, np.diff(np.searchsorted(starts, upto), prepend=0)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; a text of fewer words is one shingle, one of none has none."""
    hashed, counts = words(texts)
    slide = max(0, len(hashed) - k + 1)
    every = hashed[:slide].copy()
    for i in range(1, k):
        every = mix(every * np.uint64(0xD6E8FEB86659FD93) + hashed[i : i + slide])
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(every[at : at + n - k + 1]))
        else:
            one = np.full(min(n, 1), n, np.uint64)
            for i in range(at, at + n):
                one = mix(one * np.uint64(0xD6E8FEB86659FD93) + hashed[i : i + 1])
            out.append(one)
        at += n
    return out
