"""Hashed word shingles of many texts at once, on arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed in one go; a longer text is a block of its own.
_BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, _BLOCK + 2)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers[0], _powers[1]


def words(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts as (first, after last, word hashes, first word of each text and the end).

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; null is the empty text.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < _BLOCK):
            size += len(raw[end]) + 1
            end += 1
        text = _LOWER[np.frombuffer(b" ".join(raw[at:end]) + b" ", dtype=np.uint8)]
        blank = _SPACE[text]
        change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            change = np.concatenate(([0], change))
        starts, ends = change[::2], change[1::2]
        power, inverse = _power_tables(len(text))
        total = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts])
        offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw[at:end]])))
        yield at, end, hashes, np.searchsorted(starts, offsets)
        at = end


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles.

    A text with fewer than ``k`` words gives its whole sequence as one; one without words gives none.
    """
    odd = [np.uint64(pow(_BASE, j + 3, 1 << 64)) for j in range(k)]
    for at, end, hashes, first in words(texts):
        whole = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
        for j in range(k):
            whole += hashes[j : j + len(whole)] * odd[j]
        whole = mix(whole)
        for i in range(end - at):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif b > a:
                short = (hashes[a:b] * np.array(odd[: b - a])).sum(dtype=np.uint64, keepdims=True)
                yield mix(short + np.array([b - a], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
