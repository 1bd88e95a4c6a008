"""Anchors of byte windows: positions that equal windows choose alike.

Of the GRAM-byte strings in each window of `width` bytes the one with the smallest hash is its anchor
(leftmost on ties), so equal windows have equal anchors at equal offsets, wherever they stand, and only
anchors need to be exchanged to find all windows that repeat. A window's anchor moves on as the window
does, so a text has about 2 / (width - GRAM + 2) anchors per byte.
"""

from __future__ import annotations

import numpy as np

GRAM = 24
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEGMENT = 1 << 22
_PLACE = np.uint64((1 << 23) - 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for i, b in enumerate((BASE, inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes: h[j] - h[i], times BASE**-i, is the hash of raw[i:j]."""
    power, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, out=out[1:])
    return out


def hashes_at(prefix: np.ndarray, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Hashes of the strings of `size` bytes at starts."""
    _, inverse = powers(len(prefix))
    return (prefix[starts + size] - prefix[starts]) * inverse[starts]


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first window, number of windows) of the anchors of a text's windows."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    span = width - GRAM + 1
    for at in range(0, max(len(raw) - width + 1, 0), _SEGMENT):
        part = raw[at : at + _SEGMENT + width - 1]
        prefix = prefix_hashes(part)
        n = len(part) - GRAM + 1
        _, inverse = powers(len(prefix))
        gram = scramble((prefix[GRAM:] - prefix[:n]) * inverse[:n])
        value = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64)
        low, size = value, 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: n - span + 1], low[span - size :])
        place = (low & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.append(first, len(place)))
        for column, v in zip(out, (place[first] + at, gram[place[first]].view(np.int64), first + at, count)):
            column.append(v)
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
