"""Word shingles of whole texts as sets of 64-bit numbers, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: bytes handled at once; a longer text is handled alone
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(97).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES[65:91] = _CODES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, end
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word [^\\x20\\x09-\\x0D]+ in order, A-Z as a-z."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(n + 1)
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid & (first[:n] | ~np.r_[False, solid[:-1]]))
    ends = np.flatnonzero(solid & (first[1:] | ~np.r_[solid[1:], False])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * up[:n], out=total[1:])
    h = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each text's distinct shingles, sorted by text and hash.

    A text of fewer words than ``width`` has its whole sequence as its one shingle; one without words has none.
    """
    h, text = word_hashes(data, offsets)
    if not len(h):
        return h, text
    factor = np.random.default_rng(53).integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    full = np.zeros(0, bool) if len(h) < width else text[width - 1 :] == text[: len(h) - width + 1]
    total = np.zeros(len(full), np.uint64)
    for j in range(width):
        total += h[j : j + len(full)] * factor[j]
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    counts = np.diff(np.r_[starts, len(text)])
    few = counts < width
    short = np.zeros(few.sum(), np.uint64)
    for j in range(width - 1):
        has = counts[few] > j
        short[has] += h[starts[few][has] + j] * factor[j]
    short += counts[few].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    out = mixed(np.r_[total[full], short])
    of = np.r_[text[: len(full)][full], text[starts[few]]]
    order = np.lexsort((out, of))
    out, of = out[order], of[order]
    keep = np.r_[True, (out[1:] != out[:-1]) | (of[1:] != of[:-1])]
    return out[keep], of[keep]
