"""Hashes of all words of many texts at once, over their bytes.

A word's hash is a polynomial of its bytes modulo 2^64, mixed with its length. With prefix sums over a
buffer of texts every word costs a few array operations, and a word hashes alike wherever it stands.
Long buffers go through in segments cut at word ends, so memory stays bounded.
"""

from __future__ import annotations

import numpy as np

from .common import kept

SEGMENT_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2^64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * _M1
        x = (x ^ (x >> np.uint64(32))) * _M2
        return x ^ (x >> np.uint64(29))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n places."""
    own = kept("words")
    if "powers" not in own or len(own["powers"][0]) < n:
        size = max(n, 2 * SEGMENT_BYTES)
        with np.errstate(over="ignore"):
            tables = []
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                steps = np.full(size, np.uint64(base))
                steps[0] = 1
                tables.append(np.multiply.accumulate(steps))
        own["powers"] = tables[0], tables[1]
    return own["powers"]


def _segment(flat: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a buffer; ``gap`` marks bytes between words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(flat) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(flat) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((flat + np.uint64(1)) * up[: len(flat)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * down[starts]
        return starts, ends, mixed(raw + (ends - starts).astype(np.uint64) * _M2)


def word_hashes(buffer: bytes, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of all words; ``between`` says of each of the 256 bytes whether it parts words."""
    raw = np.frombuffer(buffer, np.uint8)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT_BYTES)
        gap = between[raw[at:end]]
        while end < len(raw) and not gap[-1]:  # the cut stands inside a word: go back to its start, or on to its end
            last = np.flatnonzero(gap)
            if len(last):
                end = at + int(last[-1]) + 1
            else:
                end = min(len(raw), 2 * end - at)
            gap = between[raw[at:end]]
        starts, ends, hashes = _segment(raw[at:end], gap)
        parts.append((starts + at, ends + at, hashes))
        at = end
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n words, in order; runs may cross texts and are the caller's to drop."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - n + 1, n, np.uint64)
        for k in range(n):
            out = mixed(out * _M2 + hashes[k : k + len(out)])
    return out
