"""Word shingles of whole texts as 64-bit hashes, by array arithmetic over their bytes.

Words are lower-cased in A-Z and parted by blank, tab, newline, vertical tab, form feed and
return. Shingles are compared by their hashes. Memory is bounded by ``SEGMENT`` bytes of text
plus the hashes of one text.
"""

from __future__ import annotations

import numpy as np

# Bytes worked on at once; a segment ends at white space.
SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as a segment has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > len(self.up):
            steps = np.full(size, _BASE), np.full(size, _INVERSE)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.cumprod(s) for s in steps)
        return self.up[:size], self.down[:size]


_powers = _Powers()


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of UTF-8 bytes."""
    data = np.frombuffer(raw, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data):  # on to the next white space
            ahead = data[end : end + SEGMENT]
            space = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
            if len(space):
                end += int(space[0])
                break
            end += len(ahead)
        h, s = _segment(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _segment(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return np.empty(0, np.uint64), first
    up, down = _powers(len(data))
    values = data.astype(np.uint64) + np.uint64(1)
    values += np.where((data >= 65) & (data <= 90), np.uint64(32), np.uint64(0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)])
    return mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)), first


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Per text its distinct shingles of ``n`` words, as sorted 64-bit hashes.

    A text with fewer words, but one, has its whole sequence as one shingle.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < SEGMENT):
            size += len(texts[upto]) + 1
            upto += 1
        part = texts[at:upto]
        h, start = word_hashes(b" ".join(part))
        ends = np.cumsum([len(t) + 1 for t in part])
        cut = np.concatenate([[0], np.searchsorted(start, ends)])
        rolled = h[: max(0, len(h) - n + 1)].copy()
        for j in range(1, n):
            rolled = mixed(rolled * _BASE + h[j : j + len(rolled)])
        for i in range(len(part)):
            a, b = cut[i], cut[i + 1]
            if b - a >= n:
                out.append(np.unique(rolled[a : b - n + 1]))
            elif b > a:
                whole = h[a : a + 1]
                for j in range(a + 1, b):
                    whole = mixed(whole * _BASE + h[j : j + 1])
                out.append(mixed(whole + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
        at = upto
    return out
