"""Alias tables of many distributions of any length, in whole numbers.

A mass becomes a weight of ``BITS`` bits relative to the largest of its segment.  With n
weights of sum M an entry is light if n w <= M, else heavy.  Entries give and take in
order: with D the running deficits of the light and E the running excesses of the heavy,
a light entry takes from the first heavy one whose E exceeds the D before it; a heavy one
falls short where D first reaches its E, and takes from the next heavy one.  So a table
is two running sums and two searches, whose results are exact and the same everywhere.

Rows of more than ``CHUNK`` entries are cut in chunks: a table over the chunks' masses
draws the chunk, the chunk's own table the entry.
"""

from __future__ import annotations

import numpy as np

BITS, CHUNK = 40, 2048
#: Segments up to this size are searched together.
SMALL = 32


def weights(mass: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole weights of masses above zero, and the mass that a weight of one stands for, by segment."""
    if not len(mass):
        return np.zeros(0, np.int64), np.zeros(len(start) - 1)
    top = np.maximum.reduceat(mass, start[:-1])
    size = np.diff(start)
    w = np.floor(mass / np.repeat(top, size) * (1 << BITS)).astype(np.int64)
    return np.maximum(w, 1), top / (1 << BITS)


def tables(w: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Threshold and alias (its place in the segment) of each entry, and the sum of each segment; none is empty.

    An entry that is drawn stays if a uniform number times the sum is below its threshold.
    """
    size = np.diff(start)
    threshold, alias, total = np.zeros(len(w), np.int64), np.zeros(len(w), np.int32), np.zeros(len(size), np.int64)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        step = max(1, (1 << 22) // (n * n) if n <= SMALL else (1 << 20) // n)
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            at = start[own][:, None] + np.arange(n)
            q = w[at]
            m = q.sum(1, keepdims=True)
            x = n * q - m
            light = x <= 0
            d, e = np.cumsum(np.where(light, -x, 0), 1), np.cumsum(np.where(light, 0, x), 1)
            v = np.where(light, d + x, e)
            if n <= SMALL:
                to, until = (e[:, None, :] <= v[:, :, None]).sum(2), (d[:, None, :] < e[:, :, None]).sum(2)
            else:
                to = np.stack([np.searchsorted(a, b, "right") for a, b in zip(e, v, strict=True)])
                until = np.stack([np.searchsorted(a, b, "left") for a, b in zip(d, e, strict=True)])
            reached = np.take_along_axis(d, np.minimum(until, n - 1), 1)
            threshold[at], alias[at], total[own] = np.where(light, n * q, m - (reached - e)), np.minimum(to, n - 1), m[:, 0]
    return threshold, alias, total


class Tables:
    """Alias tables of rows of masses; row i has those from ``start[i]`` to ``start[i + 1]``, and none is empty."""

    def __init__(self, mass: np.ndarray, start: np.ndarray):
        size = np.diff(start)
        chunks = -(-size // CHUNK)
        self.first = np.concatenate([[0], np.cumsum(chunks)])
        inner = np.arange(self.first[-1]) - np.repeat(self.first[:-1], chunks)
        self.start = np.append(np.repeat(start[:-1], chunks) + inner * CHUNK, len(mass))
        self.size, self.chunks, self.many = np.diff(self.start), chunks, bool((chunks > 1).any())
        w, unit = weights(mass, self.start)
        self.threshold, self.alias, self.total = tables(w, self.start)
        each = self.total * unit
        w, unit = weights(each, self.first)
        self.chunk_threshold, self.chunk_alias, self.chunk_total = tables(w, self.first)
        #: Masses of the rows, as their tables have them.
        self.mass = self.chunk_total * unit

    def draw(self, row: np.ndarray, column: np.ndarray, stay: np.ndarray, chunk_column: np.ndarray | None = None, chunk_stay: np.ndarray | None = None) -> np.ndarray:
        """Places of entries that the rows draw with these uniform numbers; the last two matter to rows of several chunks (``many``)."""
        c = self.first[row]
        if self.many and len(many := np.flatnonzero(self.chunks[row] > 1)):
            r = row[many]
            k = np.minimum((chunk_column[many] * self.chunks[r]).astype(np.int64), self.chunks[r] - 1)
            keeps = chunk_stay[many] * self.chunk_total[r] < self.chunk_threshold[c[many] + k]
            c[many] += np.where(keeps, k, self.chunk_alias[c[many] + k])
        i = np.minimum((column * self.size[c]).astype(np.int64), self.size[c] - 1)
        at = self.start[c] + i
        return np.where(stay * self.total[c] < self.threshold[at], at, self.start[c] + self.alias[at])


def table_mass(t: Tables) -> np.ndarray:
    """The share of its row that each entry is drawn with."""
    chunk = np.repeat(np.arange(len(t.size)), t.size)
    stays = t.threshold / (t.size[chunk] * t.total[chunk])
    inner = stays.copy()
    np.add.at(inner, t.start[chunk] + t.alias, 1 / t.size[chunk] - stays)
    row = np.repeat(np.arange(len(t.chunks)), t.chunks)
    stays = t.chunk_threshold / (t.chunks[row] * t.chunk_total[row])
    outer = stays.copy()
    np.add.at(outer, t.first[:-1][row] + t.chunk_alias, 1 / t.chunks[row] - stays)
    return inner * outer[chunk]
