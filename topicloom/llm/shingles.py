"""Order min-hash sketches of many texts at once, and banded alignment of their words."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
#: Sketches per text and minima per sketch.
SKETCHES, MINIMA = 24, 2
BINS, FULL = 128, 0xFFFF
#: Places of a sequence whose bits are held together.
BLOCK = 4096
_U = np.uint64
_MAX = np.iinfo(np.uint64).max

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, _MAX, 256, dtype=np.uint64)
_STEP = _rng.integers(1, _MAX, WIDTH, dtype=np.uint64) | _U(1)
_SEEDS = _rng.integers(1, _MAX, SKETCHES, dtype=np.uint64)
_POWER = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def word_hashes(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts -> hashes of all words and the number of words before each text.

    Words are runs of bytes that are neither space nor tab to carriage return, with
    ASCII letters in lower case.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(start), np.int64)
    inside = ~_SEPARATOR[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = start[:-1][start[:-1] < start[1:]]
    begin[first] = inside[first]
    at = np.flatnonzero(begin)
    before = np.searchsorted(at, start)
    if not len(at):
        return np.zeros(0, np.uint64), before
    where = np.flatnonzero(inside)
    head = np.searchsorted(where, at)
    length = np.diff(np.append(head, len(where)))
    power = np.cumprod(np.full(int(length.max()), _POWER, np.uint64))
    inner = np.arange(len(where), dtype=np.int64) - np.repeat(head, length)
    h = _BYTE[_LOWER[data[where]]] * power[inner]
    return mix(np.add.reduceat(h, head)), before


def shingle(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``WIDTH`` words; of all words if there are fewer."""
    if len(words) < WIDTH:
        return mix((words * _STEP[: len(words)]).sum(keepdims=True) + _U(len(words))) if len(words) else words
    n = len(words) - WIDTH + 1
    out = np.full(n, WIDTH, np.uint64)
    for k in range(WIDTH):
        out += words[k : k + n] * _STEP[k]
    return mix(out)


def label(sh: np.ndarray) -> np.ndarray:
    """Shingles of one text made distinct by how often each has occurred before."""
    order = np.argsort(sh, kind="stable")
    s = sh[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return sh
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(nth > 0, mix(sh + nth * _POWER), sh)


def bin_counts(words: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Counts of words by text in ``BINS`` bins of their hashes."""
    cell = text * BINS + (words >> _U(57)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=texts * BINS), FULL).astype(np.uint16).reshape(-1, BINS)


class Sketched:
    """Of texts with words: ``own`` (their indexes), digest, n (words), keys (SKETCHES), bins."""

    def __init__(self, data: np.ndarray, start: np.ndarray):
        words, before = word_hashes(data, start)
        self.own = np.flatnonzero(np.diff(before))
        self.n = np.diff(before)[self.own]
        self.digest, parts = [], []
        for i in self.own:
            w = words[before[i] : before[i + 1]]
            self.digest.append(xxhash.xxh3_128_digest(w.tobytes()))
            parts.append(label(shingle(w)))
        self.keys = np.zeros((len(parts), SKETCHES), np.int64)
        self.bins: list[bytes] = []
        if not parts:
            return
        self.bins = [b.tobytes() for b in bin_counts(words, np.repeat(np.arange(len(parts)), self.n), len(parts))]
        lab = np.concatenate(parts)
        size = np.array([len(p) for p in parts])
        first = np.cumsum(size) - size
        for k in range(SKETCHES):
            v = mix(lab ^ _SEEDS[k])
            mins, at = [], []
            for _ in range(MINIMA):
                m = np.minimum.reduceat(v, first)
                hit = np.flatnonzero(v == np.repeat(m, size))
                p = hit[np.searchsorted(hit, first)]
                v[p] = _MAX
                mins.append(m)
                at.append(p)
            m, at = np.stack(mins), np.stack(at)
            m = np.take_along_axis(m, np.argsort(at, 0, kind="stable"), 0)
            key = np.full(len(parts), k + 1, np.uint64)
            for row in m:
                key = mix(key + row)
            self.keys[:, k] = key.view(np.int64)


def needed(na, nb, least: float):
    """Matches that a similarity of ``least`` takes."""
    return np.ceil(least * (na + nb) / (1 + least) - 1e-9).astype(np.int64)


class Centre:
    """A sequence of words that others are aligned with: where each word stands, as bits, by block."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.blocks: list[dict[int, int]] = []
        for lo in range(0, self.n, BLOCK):
            at: dict[int, int] = {}
            for i, w in enumerate(words[lo : lo + BLOCK].tolist()):
                at[w] = at.get(w, 0) | 1 << i
            self.blocks.append(at)

    def similarity(self, other: np.ndarray, least: float) -> float:
        """m / (|a| + |b| - m), 0 if below ``least``; m: words of the longest alignment in order.

        An alignment of ``need`` matches leaves at most |a| - need and |b| - need words
        without one, which bounds how far from the diagonal a match can lie: only this
        band is looked at.  The alignment is a bit vector over the band's places in a:
        a zero is a place where the longest alignment so far grows by one.
        """
        na, nb = self.n, len(other)
        need = int(needed(np.int64(na), np.int64(nb), least))
        if need > min(na, nb) or not need:
            return 0.0
        back, width = nb - need, na + nb - 2 * need + 1
        full, top = (1 << width) - 1, 1 << (width - 1)
        v, m, lo = full, 0, -back
        for w in other.tolist():
            at = 0
            for k in range(max(0, lo) // BLOCK, min(na - 1, lo + width - 1) // BLOCK + 1):
                bits = self.blocks[k].get(w)
                if bits:
                    shift = k * BLOCK - lo
                    at |= bits << shift if shift >= 0 else bits >> -shift
            u = v & at & full
            if u:
                v = ((v + u) | (v - u)) & full
            m += not v & 1
            v = v >> 1 | top
            lo += 1
            if lo - m > na - need:  # too many places left behind without a match
                return 0.0
        m += width - v.bit_count()
        return m / (na + nb - m) if m >= need else 0.0
