"""Byte-level BPE ids of many texts at once.

The public tokenizer cuts a text into words, digit runs, marks and white space and
merges inside each piece alone.  Pieces repeat, so their boundaries are found with
vectors over the code points of a batch, and only pieces not seen before go to the
tokenizer.  A piece is found by a hash of its code points, which are then compared.
Texts with characters outside ``SIMPLE`` blocks, or with the string of a special token,
go to the tokenizer whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, MARK = 0, 1, 2, 3
#: Code points below this have had the same class in every Unicode version in use.
SIMPLE = 0x250
MAX_CACHED = 300_000
CHUNK = 1 << 18
_SPACES = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0}


def _class(cp: int) -> int:
    kind = unicodedata.category(chr(cp))[0]
    return SPACE if cp in _SPACES else LETTER if kind == "L" else NUMBER if kind == "N" else MARK


CLASSES = np.array([_class(cp) for cp in range(SIMPLE)], dtype=np.uint8)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)


def _byte_alphabet() -> dict[int, str]:
    """Byte-level tokenizers write byte b as character b where that is printable, else as 256, 257, ..."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}


ALPHABET = _byte_alphabet()


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start.  ``cp``: code points below SIMPLE; ``first``: where texts start."""
    n = len(cp)
    kind = CLASSES[cp]
    begin = np.zeros(n + 1, bool)
    begin[first] = True
    begin[n] = True
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= begin[:n]
    blank = cp == 0x20
    # The blank right before a run of another kind, in the same text, opens that run's piece.
    joined = np.zeros(n, bool)
    joined[1:] = change[1:] & ~begin[1:n] & (kind[1:] != SPACE) & blank[:-1]
    start = change & ~joined
    # The last white space before other characters is a piece of its own, or opens theirs.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begin[1:n]
    start |= last
    # An apostrophe that is alone between a piece's end and s, t, m, d, re, ve, ll takes these.
    for p in np.flatnonzero((cp == 0x27) & start):
        a = cp[p + 1] if p + 1 < n and not begin[p + 1] else 0
        b = cp[p + 2] if a and p + 2 < n and not begin[p + 2] else 0
        size = 2 if a in (0x73, 0x74, 0x6D, 0x64) else 3 if (a, b) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)) else 0
        if size:
            start[p + 1] = False
            if size == 3:
                start[p + 2] = False
            if p + size < n:
                start[p + size] = True
    return np.flatnonzero(start)


#: The one way of splitting texts that ``piece_starts`` knows.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Encoder:
    """Ids of texts, equal to the tokenizer's own ``encode_batch``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        made = json.loads(self.tok.to_str())
        if made["model"]["type"] != "BPE" or made["normalizer"] or made["pre_tokenizer"] != PRE_TOKENIZER:
            raise ValueError(f"{path}: only byte-level pairs whose texts are split as byte-level pieces are read: {made['model']['type']}, {made['normalizer']}, {made['pre_tokenizer']}")
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self):
        self.index: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)
        self.points = np.zeros(1 << 18, np.uint16)
        self.points_at = np.zeros(1 << 16, np.int64)
        self.known = 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        # A text is cut at no point here: each goes to the tokenizer as it is.
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], keys: list[int]):
        """Merge pieces not seen before; each is one piece to the tokenizer, too."""
        got = [[x.id for x in self.model.tokenize(p.encode().decode("latin-1").translate(ALPHABET))] for p in pieces]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        shown = np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)
        tail = int(self.points_at[self.known])
        while tail + len(shown) > len(self.points):
            self.points = np.concatenate([self.points, np.zeros(len(self.points), np.uint16)])
        while self.known + len(got) >= len(self.points_at):
            self.points_at = np.concatenate([self.points_at, np.zeros(len(self.points_at), np.int64)])
        self.points[tail : tail + len(shown)] = shown
        self.points_at[self.known + 1 : self.known + len(got) + 1] = tail + np.cumsum(list(map(len, pieces)))
        begin = int(self.at[self.known])
        end = begin + int(counts.sum())
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        while self.known + len(got) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(self.at), np.int64)])
        self.pool[begin:end] = [i for ids in got for i in ids]
        self.at[self.known + 1 : self.known + len(got) + 1] = begin + np.cumsum(counts)
        self.index.update(zip(keys, range(self.known, self.known + len(got)), strict=True))
        self.known += len(got)

    def _equal(self, cp: np.ndarray, start: np.ndarray, length: np.ndarray, found: list[int | None]) -> bool:
        """Whether pieces found by their hashes are the pieces known under them."""
        old = np.array([k for k, f in enumerate(found) if f is not None], np.int64)
        at = np.array([found[k] for k in old.tolist()], np.int64)
        size = length[old]
        if (size != self.points_at[at + 1] - self.points_at[at]).any():
            return False
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return bool((cp[np.repeat(start[old], size) + inner] == self.points[np.repeat(self.points_at[at], size) + inner]).all())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        group, size = [], 0
        for i, t in enumerate(texts):
            group.append(i)
            size += len(t)
            if size >= CHUNK:
                self._some(texts, group, out)
                group, size = [], 0
        if group:
            self._some(texts, group, out)
        return out

    def _some(self, texts, group, out):
        joined = "".join(texts[i] for i in group)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(texts[i]) for i in group], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        odd = np.zeros(len(group), bool)
        if len(cp) and cp.max() >= SIMPLE:
            odd |= np.add.reduceat(np.concatenate([cp >= SIMPLE, [False]]).astype(np.int64), np.minimum(first[:-1], len(cp))) > 0
        for name in self.special:
            if name in joined:
                odd |= np.array([name in texts[i] for i in group])
        odd &= sizes > 0
        if odd.any():
            asked = [i for i, o in zip(group, odd, strict=True) if o]
            for i, ids in zip(asked, self._whole([texts[i] for i in asked]), strict=True):
                out[i] = ids
            rest = [i for i, o in zip(group, odd, strict=True) if not o]
            if rest:
                self._some(texts, rest, out)
            return
        if not len(cp):
            for i in group:
                out[i] = np.zeros(0, np.uint32)
            return
        if len(self.index) > MAX_CACHED:
            self.clear()
        starts = piece_starts(cp, first[:-1][sizes > 0])
        ends = np.append(starts[1:], len(cp))
        # Polynomial hash of each piece, modulo 2**64, mixed with its length.
        length = ends - starts
        longest = int(length.max())
        power = np.cumprod(np.full(longest, _R, np.uint64))
        inner = np.arange(len(cp), dtype=np.int32) - np.repeat(starts.astype(np.int32), length)
        h = (cp.astype(np.uint64) + np.uint64(0x1000)) * power[inner]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        key = np.add.reduceat(h, starts) ^ (length.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        distinct, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        # Equal hashes must be equal pieces, here and among those known.
        same = (length == length[where][inverse]).all() and (cp == cp[np.repeat(starts[where][inverse], length) + inner]).all()
        distinct = distinct.tolist()
        found = list(map(self.index.get, distinct))
        new = [k for k, f in enumerate(found) if f is None]
        if not (same and self._equal(cp, starts[where], length[where], found)):
            for i, ids in zip(group, self._whole([texts[i] for i in group]), strict=True):
                out[i] = ids
            return
        if new:
            known = self.known
            self._learn([joined[starts[where[k]] : ends[where[k]]] for k in new], [distinct[k] for k in new])
            for j, k in enumerate(new):
                found[k] = known + j
        slot = np.array(found, np.int64)[inverse]
        at = self.at
        begin, count = at[slot], at[slot + 1] - at[slot]
        before = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.arange(before[-1]) + np.repeat(begin - before[:-1], count)]
        cut = before[np.searchsorted(starts, first)]
        for k, i in enumerate(group):
            out[i] = ids[cut[k] : cut[k + 1]]
