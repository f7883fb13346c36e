"""A small gated recurrent language model in numpy.

Symbols are the frequent words, each with vectors of its own, then classes of all other
words, by frequency.  With x the symbol before, and s the state:

    z = sigmoid(A_z[x] + U_z s)      g = tanh(A_g[x] + U_g s)      s' = (1 - z) s + z g

The output is factored: a softmax over classes, then one over the words of the class.
A class of rare words is a symbol itself; what its words share of it is not the network's.
Documents are laid end to end in lanes that advance together; the state is carried from
window to window and starts anew with each document, and gradients reach back to the
start of a window (truncated backpropagation).
"""

from __future__ import annotations

import heapq

import numpy as np

#: Size of the state, steps of a window, and documents that advance together.
STATE, WINDOW, LANES = 16, 16, 384
#: Steps of a window at most, where few documents are left.
LONGEST = 128
RATE, CLIP = 0.15, 5.0
_F = np.float32


def _lower(logits: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
    """Subtract a number near each row's largest logit, so that none overflows and not all vanish.

    States lie within 1, so the weights bound the logits; while the bounds of the largest are
    close, one number serves all rows.
    """
    reach = np.abs(weights).sum(1)
    most, least = (bias + reach).max(), (bias - reach).max()
    if most - least < 60:
        logits -= most
    else:
        logits -= logits.max(1, keepdims=True)


class Network:
    """Parameters, in ``names``: arrays of 32-bit floats."""

    names = ("enter", "turn", "to_class", "class_bias", "to_word", "word_bias")

    def __init__(self, words: int, rare: int, per_class: int, counts: np.ndarray | None = None, state: int = STATE, seed: int = 1):
        """``words`` frequent words in classes of ``per_class``, ``rare`` further classes; ``counts`` of all symbols.

        The output starts as the words' relative frequencies, whatever the state.
        """
        self.words, self.rare, self.per_class = words, rare, per_class
        self.full = -(-words // per_class)
        self.classes, self.start = self.full + rare, words + rare
        counts = np.zeros(words + rare) if counts is None else np.asarray(counts, float)
        rng = np.random.default_rng(seed)
        self.enter = rng.normal(0, 0.3, (words + rare + 1, 2 * state)).astype(_F)
        self.enter[:, :state] -= 1  # gates start rather shut
        self.turn = rng.normal(0, 0.5 / np.sqrt(state), (state, 2 * state)).astype(_F)
        self.to_class = np.zeros((state, self.classes), _F)
        own = np.full(self.full * per_class, -np.inf)
        own[:words] = np.log(counts[:words] + 0.5)
        own = own.reshape(self.full, per_class)
        of = np.concatenate([np.exp(own).sum(1), counts[words:] + 0.5])
        self.class_bias = np.log(of / of.sum()).astype(_F)
        self.to_word = np.zeros((self.full, per_class, state), _F)
        self.word_bias = np.where(np.isfinite(own), own - np.log(np.exp(own).sum(1, keepdims=True)), -1e9).astype(_F) if self.full else own.astype(_F)

    def copy(self) -> Network:
        out = object.__new__(Network)
        out.__dict__ = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return out

    def squares(self) -> dict[str, np.ndarray]:
        """Sums of squared gradients to begin with, by parameter."""
        return {n: np.full_like(getattr(self, n), 1e-2) for n in self.names}

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.names])

    def take(self, vector: np.ndarray) -> None:
        at = 0
        for n in self.names:
            a = getattr(self, n)
            setattr(self, n, vector[at : at + a.size].reshape(a.shape).astype(_F))
            at += a.size

    def advance(self, before: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """Steps x lanes of symbols before, and of document starts -> states, gates, candidates and states before."""
        steps, lanes = before.shape
        h = state.shape[1]
        come = self.enter[before]
        states, gates, news, olds = (np.empty((steps, lanes, h), _F) for _ in range(4))
        keep = (~fresh).astype(_F)[:, :, None]
        resets = fresh.any(1)
        s = state
        for t in range(steps):
            if resets[t]:
                s = s * keep[t]
            olds[t] = s
            pre = s @ self.turn
            pre += come[t]
            z = gates[t]
            np.negative(pre[:, :h], out=z)
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            np.tanh(pre[:, h:], out=news[t])
            step = news[t] - s
            step *= z
            s = np.add(s, step, out=states[t])
        return states, gates, news, olds

    def output(self, states: np.ndarray, target: np.ndarray, learn: bool = False):
        """Natural log-probabilities of the target symbols; with ``learn`` also gradients of their negated sum."""
        n = len(target)
        frequent = target < self.words
        of = np.where(frequent, target // self.per_class, target - self.words + self.full)
        p = states @ self.to_class
        p += self.class_bias
        _lower(p, self.to_class.T, self.class_bias)
        at = np.arange(n)
        logp = p[at, of]
        np.exp(p, out=p)
        total = p.sum(1, keepdims=True)
        logp = logp - np.log(total[:, 0])
        grads: dict[str, np.ndarray] = {}
        if learn:
            p /= total
            p[at, of] -= 1
            back = p @ self.to_class.T
            grads = {"to_class": states.T @ p, "class_bias": p.sum(0), "to_word": np.zeros_like(self.to_word), "word_bias": np.zeros_like(self.word_bias)}
        order = np.argsort(of.astype(np.uint16), kind="stable")[: int(frequent.sum())]  # frequent words' classes come first
        edges = np.searchsorted(of[order], np.arange(self.full + 1))
        sorted_states, word = states[order], target[order] % self.per_class
        gain = np.empty(len(order), _F)
        turned = np.empty_like(sorted_states) if learn else None
        for c in np.flatnonzero(np.diff(edges)):
            lo, hi = edges[c], edges[c + 1]
            s, w, i = sorted_states[lo:hi], word[lo:hi], at[: hi - lo]
            q = s @ self.to_word[c].T
            q += self.word_bias[c]
            _lower(q, self.to_word[c], self.word_bias[c])
            mine = q[i, w]
            np.exp(q, out=q)
            whole = q.sum(1, keepdims=True)
            gain[lo:hi] = mine - np.log(whole[:, 0])
            if learn:
                q /= whole
                q[i, w] -= 1
                turned[lo:hi] = q @ self.to_word[c]
                grads["to_word"][c] = q.T @ s
                grads["word_bias"][c] = q.sum(0)
        logp[order] += gain
        if learn:
            back[order] += turned
            return logp, back, grads
        return logp

    def learn(self, before, target, fresh, valid, state, tops: dict[str, np.ndarray], rate: float = RATE) -> np.ndarray:
        """One update from one window (Adagrad; ``tops`` holds its sums of squares); the state at its end."""
        states, gates, news, olds = self.advance(before, fresh, state)
        grads = self.gradients(before, target, fresh, valid, (states, gates, news, olds))[1]
        scale = 1 / max(1, int(valid.sum()))
        for n, g in grads.items():
            if n == "enter":
                rows, g = g
                g = np.clip(g, -CLIP, CLIP)
                top = tops[n][rows] + g * g
                tops[n][rows] = top
                self.enter[rows] -= rate * g / np.sqrt(top)
            else:
                g = np.clip(g * (scale * len(before)), -CLIP, CLIP)
                tops[n] += g * g
                getattr(self, n)[...] -= rate * g / np.sqrt(tops[n])
        return states[-1]

    def gradients(self, before, target, fresh, valid, run):
        """Log-probabilities where valid, and gradients of their negated sum; of ``enter`` the rows met and theirs."""
        states, gates, news, olds = run
        steps, lanes, h = states.shape
        flat = np.flatnonzero(valid.ravel())
        logp, back, grads = self.output(states.reshape(-1, h)[flat], target.ravel()[flat], True)
        out = np.zeros((steps * lanes, h), _F)
        out[flat] = back
        out = out.reshape(steps, lanes, h)
        pre = np.empty((steps, lanes, 2 * h), _F)
        close = gates * (1 - gates) * (news - olds)
        tail = gates * (1 - news * news)
        rest = 1 - gates
        d = np.zeros((lanes, h), _F)
        back_turn = np.ascontiguousarray(self.turn.T)
        resets = fresh.any(1)
        keep = (~fresh).astype(_F)[:, :, None]
        for t in range(steps - 1, -1, -1):
            d += out[t]
            np.multiply(d, close[t], out=pre[t, :, :h])
            np.multiply(d, tail[t], out=pre[t, :, h:])
            d = d * rest[t]
            d += pre[t] @ back_turn
            if resets[t]:
                d *= keep[t]
        pre = pre.reshape(-1, 2 * h)
        grads["turn"] = olds.reshape(-1, h).T @ pre
        ids = before.ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        grads["enter"] = ids[first], np.add.reduceat(pre[order], first, axis=0)
        return logp, grads


def lanes_of(sizes: np.ndarray, lanes: int = LANES) -> list[list[int]]:
    """Documents dealt to lanes of near equal length, the longest lane first."""
    heap = [(0, i, []) for i in range(min(lanes, len(sizes)))]
    for d in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size, i, held = heap[0]
        held.append(d)
        heapq.heapreplace(heap, (size + int(sizes[d]), i, held))
    return [held for _, _, held in sorted(heap, key=lambda x: (-x[0], x[1])) if held]


def windows(docs: list[np.ndarray], start: int, lanes: int = LANES, window: int = WINDOW):
    """Per window of documents in lanes: symbols before, targets, document starts, valid places, document of each place.

    Arrays are steps x lanes.  Lanes that have ended are left out, and windows are longer
    where few are left, up to ``LONGEST`` steps.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    dealt = lanes_of(sizes, lanes)
    if not dealt:
        return
    order = [i for held in dealt for i in held]
    target = np.concatenate([docs[i] for i in order])
    owner = np.repeat(np.array(order, np.int32), sizes[order])
    begin = np.zeros(len(target), bool)
    begin[np.cumsum(sizes[order]) - sizes[order]] = True
    before = np.empty_like(target)
    before[1:] = target[:-1]
    before[begin] = start
    size = np.array([int(sizes[held].sum()) for held in dealt])
    first, lo = np.cumsum(size) - size, 0
    while lo < size[0]:
        n = int(np.searchsorted(-size, -lo, side="left"))
        step = np.arange(lo, min(lo + max(window, min(LONGEST, window * lanes // n)), int(size[0])))
        valid = step[:, None] < size[None, :n]
        at = np.where(valid, first[None, :n] + step[:, None], 0)
        yield before[at], target[at], begin[at] & valid, valid, owner[at]
        lo = int(step[-1]) + 1


def train(net: Network, docs: list[np.ndarray], tops: dict[str, np.ndarray] | None = None, lanes: int = LANES, window: int = WINDOW, rate: float = RATE) -> int:
    """One pass over documents of symbols; the number of symbols."""
    tops = net.squares() if tops is None else tops
    state = np.zeros((lanes, net.turn.shape[0]), _F)
    for before, target, fresh, valid, _ in windows(docs, net.start, lanes, window):
        state = net.learn(before, target, fresh, valid, state[: before.shape[1]], tops, rate)
    return sum(map(len, docs))


def score(net: Network, docs: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
    """Natural log-probabilities of whole documents of symbols."""
    out = np.zeros(len(docs))
    state = np.zeros((lanes, net.turn.shape[0]), _F)
    for before, target, fresh, valid, doc in windows(docs, net.start, lanes, window):
        states = net.advance(before, fresh, state[: before.shape[1]])[0]
        state = states[-1]
        flat = np.flatnonzero(valid.ravel())
        logp = net.output(states.reshape(-1, states.shape[2])[flat], target.ravel()[flat])
        out += np.bincount(doc.ravel()[flat], logp, len(docs))
    return out
