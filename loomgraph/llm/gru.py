"""A gated recurrent language model in numpy: truncated backpropagation, class-factored output, states carried across windows."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: The logit of a word that does not exist.
_NEVER = np.float32(-1e9)


@dataclass(frozen=True)
class Shape:
    """Head words have an identifier each, ``class_words`` to a class; all other words share ``tails`` classes, within which they are told by counts."""

    classes: int = 32
    class_words: int = 32
    tails: int = 32
    hidden: int = 16

    @property
    def head(self) -> int:
        return self.classes * self.class_words

    @property
    def start(self) -> int:
        """The input before a text's first token; the identifiers below it are head words, then tails."""
        return self.head + self.tails


@dataclass(frozen=True)
class Training:
    """``window``: steps of backpropagation; ``lanes``: texts read side by side."""

    window: int = 16
    lanes: int = 512
    rate: float = 0.1
    clip: float = 64.0


Weights = dict[str, np.ndarray]


def initial(shape: Shape, head_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 42) -> Weights:
    """Weights whose first guess, whatever the state, is the corpus's own frequencies."""
    rng, h = np.random.default_rng(seed), shape.hidden
    normal = lambda *n: rng.normal(0, 0.1, n)
    counts = np.zeros(shape.head)
    counts[: len(head_counts)] = head_counts
    by_class = counts.reshape(shape.classes, shape.class_words)
    log = lambda n, total: np.where(n > 0, np.log(np.maximum(n, 1) / np.maximum(total, 1)), _NEVER)
    by_tail = tail_counts + 1.0
    total = counts.sum() + by_tail.sum()
    out = {
        "inputs": normal(shape.start + 1, 3 * h),
        "recur": rng.normal(0, h**-0.5, (h, 3 * h)),
        "class_w": normal(h, shape.classes + shape.tails),
        "class_b": np.concatenate([log(by_class.sum(1), total), np.log(by_tail / total)]),
        "word_w": normal(shape.classes, h, shape.class_words),
        "word_b": log(by_class, by_class.sum(1, keepdims=True)),
    }
    out["inputs"][:, :h] -= 1  # new input comes in slowly
    return {k: v.astype(np.float32) for k, v in out.items()}


def pack(w: Weights) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in sorted(w))


def unpack(raw: bytes, like: Weights) -> Weights:
    flat, at, out = np.frombuffer(raw, "<f4"), 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


class Lanes:
    """Texts dealt to lanes, the longest first, each to the shortest lane; a lane reads its texts one after the other."""

    def __init__(self, texts: list[np.ndarray], lanes: int):
        sizes = np.array(list(map(len, texts)), np.int64)
        heap = [(0, k) for k in range(min(lanes, max(1, len(texts))))]
        dealt: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-sizes, kind="stable").tolist():
            length, k = heapq.heappop(heap)
            dealt[k].append(i)
            heapq.heappush(heap, (length + int(sizes[i]), k))
        dealt.sort(key=lambda own: -int(sizes[own].sum()))
        order = [i for own in dealt for i in own]
        self.lengths = np.array([int(sizes[own].sum()) for own in dealt], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.tokens = np.concatenate([texts[i] for i in order]).astype(np.int64) if order else np.zeros(0, np.int64)
        self.owner = np.repeat(np.array(order, np.int64), sizes[order])
        self.first = np.zeros(len(self.tokens), bool)
        ends = np.cumsum(sizes[order])
        self.first[(ends - sizes[order])[sizes[order] > 0]] = True

    def windows(self, steps: int):
        """(places, held) of each window: of step t and lane k the place in ``tokens``, and whether the lane still has one there."""
        for t in range(0, int(self.lengths.max(initial=0)), steps):
            live = int((self.lengths > t).sum())  # lanes are sorted by length
            at = t + np.arange(min(steps, int(self.lengths[0]) - t))[:, None]
            held = at < self.lengths[:live]
            yield np.where(held, self.starts[:live] + at, self.starts[:live]), held


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _by_value(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts small ``ids``, where in it each value begins)."""
    order = np.argsort(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, kind="stable")
    s = ids[order]
    return order, np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else order


def _states(w: Weights, h: np.ndarray, inputs: np.ndarray, first: np.ndarray, keep: bool):
    """States after each step, from ``h``; where a text begins the state is zero before. What backpropagation needs, if ``keep``."""
    n, recur = h.shape[1], w["recur"]
    given = w["inputs"][inputs]
    out = np.empty((*inputs.shape, n), np.float32)
    kept = []
    for t in range(len(inputs)):
        if first[t].any():
            h = np.where(first[t][:, None], np.float32(0), h)
        own, pull = given[t], h @ recur
        gates = _sigmoid(own[:, : 2 * n] + pull[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(own[:, 2 * n :] + r * pull[:, 2 * n :])
        if keep:
            kept.append((h, gates, c, pull[:, 2 * n :]))
        h = h + z * (c - h)
        out[t] = h
    return h, out, kept


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and the log of their sum before scaling. Logits are log frequencies and what a state adds, far below what overflows."""
    p = np.exp(np.minimum(logits, 80, out=logits))
    total = np.maximum(p @ np.ones(p.shape[1], p.dtype), 1e-30)  # a class without words has none
    p /= total[:, None]
    return p, np.log(total)


def _outputs(w: Weights, shape: Shape, h: np.ndarray, tokens: np.ndarray, grads: Weights | None):
    """(natural log probability of each token, its class only if a tail; the gradient of ``h``). Adds to ``grads``."""
    head = tokens < shape.head
    cls = np.where(head, tokens // shape.class_words, shape.classes + tokens - shape.head)
    logits = h @ w["class_w"]
    logits += w["class_b"]
    p, total = _softmax(logits)
    every = np.arange(len(tokens))
    found = logits[every, cls].astype(np.float64) - total
    back = None
    if grads is not None:
        p[every, cls] -= 1
        grads["class_w"] += h.T @ p
        grads["class_b"] += p.sum(0)
        back = p @ w["class_w"].T
    own = np.flatnonzero(head)
    order, begins = _by_value(cls[own])
    own = own[order]
    held, words = h[own], tokens[own] % shape.class_words
    for was, end in zip(begins.tolist(), [*begins[1:].tolist(), len(own)]):
        at, hk, word = own[was:end], held[was:end], words[was:end]
        k = cls[at[0]]
        logits = hk @ w["word_w"][k]
        logits += w["word_b"][k]
        p, total = _softmax(logits)
        within = np.arange(len(at))
        found[at] += logits[within, word] - total
        if grads is not None:
            p[within, word] -= 1
            grads["word_w"][k] += hk.T @ p
            grads["word_b"][k] += p.sum(0)
            back[at] += p @ w["word_w"][k].T
    return found, back


def _backward(w: Weights, grads: Weights, inputs: np.ndarray, first: np.ndarray, kept: list, back: np.ndarray) -> None:
    """Gradients of the recurrent layer over one window; ``back``: those of its states."""
    n, recur = back.shape[2], w["recur"]
    given, pulled = np.empty((*inputs.shape, 3 * n), np.float32), np.empty((*inputs.shape, 3 * n), np.float32)
    carry = np.zeros_like(back[0])
    for t in reversed(range(len(inputs))):
        h, gates, c, pull = kept[t]
        z, r = gates[:, :n], gates[:, n:]
        d = back[t] + carry
        own, to = given[t], pulled[t]
        own[:, 2 * n :] = d * z * (1 - c * c)
        own[:, :n] = d * (c - h)
        own[:, n : 2 * n] = own[:, 2 * n :] * pull
        own[:, : 2 * n] *= gates * (1 - gates)
        to[:, : 2 * n] = own[:, : 2 * n]
        to[:, 2 * n :] = own[:, 2 * n :] * r
        carry = d * (1 - z) + to @ recur.T
        if first[t].any():
            carry[first[t]] = 0
    states = np.stack([k[0] for k in kept])
    grads["recur"] += states.reshape(-1, n).T @ pulled.reshape(-1, 3 * n)
    flat, given = inputs.ravel(), given.reshape(-1, 3 * n)
    order, at = _by_value(flat)
    grads["inputs"][flat[order[at]]] += np.add.reduceat(given[order], at, axis=0)


def _read(lanes: Lanes, shape: Shape, steps: int):
    """(inputs, tokens, first, held, owners) of each window."""
    for at, held in lanes.windows(steps):
        first = lanes.first[at]
        yield np.where(first, shape.start, lanes.tokens[np.maximum(at - 1, 0)]), lanes.tokens[at], first, held, lanes.owner[at]


class Trainer:
    """Truncated backpropagation with steps scaled by each weight's own past gradients."""

    def __init__(self, weights: Weights, shape: Shape, how: Training = Training()):
        self.w, self.shape, self.how = {k: v.copy() for k, v in weights.items()}, shape, how
        self.past = {k: np.full_like(v, 1e-2) for k, v in weights.items()}
        self.tokens = 0

    def gradients(self, h: np.ndarray, window: tuple) -> tuple[np.ndarray, Weights, float]:
        """(state after the window, gradients of its summed loss, that loss)."""
        inputs, tokens, first, held, _ = window
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        h, out, kept = _states(self.w, h, inputs, first, True)
        flat = held.ravel()
        found, own = _outputs(self.w, self.shape, out.reshape(-1, out.shape[2])[flat], tokens.ravel()[flat], grads)
        back = np.zeros((flat.size, out.shape[2]), np.float32)
        back[flat] = own
        _backward(self.w, grads, inputs, first, kept, back.reshape(out.shape))
        return h, grads, -float(found.sum())

    def read(self, texts: list[np.ndarray]) -> None:
        """One pass over ``texts``, whole, each from a state of zero."""
        lanes = Lanes(texts, self.how.lanes)
        h = np.zeros((len(lanes.lengths), self.shape.hidden), np.float32)
        for window in _read(lanes, self.shape, self.how.window):
            h, grads, _ = self.gradients(h[: window[0].shape[1]], window)
            for k, g in grads.items():
                np.clip(g, -self.how.clip, self.how.clip, out=g)
                self.past[k] += g * g
                self.w[k] -= self.how.rate * g / np.sqrt(self.past[k])
        self.tokens += len(lanes.tokens)


def log10_likelihoods(w: Weights, shape: Shape, texts: list[np.ndarray], lanes: int = 512, steps: int = 32) -> np.ndarray:
    """The log10 probability of each whole text, tails by their class alone; the state goes on from window to window."""
    dealt, total = Lanes(texts, lanes), np.zeros(len(texts))
    h = np.zeros((len(dealt.lengths), shape.hidden), np.float32)
    for inputs, tokens, first, held, owner in _read(dealt, shape, steps):
        h, out, _ = _states(w, h[: inputs.shape[1]], inputs, first, False)
        found, _ = _outputs(w, shape, out[held], tokens[held], None)
        total += np.bincount(owner[held], found, minlength=len(texts))
    return total / np.log(10)
