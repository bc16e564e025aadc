"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

The vocabulary of the network is bounded: ``HEAD`` frequent words, each in a class of ``CLASS_WORDS``, and
``TAIL`` classes for all other words. A head word has probability P(class | state) P(word | class, state); a
tail word P(class | state) P(word | class), the latter from discounted counts, with a share for words never seen
that their spellings divide among them (see ``lm``): the probabilities of all words add up to one at most.
"""

from __future__ import annotations

import ctypes
import heapq
import os

import numpy as np

HEAD, CLASS_WORDS, TAIL = 1024, 64, 48
HEAD_CLASSES = HEAD // CLASS_WORDS
CLASSES = HEAD_CLASSES + TAIL
HIDDEN = 16
#: Tokens of a window of backpropagation, and documents side by side; where fewer go on, windows get longer, up to a bound.
WINDOW, LANES, LONGEST_WINDOW = 16, 256, 128
END = 0
DISCOUNT = 0.75

#: Codes: 0 .. HEAD - 1 are head words (0 the end), HEAD + k is a word of tail class k.
_SHAPES = {"emb": (HEAD + TAIL, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ww": (HEAD_CLASSES, HIDDEN, CLASS_WORDS), "bw": (HEAD_CLASSES, CLASS_WORDS)}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


def one_thread() -> None:
    """Matrix products of this process by one thread: tasks share the cores, and products this small only wait for others."""
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as maps:
        libraries = {line.split()[-1] for line in maps if "openblas" in line}
    for path in libraries:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(head_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Small random weights; the biases start as the classes' and words' log frequencies."""
    rng = np.random.default_rng(seed)
    flat = (rng.standard_normal(SIZE) * 0.1).astype(np.float32)
    p = views(flat)
    p["u"][...] = rng.standard_normal(p["u"].shape) / np.sqrt(HIDDEN)
    words = head_counts.reshape(HEAD_CLASSES, CLASS_WORDS) + 0.01
    classes = np.concatenate([words.sum(1), tail_counts + 1.0])
    p["bc"][...] = np.log(classes / classes.sum())
    p["bw"][...] = np.log(words / words.sum(1, keepdims=True))
    p["emb"][:, :HIDDEN] += 0.5
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


class Streams:
    """Documents laid end to end in lanes of nearly equal length, longest lane first."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, lanes: int):
        lanes = max(1, min(lanes, len(lengths)))
        heap = [(0, i) for i in range(lanes)]
        members: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-lengths, kind="stable").tolist():
            total, i = heapq.heappop(heap)
            members[i].append(d)
            heapq.heappush(heap, (total + int(lengths[d]), i))
        sizes = np.array([int(lengths[m].sum()) for m in members], np.int64)
        order = np.argsort(-sizes, kind="stable")
        start = np.cumsum(lengths) - lengths
        docs = np.array([d for i in order for d in members[i]], np.int64)
        n = lengths[docs]
        #: For each place in the lanes, the token's place in the input.
        self.source = np.repeat(start[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.size = sizes[order]
        self.at = np.cumsum(self.size) - self.size
        self.y = codes[self.source]
        self.first = np.zeros(len(self.y), bool)
        self.first[np.cumsum(n) - n] = True
        self.x = np.concatenate([[END], self.y[:-1]])
        self.x[self.first] = END

    def windows(self, width: int):
        """(places, valid) of each window: arrays of (steps, lanes that are still going on), of nearly as many tokens each."""
        t, lanes = 0, len(self.size)
        while lanes and t < int(self.size[0]):
            m = int(np.searchsorted(-self.size, -t, side="left"))
            steps = min(max(width, LONGEST_WINDOW), width * lanes // m, int(self.size[0]) - t)
            step = np.arange(t, t + steps)[:, None]
            valid = step < self.size[:m]
            yield self.at[:m] + np.minimum(step, self.size[:m] - 1), valid
            t += steps


def _recur(p, x: np.ndarray, first: np.ndarray, h: np.ndarray, tape: list | None):
    """States after each token of the window (width, lanes, HIDDEN); ``tape`` takes what the way back needs."""
    pre = p["emb"][x]
    out = np.empty((*x.shape, HIDDEN), np.float32)
    any_first = first.any(1)
    for t in range(len(x)):
        if any_first[t]:
            h = h * ~first[t][:, None]
        a = h @ p["u"]
        gates = _sigmoid(pre[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(pre[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        if tape is not None:
            tape.append((h, z, r, n, a[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        out[t] = h
    return out, h


def _softmax_gradient(p: np.ndarray, total: np.ndarray, at: tuple, n: int) -> None:
    """In place, from exponentials and their sums: the gradient of the mean over ``n`` tokens by the logits."""
    p *= (1 / (total * n)).astype(p.dtype)[:, None]
    p[at] -= 1 / n


def _output(p, hs: np.ndarray, y: np.ndarray, grads: dict | None = None):
    """Natural log probabilities of class and head word for each row; with ``grads`` also the states' gradient.

    Head words are sorted by class, so a class is a slice and what goes by element runs over all classes at once.
    """
    cls = np.where(y < HEAD, y // CLASS_WORDS, y - HEAD + HEAD_CLASSES)
    logits = hs @ p["wc"]
    logits += p["bc"]
    np.clip(logits, -60, 60, out=logits)
    rows = np.arange(len(y))
    own = logits[rows, cls]
    np.exp(logits, out=logits)
    total = logits @ np.ones(CLASSES, logits.dtype)
    lp = own - np.log(total)
    dh = None
    if grads is not None:
        _softmax_gradient(logits, total, (rows, cls), len(y))
        grads["wc"] += hs.T @ logits
        grads["bc"] += np.ones(len(y), logits.dtype) @ logits
        dh = logits @ p["wc"].T
    order = np.argsort(cls.astype(np.int16), kind="stable")
    edge = np.searchsorted(cls[order], np.arange(HEAD_CLASSES + 1)).tolist()
    order = order[: edge[-1]]
    if not len(order):
        return lp, dh
    h = hs[order]
    g = np.empty((len(order), CLASS_WORDS), logits.dtype)
    spans = [(k, slice(i, j)) for k, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if i < j]
    for k, seg in spans:
        np.matmul(h[seg], p["ww"][k], out=g[seg])
        g[seg] += p["bw"][k]
    np.clip(g, -60, 60, out=g)
    at = rows[: len(order)], y[order] % CLASS_WORDS
    own = g[at]
    np.exp(g, out=g)
    total = g @ np.ones(CLASS_WORDS, g.dtype)
    lp[order] += own - np.log(total)
    if grads is not None:
        _softmax_gradient(g, total, at, len(y))
        back, ones = np.empty_like(h), np.ones(len(order), g.dtype)
        for k, seg in spans:
            grads["ww"][k] += h[seg].T @ g[seg]
            grads["bw"][k] += ones[seg] @ g[seg]
            np.matmul(g[seg], p["ww"][k].T, out=back[seg])
        dh[order] += back
    return lp, dh


def window_gradient(p, grads, x, y, first, valid, h):
    """Loss of one window and the state after it; adds the gradients, cut off at the window's begin."""
    tape: list = []
    hs, h_next = _recur(p, x, first, h, tape)
    where = np.flatnonzero(valid.ravel())
    lp, dh = _output(p, hs.reshape(-1, HIDDEN)[where], y.ravel()[where], grads)
    full = np.zeros((valid.size, HIDDEN), np.float32)
    full[where] = dh
    full = full.reshape(hs.shape)
    # What does not depend on the steps after it is made for the whole window at once.
    prev, z, r, n, a_n = (np.stack(column) for column in zip(*tape, strict=True))
    keep = 1 - z
    by_z = (prev - n) * z * keep
    by_n = keep * (1 - n * n)
    by_r = a_n * r * (1 - r)
    carry = np.zeros_like(h)
    d_pre = np.empty((*x.shape, 3 * HIDDEN), np.float32)
    da = np.empty((*x.shape, 3 * HIDDEN), h.dtype)
    back, any_first = np.ascontiguousarray(p["u"].T), first.any(1)
    for t in range(len(x) - 1, -1, -1):
        dh = full[t] + carry
        dn = dh * by_n[t]
        np.multiply(dh, by_z[t], out=da[t, :, :HIDDEN])
        np.multiply(dn, by_r[t], out=da[t, :, HIDDEN : 2 * HIDDEN])
        np.multiply(dn, r[t], out=da[t, :, 2 * HIDDEN :])
        d_pre[t, :, 2 * HIDDEN :] = dn
        carry = da[t] @ back
        dh *= z[t]
        carry += dh
        if any_first[t]:
            carry *= ~first[t][:, None]
    d_pre[:, :, : 2 * HIDDEN] = da[:, :, : 2 * HIDDEN]
    grads["u"] += prev.reshape(-1, HIDDEN).T @ da.reshape(-1, 3 * HIDDEN)
    flat_x = x.ravel()
    order = np.argsort(flat_x.astype(np.int16), kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(flat_x[order]) != 0]))
    grads["emb"][flat_x[order[edges]]] += np.add.reduceat(d_pre.reshape(-1, 3 * HIDDEN)[order], edges, axis=0)
    return -lp.mean(), h_next


class Adam:
    def __init__(self, size: int):
        self.m, self.v, self.t = np.zeros(size, np.float32), np.zeros(size, np.float32), 0

    def step(self, flat: np.ndarray, g: np.ndarray, rate: float, clip: float = 1.0) -> None:
        norm = float(np.sqrt(g @ g))
        if not np.isfinite(norm):
            return
        if norm > clip:
            g *= clip / norm
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.005 * (g * g - self.v)
        flat -= rate / (1 - 0.9**self.t) * self.m / (np.sqrt(self.v / (1 - 0.995**self.t)) + 1e-8)


def train(flat: np.ndarray, codes: np.ndarray, lengths: np.ndarray, rate: float, passes: int = 1) -> np.ndarray:
    """The weights after ``passes`` over all documents, in windows of WINDOW tokens with carried states: a gradient step on each."""
    flat = flat.copy()
    if not len(lengths):
        return flat
    p = views(flat)
    lanes = int(np.clip(int(lengths.sum()) // (WINDOW * 40), 8, LANES))
    streams, adam = Streams(codes, lengths, lanes), Adam(SIZE)
    total = int(lengths.sum()) * passes
    g = np.zeros(SIZE, np.float32)
    grads, done = views(g), 0
    for _ in range(passes):
        h = np.zeros((len(streams.size), HIDDEN), np.float32)
        for places, valid in streams.windows(WINDOW):
            m = places.shape[1]
            done += int(valid.sum())
            g[:] = 0
            _, h = window_gradient(p, grads, streams.x[places], streams.y[places], streams.first[places], valid, h[:m])
            adam.step(flat, g, rate * (1 - 0.9 * done / total) * min(1.0, valid.sum() / (0.25 * WINDOW * lanes)))
    return flat


def log_likelihood(flat: np.ndarray, codes: np.ndarray, lengths: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Natural log probability of class and head word for every token, in the input's order; states run through whole documents."""
    p = views(flat)
    out = np.zeros(len(codes))
    if not len(lengths):
        return out
    streams = Streams(codes, lengths, lanes)
    h = np.zeros((len(streams.size), HIDDEN), np.float32)
    for places, valid in streams.windows(2 * WINDOW):
        m = places.shape[1]
        hs, h = _recur(p, streams.x[places], streams.first[places], h[:m], None)
        where = np.flatnonzero(valid.ravel())
        lp, _ = _output(p, hs.reshape(-1, HIDDEN)[where], streams.y[places].ravel()[where])
        out[streams.source[places.ravel()[where]]] = lp
    return out
