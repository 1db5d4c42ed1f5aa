"""Linear classifier over hashed character n-grams, scaled by naive Bayes log-count ratios.

A feature is the presence of a byte n-gram in the lower-cased text, hashed to ``2**BITS`` places.
Its value is the log of the ratio of its smoothed document frequencies in the two classes; a
logistic regression with an L2 penalty is fitted on these values. Features that differ little
between the classes have weight 0, so scoring a text looks up all of its n-grams and
keeps few.
"""

from __future__ import annotations

import numpy as np

BITS = 18
SIZES = (3, 4, 5)
FEATURES = 6000
#: Bytes whose n-grams are held at once; memory is some 20 times as much.
WINDOW = 2 << 20

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256)
)


def _buckets(data: np.ndarray, size: int) -> np.ndarray:
    """The place of the n-gram that starts at each byte."""
    n = len(data) - size + 1
    value = np.full(n, size, dtype=np.uint32)
    for j in range(size):
        value *= np.uint32(0x01000193)
        value ^= data[j : j + n].astype(np.uint32)
    value *= np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x85EBCA77)
    return value >> np.uint32(32 - BITS)


def grams(data: bytes, offsets: list[int], wanted: np.ndarray | None = None):
    """Distinct (document, place) pairs of texts that lie one after another in ``data``.

    ``wanted``: only places where it is true.
    """
    texts = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    joined = (b" " + b" ".join(texts) + b" ").translate(_FOLD)
    flat = np.frombuffer(joined, dtype=np.uint8)
    lengths = np.diff(offsets)
    starts = np.cumsum(lengths + 1) - lengths - 1  # of the space before each text
    ends = starts + lengths + 2
    keys = []
    for first in range(0, len(flat), WINDOW):
        for size in SIZES:
            window = flat[first : first + WINDOW + size - 1]
            if len(window) < size:
                continue
            place = _buckets(window, size)
            at = np.arange(len(place)) if wanted is None else np.flatnonzero(wanted[place])
            doc = np.searchsorted(starts, at + first, side="right") - 1
            whole = at + first + size <= ends[doc]
            keys.append(doc[whole].astype(np.int64) << BITS | place[at[whole]].astype(np.int64))
        if len(keys) > 3 * len(SIZES):
            keys = [np.unique(np.concatenate(keys))]
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    return found >> BITS, found & ((1 << BITS) - 1)


class Model:
    """Weights of the places that have one, ratio included; small enough to go with a task."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float):
        self.places, self.weights, self.bias = places, weights, bias

    def __getstate__(self):
        return self.places, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def log_odds(self, data: bytes, offsets: list[int]) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << BITS)
            self._table[self.places] = self.weights
            self._wanted = self._table != 0
        out = np.full(len(offsets) - 1, self.bias)
        if len(out):
            doc, place = grams(data, offsets, self._wanted)
            out += np.bincount(doc, weights=self._table[place], minlength=len(out))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def constant(probability: float) -> Model:
    p = min(max(probability, 1e-9), 1 - 1e-9)
    return Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(p / (1 - p))))


def fit(texts: list[bytes], labels: np.ndarray, share: float, penalty: float = 1e-3) -> Model:
    """Fits on texts with labels 0 and 1; ``share`` is the share of label 1 outside this sample."""
    y = np.asarray(labels, dtype=np.float64)
    n = len(y)
    if not n or y.min() == y.max():
        return constant(share)
    frequency = np.zeros((2, 1 << BITS))
    step = 200  # texts; their n-grams are held window by window
    for i in range(0, n, step):
        part = texts[i : i + step]
        doc, place = grams(b"".join(part), np.cumsum([0, *map(len, part)]).tolist())
        label = y[i : i + step][doc] > 0.5
        frequency[1] += np.bincount(place[label], minlength=1 << BITS)
        frequency[0] += np.bincount(place[~label], minlength=1 << BITS)
    size = np.array([n - y.sum(), y.sum()])
    rate = (frequency + 0.5) / (size[:, None] + 1)
    ratio = np.log(rate[1] / rate[0])
    mean = frequency.sum(axis=0) / n
    spread = np.sqrt(mean * (1 - mean) * (1 / size[0] + 1 / size[1]))
    strength = np.abs(frequency[1] / size[1] - frequency[0] / size[0]) / np.maximum(spread, 1e-12)
    strength[frequency.sum(axis=0) < 3] = 0
    chosen = np.argsort(-strength, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[strength[chosen] > 2])
    if not len(chosen):
        return constant(share)
    column = np.full(1 << BITS, -1)
    column[chosen] = np.arange(len(chosen))
    rows, cols = [], []
    for i in range(0, n, step):
        part = texts[i : i + step]
        doc, place = grams(b"".join(part), np.cumsum([0, *map(len, part)]).tolist(), column >= 0)
        rows.append(doc + i)
        cols.append(column[place])
    row, col = np.concatenate(rows), np.concatenate(cols)
    value = ratio[chosen][col]
    w, b = np.zeros(len(chosen)), 0.0
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, 151):
        z = np.bincount(row, weights=value * w[col], minlength=n) + b
        error = (sigmoid(z) - y) / n
        gradient = np.r_[
            np.bincount(col, weights=value * error[row], minlength=len(w)) + penalty * w, error.sum()
        ]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        rate_t = 0.03 * (1 - t / 160)
        w -= rate_t * move[:-1]
        b -= rate_t * move[-1]
    share = min(max(share, 1e-6), 1 - 1e-6)
    shift = np.log(share / (1 - share)) - np.log(size[1] / size[0])
    return Model(chosen, w * ratio[chosen], float(b + shift))
