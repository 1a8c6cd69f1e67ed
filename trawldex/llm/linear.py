"""Multinomial logistic regression on hashed word n-grams, trained on a bounded sample and applied to whole texts."""

from __future__ import annotations

import numpy as np

from trawldex.llm.arrays import PLAIN, mix, word_hashes

_KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def features(x: np.ndarray, starts: np.ndarray, bits: int, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of the word n-grams (n up to `orders`) of texts laid end to end, by text; the first feature
    and the number of words of each text."""
    w, at = word_hashes(x, starts, PLAIN)
    words = np.diff(at)
    text = np.repeat(np.arange(len(words)), words)
    parts, owners = [], []
    key = np.zeros(len(w), np.uint64)
    for n in range(orders):
        key = key[: len(w) - n] + w[n:] * _KEYS[n] if n else w * _KEYS[0]
        inside = np.arange(len(key)) + n < at[1:][text[: len(key)]]
        parts.append((mix(key[inside], 0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(text[: len(key)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(len(words) + 1)), words


def distinct(index: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's features once."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    both = np.unique((text << bits) | index)
    return both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(len(at)))


class Softmax:
    """Weights (features x classes), bias and temperature; small enough to be sent to every task (2^bits x classes)."""

    def __init__(self, bits: int, orders: int, classes: list[str], once: bool = True):
        """once: a text's repeated n-gram counts once; else as often as it occurs, as it does in `spans`."""
        self.bits, self.orders, self.classes, self.once = bits, orders, classes, once
        self.weights = np.zeros((1 << bits, len(classes)), np.float32)
        self.bias = np.zeros(len(classes), np.float32)
        self.temperature = 1.0

    def scores(self, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.tile(self.bias.astype(np.float64), (len(at) - 1, 1))
        some = np.flatnonzero(np.diff(at))
        if len(some):
            out[some] += np.add.reduceat(self.weights[index], at[some], axis=0) / np.sqrt(np.diff(at)[some])[:, None]
        return out

    def posteriors(self, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.scores(index, at) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors and numbers of words of texts."""
        x = np.frombuffer(b"".join(texts), np.uint8)
        index, at, words = features(x, np.cumsum([0] + [len(t) for t in texts]), self.bits, self.orders)
        return self.posteriors(*(distinct(index, at, self.bits) if self.once else (index, at))), words

    def spans(self, w: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Posteriors of the runs of words [start, end), which may overlap, of word hashes w (for once=False)."""
        z, n = np.zeros((len(start), len(self.classes))), np.zeros(len(start), np.int64)
        key = np.zeros(len(w), np.uint64)
        for o in range(self.orders):
            key = key[: len(w) - o] + w[o:] * _KEYS[o] if o else w * _KEYS[0]
            index = (mix(key, 0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)
            total = np.zeros((len(key) + 1, len(self.classes)))
            np.cumsum(self.weights[index], axis=0, dtype=np.float64, out=total[1:])
            stop = np.maximum(start, end - o)
            z += total[np.minimum(stop, len(key))] - total[np.minimum(start, len(key))]
            n += stop - start
        z = (self.bias + z / np.sqrt(np.maximum(1, n))[:, None]) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 60, rate: float = 0.5, ridge: float = 1e-6, held_out: int = 5) -> Softmax:
        """Adaptive gradient descent over all given texts; every `held_out`-th sets the temperature only."""
        x = np.frombuffer(b"".join(texts), np.uint8)
        index, at, _ = features(x, np.cumsum([0] + [len(t) for t in texts]), self.bits, self.orders)
        if self.once:
            index, at = distinct(index, at, self.bits)
        aside = np.arange(len(texts)) % held_out == held_out - 1
        y = np.eye(len(self.classes))[labels]
        n = np.diff(at)
        scale = 1 / np.sqrt(np.maximum(1, n))
        use = np.repeat(~aside, n)
        text = np.repeat(np.arange(len(texts)), n)[use]
        feature = index[use]
        order = np.argsort(feature, kind="stable")
        text, feature = text[order], feature[order]
        cut = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]]) if len(feature) else np.zeros(0, np.int64)
        seen = feature[cut]
        grown, grown_bias = np.full((len(seen), y.shape[1]), 1e-8), np.full(y.shape[1], 1e-8)
        share = 1 / np.maximum(1, y[~aside].sum(axis=0))  # classes count alike
        weight = (y * share).sum(axis=1, keepdims=True) * (~aside)[:, None]
        for _ in range(epochs if len(seen) else 0):
            error = (self.posteriors(index, at) - y) * weight
            g = np.add.reduceat((error * scale[:, None])[text], cut, axis=0) + ridge * self.weights[seen]
            grown += g * g
            self.weights[seen] -= (rate * g / np.sqrt(grown)).astype(np.float32)
            b = error.sum(axis=0)
            grown_bias += b * b
            self.bias -= (rate * b / np.sqrt(grown_bias)).astype(np.float32)
        if aside.any():
            z = self.scores(index, at)[aside]
            right = labels[aside]

            def loss(t: float) -> float:
                s = z / t
                s = s - s.max(axis=1, keepdims=True)
                return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), right]).mean())

            self.temperature = min((float(t) for t in np.geomspace(0.05, 4, 40)), key=loss)
        return self


#: Bytes of signs: neither word, nor white space, nor part of a character beyond ASCII.
_SIGN = ~PLAIN
_SIGN[[*range(0x09, 0x0E), 0x20]] = False


class Bag:
    """Multinomial logistic regression on the words and runs of signs of a text, weighted by rarity (tf-idf, unit length).

    Fitted without class weights, so that posteriors follow the classes' shares; the temperature is set on a fifth of the texts
    that the weights have not seen, and `report` holds how many of each class these are and the share that is recognised.
    """

    def __init__(self, bits: int, classes: list[str]):
        self.bits, self.classes = bits, classes
        self.weights = np.zeros((1 << bits, len(classes)), np.float32)
        self.bias = np.zeros(len(classes), np.float32)
        self.rarity = np.ones(1 << bits, np.float32)
        self.temperature = 1.0
        self.report: dict[str, tuple[int, float]] = {}

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, times) for every distinct feature, by text, and the number of words of each text."""
        x = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.cumsum([0] + [len(t) for t in texts])
        shift, parts = np.uint64(64 - self.bits), []
        for letters, key in ((PLAIN, 0xD6E8FEB86659FD93), (_SIGN, 0x9FB21C651E98DF25)):
            w, at = word_hashes(x, starts, letters)
            n = np.diff(at)
            parts.append(np.repeat(np.arange(len(n)), n) << self.bits | (mix(w, key) >> shift).astype(np.int64))
            if letters is PLAIN:
                words = n
        both, times = np.unique(np.concatenate(parts), return_counts=True)
        return both >> self.bits, both & ((1 << self.bits) - 1), times, words

    def values(self, owner: np.ndarray, feature: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        v = self.rarity[feature] * (1 + np.log(times))
        size = np.sqrt(np.bincount(owner, v * v, minlength=n))
        return v / np.maximum(size, 1e-9)[owner]

    def scores(self, owner: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.stack([np.bincount(owner, value * self.weights[feature, k], minlength=n) for k in range(len(self.classes))], axis=1)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors and numbers of words of texts."""
        owner, feature, times, words = self.features(texts)
        z = self.scores(owner, feature, self.values(owner, feature, times, len(texts)), len(texts)) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), words

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 100, rate: float = 5.0, ridge: float = 1e-5, held_out: int = 5) -> Bag:
        """rows: (features, times) of each text. Of all steps, the weights with the least loss on the held-out texts stay."""
        n = len(rows)
        owner = np.repeat(np.arange(n), [len(f) for f, _ in rows])
        feature, times = (np.concatenate([r[i] for r in rows]).astype(np.int64) for i in (0, 1))
        aside = np.arange(n) % held_out == held_out - 1
        seen = np.bincount(feature[~aside[owner]], minlength=1 << self.bits)
        self.rarity = np.log(((~aside).sum() + 1) / (seen + 1)).astype(np.float32)
        value = self.values(owner, feature, times, n)
        use = np.flatnonzero(~aside[owner])
        use = use[np.argsort(feature[use], kind="stable")]
        cut = np.flatnonzero(np.r_[True, feature[use][1:] != feature[use][:-1]]) if len(use) else use
        mine = feature[use][cut]
        y = np.eye(len(self.classes))[labels]
        grown, grown_bias = np.full((len(mine), y.shape[1]), 1e-8), np.full(y.shape[1], 1e-8)
        best = (np.inf, self.weights[mine], self.bias.copy())
        for _ in range(epochs if len(mine) else 0):
            z = self.scores(owner, feature, value, n)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            lost = -np.log(np.maximum(p[aside, labels[aside]], 1e-300)).mean() if aside.any() else 0.0
            if lost <= best[0]:
                best = (lost, self.weights[mine], self.bias.copy())
            error = (p - y) * (~aside)[:, None] / (~aside).sum()
            g = np.add.reduceat(value[use, None] * error[owner[use]], cut, axis=0) + ridge * self.weights[mine]
            grown += g * g
            self.weights[mine] -= (rate * g / np.sqrt(grown)).astype(np.float32)
            b = error.sum(axis=0)
            grown_bias += b * b
            self.bias -= (rate * b / np.sqrt(grown_bias)).astype(np.float32)
        self.weights[mine], self.bias = best[1:]
        if aside.any():
            z, right = self.scores(owner, feature, value, n)[aside], labels[aside]

            def loss(t: float) -> float:
                s = z / t - (z / t).max(axis=1, keepdims=True)
                return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), right]).mean())

            self.temperature = min((float(t) for t in np.geomspace(0.25, 8, 50)), key=loss)
            named = z.argmax(axis=1)
            self.report = {c: (int((right == k).sum()), float((named[right == k] == k).mean()) if (right == k).any() else 0.0) for k, c in enumerate(self.classes)}
        return self
