"""Linear-chain conditional random field over sparse binary features, vectorised with numpy."""

from __future__ import annotations

import numpy as np


class Chain:
    """Emission weights (features x labels), transitions, and start and end scores."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.emission, self.transition, self.start, self.end = emission, transition, start, end

    def scores(self, features: list[list[int]]) -> np.ndarray:
        """Emission scores (clauses x labels) of feature lists, none of them empty."""
        if not features:
            return np.zeros((0, self.emission.shape[1]))
        return self._summed(*_flat(features))

    def _summed(self, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.emission[flat], begins, axis=0)

    def _padded(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(lengths.max())
        place = np.arange(width)[None, :] < lengths[:, None]
        out = np.zeros((len(lengths), width, scores.shape[1]))
        out[place] = scores
        return out, place

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Most probable labels of consecutive sequences of the given (positive) lengths."""
        if not len(lengths):
            return np.zeros(0, np.int64)
        labels = np.zeros(len(scores), np.int64)
        begins = np.cumsum(lengths) - lengths
        for block in np.array_split(np.argsort(lengths, kind="stable"), max(1, len(lengths) // 4096)):
            idx = np.concatenate([np.arange(b, b + n) for b, n in zip(begins[block], lengths[block])])
            e, place = self._padded(scores[idx], lengths[block])
            best = e[:, 0] + self.start
            back = np.zeros(e.shape, np.int64)
            for t in range(1, e.shape[1]):
                step = best[:, :, None] + self.transition[None]
                back[:, t] = step.argmax(1)
                best = np.where(place[:, t, None], step.max(1) + e[:, t], best)
            now = (best + self.end).argmax(1)
            out = np.zeros(place.shape, np.int64)
            for t in range(e.shape[1] - 1, -1, -1):
                out[:, t] = now
                now = np.where(place[:, t] & (t > 0), back[np.arange(len(now)), t, now], now)
            labels[idx] = out[place]
        return labels


def fit(features: list[list[int]], lengths: np.ndarray, labels: np.ndarray, n_features: int, n_labels: int, rounds: int = 120, l2: float = 2e-4) -> Chain:
    """Maximise the penalised conditional likelihood by full-batch Adam on forward-backward gradients."""
    k = n_labels
    width = int(lengths.max())
    place = np.arange(width)[None, :] < lengths[:, None]
    y = np.zeros(place.shape, np.int64)
    y[place] = labels
    flat, begins = _flat(features)
    owner = np.repeat(np.arange(len(features)), np.diff(np.append(begins, len(flat))))
    model = Chain(np.zeros((n_features, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k))
    params = [model.emission, model.transition, model.start, model.end]
    moment = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    last = lengths - 1
    rows = np.arange(len(lengths))
    for step in range(1, rounds + 1):
        e, _ = model._padded(model._summed(flat, begins), lengths)
        alpha = np.zeros(e.shape)
        beta = np.zeros(e.shape)
        alpha[:, 0] = e[:, 0] + model.start
        for t in range(1, width):
            alpha[:, t] = np.where(place[:, t, None], _logsum(alpha[:, t - 1, :, None] + model.transition[None], 1) + e[:, t], alpha[:, t - 1])
        z = _logsum(alpha[:, -1] + model.end, 1)
        beta[:, width - 1] = model.end
        for t in range(width - 2, -1, -1):
            onward = _logsum(model.transition[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(place[:, t + 1, None], onward, model.end)
        p = np.exp(alpha + beta - z[:, None, None]) * place[:, :, None]
        gold = np.eye(k)[y] * place[:, :, None]
        g = [np.zeros_like(q) for q in params]
        off = (gold - p)[place][owner]
        for j in range(k):
            g[0][:, j] = np.bincount(flat, weights=off[:, j], minlength=n_features)
        for t in range(1, width):
            on = place[:, t]
            pair = np.exp(alpha[on, t - 1, :, None] + model.transition[None] + (e[on, t] + beta[on, t])[:, None, :] - z[on, None, None])
            g[1] -= pair.sum(0)
            np.add.at(g[1], (y[on, t - 1], y[on, t]), 1.0)
        g[2] += (gold - p)[:, 0].sum(0)
        g[3] += (gold - p)[rows, last].sum(0)
        for q, d, m, s in zip(params, g, moment, second):
            d = d / len(lengths) - l2 * q
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            q += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def _flat(features: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All feature numbers in a row and where each clause's begin."""
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    return np.fromiter((f for x in features for f in x), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))
