"""Linear-chain conditional random field over dense features: fitting by exact gradients, decoding by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """emit: features x labels; step[i, j]: from label i to j; first: of the first position; mean, scale: of the features."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.emit[:-1] + self.emit[-1]

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label of each row of x, which holds sequences of these lengths one after another. All sequences advance
        together, longest first, so the work is in proportion to the rows; ties go to the lower label."""
        out = np.zeros(len(x), dtype=np.int8)
        lengths = np.asarray(lengths, dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return out
        e, begin, lengths = self.scores(x), begin[order], lengths[order]
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # how many sequences are longer than t
        best = self.first + e[begin]
        back = [np.zeros((len(begin), len(self.first)), np.int8)]
        for t in range(1, lengths[0]):
            m = live[t]
            come = best[:m, :, None] + self.step
            back.append(come.argmax(1).astype(np.int8))
            best[:m] = come.max(1) + e[begin[:m] + t]
        label = best.argmax(1)
        for t in range(lengths[0] - 1, -1, -1):
            m = live[t]
            out[begin[:m] + t] = label[:m]
            if t:
                label[:m] = back[t][np.arange(m), label[:m]]
        return out


def _padded(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pieces, at = [], 0
    for n in lengths:
        pieces += [(at + k, min(most, n - k)) for k in range(0, n, most)]
        at += n
    size = max(n for _, n in pieces)
    px, py, mask = np.zeros((len(pieces), size, x.shape[1])), np.zeros((len(pieces), size), int), np.zeros((len(pieces), size))
    for k, (at, n) in enumerate(pieces):
        px[k, :n], py[k, :n], mask[k, :n] = x[at : at + n], y[at : at + n], 1
    return px, py, mask


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def fit(x: np.ndarray, y: np.ndarray, lengths, labels: int = 2, l2: float = 1e-3, steps: int = 250, rate: float = 0.08, piece: int = 48) -> Chain:
    """Maximum likelihood with an L2 penalty by Adam from a zero start; sequences over piece rows are cut for fitting."""
    x, y, lengths = np.asarray(x, float), np.asarray(y, int), [int(n) for n in lengths if n]
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    px, py, mask = _padded(np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), y, lengths, piece)
    px[mask == 0] = 0
    s, size, d = px.shape
    total = mask.sum()
    weights = [np.zeros((d, labels)), np.zeros((labels, labels)), np.zeros(labels)]
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    onehot = np.eye(labels)[py] * mask[..., None]
    pair_mask = mask[:, 1:] * mask[:, :-1]
    seen_pairs = np.einsum("sti,stj->ij", onehot[:, :-1], onehot[:, 1:])
    for it in range(1, steps + 1):
        emit, step, first = weights
        e = px @ emit
        fwd, bwd = np.zeros((s, size, labels)), np.zeros((s, size, labels))
        fwd[:, 0] = first + e[:, 0]
        for t in range(1, size):
            new = _logsum(fwd[:, t - 1, :, None] + step, 1) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None] > 0, new, fwd[:, t - 1])
        for t in range(size - 2, -1, -1):
            new = _logsum(step + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
        z = _logsum(fwd[:, -1], 1)
        post = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        pair = np.exp(fwd[:, :-1, :, None] + step + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair_mask[..., None, None]
        gap = onehot - post
        grads = [
            np.einsum("std,stk->dk", px, gap) / total - l2 * emit,
            (seen_pairs - pair.sum((0, 1))) / total - l2 * step,
            gap[:, 0].sum(0) / total - l2 * first,
        ]
        for w, g, (m, v) in zip(weights, grads, moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return Chain(*weights, mean, scale)
