"""Linear-chain conditional random fields over many short vectors of scores, in
numpy: exact forward-backward and Viterbi for all chains of a batch at once, and
training by AdaGrad on hashed features.

A batch is one long chain of n positions with a score matrix ``emit`` [n, L];
``first`` marks where chains begin, at which the past is forgotten.
"""

from __future__ import annotations

import numpy as np

_STEP = 128


def _blocks(potential: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Matrices M[t] with M[t][i, j] = potential of j after i, in blocks [K, B, L, L];
    positions after the end are identities."""
    n, size = potential.shape
    step = min(_STEP, max(1, n))
    blocks = -(-n // step)
    m = np.broadcast_to(np.eye(size), (blocks * step, size, size)).copy()
    m[:n] = trans[None] * potential[:, None, :]
    m[:n][first] = (start * potential[first])[:, None, :]
    return m.reshape(blocks, step, size, size)


def posteriors(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginal probabilities [n, L] by forward-backward. ``trans`` and ``start`` are
    scores. Chains are cut into blocks whose transfer matrices are multiplied for
    all blocks at a time, so the steps do not follow the longest chain."""
    n, size = emit.shape
    if not n:
        return np.zeros((0, size))
    potential = np.exp(emit - emit.max(axis=1, keepdims=True))
    m = _blocks(potential, first, np.exp(trans - trans.max()), np.exp(start - start.max()))
    blocks, step = m.shape[:2]
    whole = m[:, 0].copy()
    for b in range(1, step):
        whole = np.matmul(whole, m[:, b])
        whole /= whole.max(axis=(1, 2), keepdims=True)
    into, out_of = np.empty((blocks, size)), np.empty((blocks, size))
    v = np.full(size, 1.0 / size)
    for k in range(blocks):
        into[k] = v
        v = v @ whole[k]
        v = v / v.sum()
    v = np.ones(size)
    for k in range(blocks - 1, -1, -1):
        out_of[k] = v
        v = whole[k] @ v
        v = v / v.sum()
    alpha, beta = np.empty((blocks, step, size)), np.empty((blocks, step, size))
    v = into
    for b in range(step):
        v = np.einsum("ki,kij->kj", v, m[:, b])
        v /= v.sum(axis=1, keepdims=True)
        alpha[:, b] = v
    v = out_of
    for b in range(step - 1, -1, -1):
        beta[:, b] = v
        v = np.einsum("kij,kj->ki", m[:, b], v)
        v /= v.sum(axis=1, keepdims=True)
    p = (alpha * beta).reshape(-1, size)[:n]
    return p / p.sum(axis=1, keepdims=True)


def viterbi(emit: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best labels of one chain; ties go to the smaller label."""
    n = len(emit)
    if not n:
        return np.zeros(0, dtype=int)
    back = np.zeros(emit.shape, dtype=int)
    v = start + emit[0]
    for t in range(1, n):
        s = v[:, None] + trans
        back[t] = s.argmax(axis=0)
        v = s.max(axis=0) + emit[t]
    out = [int(v.argmax())]
    for t in range(n - 1, 0, -1):
        out.append(int(back[t][out[-1]]))
    return np.array(out[::-1])


def pair_posteriors(emit: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals [C, T, L] and summed pair marginals [L, L] of C chains of one length."""
    c, t, size = emit.shape
    potential = np.exp(emit - emit.max(axis=2, keepdims=True))
    a, s = np.exp(trans - trans.max()), np.exp(start - start.max())
    alpha, beta = np.empty(emit.shape), np.ones(emit.shape)
    alpha[:, 0] = s * potential[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        alpha[:, i] = (alpha[:, i - 1] @ a) * potential[:, i]
        alpha[:, i] /= alpha[:, i].sum(axis=1, keepdims=True)
    pairs = np.zeros((size, size))
    for i in range(t - 1, 0, -1):
        right = potential[:, i] * beta[:, i]
        x = alpha[:, i - 1][:, :, None] * a[None] * right[:, None, :]
        pairs += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[:, i - 1] = right @ a.T
        beta[:, i - 1] /= beta[:, i - 1].sum(axis=1, keepdims=True)
    gamma = alpha * beta
    return gamma / gamma.sum(axis=2, keepdims=True), pairs


class Trainer:
    """AdaGrad on the conditional log likelihood. ``weights`` [H, L] scores hashed
    features, ``dense`` [F, L] scores real-valued ones."""

    def __init__(self, hashed: int, dense: int, labels: int, rate: float = 0.5, ridge: float = 1e-4) -> None:
        self.rate, self.ridge = rate, ridge
        self.weights, self.dense = np.zeros((hashed, labels)), np.zeros((dense, labels))
        self.trans, self.start = np.zeros((labels, labels)), np.zeros(labels)
        self._seen = [np.full(x.shape, 1e-6) for x in (self.weights, self.dense, self.trans, self.start)]

    def emit(self, features: np.ndarray, bounds: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Scores of positions: position p has ``features[bounds[p]:bounds[p + 1]]``
        (one at least) and the real values ``real[p]``."""
        return np.add.reduceat(self.weights[features], bounds[:-1], axis=0) + real @ self.dense

    def step(self, features: np.ndarray, bounds: np.ndarray, real: np.ndarray, labels: np.ndarray) -> None:
        """One step on chains of one length; ``labels`` is [C, T], positions are in that order."""
        size = self.trans.shape[0]
        emit = self.emit(features, bounds, real).reshape(*labels.shape, size)
        gamma, pairs = pair_posteriors(emit, self.trans, self.start)
        gold = np.eye(size)[labels]
        error = (gold - gamma).reshape(-1, size)
        held, place = np.unique(features, return_inverse=True)
        spread = np.repeat(error, np.diff(bounds), axis=0)
        gradient = np.stack([np.bincount(place, weights=spread[:, j], minlength=len(held)) for j in range(size)], axis=1)
        gold_pairs = np.zeros((size, size))
        np.add.at(gold_pairs, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
        updates = ((self.weights, self._seen[0], held, gradient), (self.dense, self._seen[1], slice(None), real.T @ error),
                   (self.trans, self._seen[2], slice(None), gold_pairs - pairs), (self.start, self._seen[3], slice(None), (gold - gamma)[:, 0].sum(axis=0)))
        for x, seen, at, g in updates:
            g = g / labels.shape[0] - self.ridge * x[at]
            seen[at] += g * g
            x[at] += self.rate * g / np.sqrt(seen[at])
