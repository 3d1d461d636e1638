"""The logistic loss over all pairs of a row of label 1 and a row of label 0, in time linear in the rows.

A pair's loss depends on the difference of two scores. Scores are dealt in intervals of length 2; there the loss and its two derivatives are
polynomials of NODES terms but for rounding (their poles lie pi away from the line, so the terms shrink by 6.4 each), and a sum over pairs is a
sum over the Chebyshev moments of intervals. No pair is left out and none is drawn.

Rows are seen through two sums: moments() and curvature(). They add up over parts of the rows, so a table of any size is summed where it lies.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

NODES = 24
ROUNDS = 50
CLOSE = 1e-7
_AT = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)


def _basis(u: np.ndarray) -> np.ndarray:
    return np.cos(np.arange(NODES) * np.arccos(np.clip(u, -1, 1))[:, None])


#: Node weights from moments; its transpose gives a polynomial's terms from its values at the nodes.
_TO_NODES = _basis(_AT) * np.where(np.arange(NODES), 2, 1) / NODES

#: Sums by a number that holds an interval and a label (twice the interval, plus the label).
Sums = dict[int, np.ndarray]


def _dealt(z: np.ndarray, y: np.ndarray, w: np.ndarray):
    s = z @ w
    interval = np.floor(s / 2)
    keys, of = np.unique(2 * interval.astype(np.int64) + y.astype(np.int64), return_inverse=True)
    return keys, of, _basis(s - (2 * interval + 1))


def moments(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> Sums:
    """Per interval and label the Chebyshev moments of the rows (first column) and of their features."""
    keys, of, terms = _dealt(z, y, w)
    rows = np.hstack([np.ones((len(z), 1)), z])
    return {int(k): terms[of == i].T @ rows[of == i] for i, k in enumerate(keys)}


def curvature(z: np.ndarray, y: np.ndarray, w: np.ndarray, curves: Sums) -> Sums:
    """The sum of each row's outer product by its weight, a polynomial (curves) in its interval."""
    keys, of, terms = _dealt(z, y, w)
    if not len(keys):
        return {}
    weight = (terms * np.stack([curves[int(k)] for k in keys])[of]).sum(1)
    return {0: (z * weight[:, None]).T @ z}


@dataclass(frozen=True)
class Loss:
    loss: float
    slope: np.ndarray
    cross: np.ndarray
    curves: Sums
    pairs: float


def loss_of(found: Sums) -> Loss:
    """Loss and slope over all pairs, and what curvature() needs for the second derivative."""
    good, bad = ([k for k in sorted(found) if k & 1 == label] for label in (1, 0))
    nodes = {k: _TO_NODES @ found[k] for k in found}
    n = [sum(found[k][0, 0] for k in keys) for keys in (good, bad)]
    at = np.concatenate([2 * (k >> 1) + 1 + _AT for k in bad])
    others = np.concatenate([nodes[k] for k in bad])
    width = others.shape[1] - 1
    loss, slope, cross, bent, curves = 0.0, np.zeros(width), np.zeros((width, width)), np.zeros(len(at)), {}
    for k in good:
        mine = nodes[k]
        d = (2 * (k >> 1) + 1 + _AT)[:, None] - at
        h = 1 / (1 + np.exp(np.clip(d, -500, 500)))
        q = h * (1 - h)
        loss += mine[:, 0] @ np.logaddexp(0, -d) @ others[:, 0]
        slope += others[:, 1:].T @ (h.T @ mine[:, 0]) - mine[:, 1:].T @ (h @ others[:, 0])
        cross += mine[:, 1:].T @ (q @ others[:, 1:])
        curves[k] = _TO_NODES.T @ (q @ others[:, 0])
        bent += q.T @ mine[:, 0]
    curves |= {k: _TO_NODES.T @ v for k, v in zip(bad, bent.reshape(len(bad), NODES), strict=True)}
    pairs = n[0] * n[1]
    return Loss(loss / pairs, slope / pairs, cross / pairs, curves, pairs)


def minimum(width: int, sums: Callable[..., Sums], ridge: float) -> np.ndarray:
    """Weights by Newton steps, halved while the loss does not fall. sums(function, *args) adds up function(z, y, *args) over all rows, of both labels."""

    def first(w):
        got = loss_of(sums(moments, w))
        return got, got.loss + ridge / 2 * (w @ w), got.slope + ridge * w

    w = np.zeros(width)
    got, loss, slope = first(w)
    for _ in range(ROUNDS):
        bend = sums(curvature, w, got.curves)[0] / got.pairs - got.cross - got.cross.T + ridge * np.eye(width)
        step = np.linalg.solve(bend, slope)
        if np.abs(step).max() < CLOSE:
            return w - step
        fall, size = slope @ step, 1.0
        got, new, ahead = first(w - step)
        while new > loss - 1e-4 * size * fall + 1e-12 and size > 1e-6:
            size /= 2
            got, new, ahead = first(w - size * step)
        w, loss, slope = w - size * step, new, ahead
    return w
