"""Elastic-net fits of many trials at once, from cross products, along descending strengths.

Minimised is half the mean squared error plus ``alpha`` times the mixed penalty, for every trial and every target: a column of
one array (features x columns). Columns move together, feature by feature. Trials are taken in waves by descending alpha, each
wave starting from the weights of the trial before it. After some sweeps the duality gap of each column is taken: it bounds what
is left to gain, ends the column, and together with the correlation of a feature with the residual proves that the feature's
weight is 0 (gap-safe screening); features that are 0 in all columns are not visited again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Trials that move together, and sweeps between two looks at the gap.
WAVE, LOOK = 32, 5


@dataclass
class Moments:
    """Means of products of centred features and targets."""

    xx: np.ndarray  # features x features
    xy: np.ndarray  # features x targets
    yy: np.ndarray  # targets


def duality_gaps(xx, xy, yy, w, xxw, l1, l2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per column: the smaller of two duality gaps, the gap of the scaled residual, and each feature's correlation with it
    as a share of what is allowed.

    The scaled residual is feasible for the penalty written as extra rows of data; the residual itself is feasible where
    the squared penalty is kept apart, which is the sharper of the two when l1 is small.
    """
    squared = np.maximum(yy - 2 * np.sum(xy * w, axis=0) + np.sum(w * xxw, axis=0), 0)
    along = yy - np.sum(xy * w, axis=0)
    size, square = np.abs(w).sum(axis=0), np.sum(w * w, axis=0)
    slope = xy - xxw
    largest = np.max(np.abs(slope - l2 * w), axis=0, initial=0)
    share = np.minimum(1, l1 / np.maximum(largest, 1e-300))
    scaled = 0.5 * squared * (1 + share**2) + l1 * size - share * along + 0.5 * l2 * (1 + share**2) * square
    beyond = np.sum(np.maximum(np.abs(slope) - l1, 0) ** 2, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where(l2 > 0, squared + l1 * size + 0.5 * l2 * square - along + 0.5 * beyond / l2, np.inf)
    allowed = np.maximum(largest, l1)
    correlation = np.abs(slope - l2 * w) / np.maximum(allowed, 1e-300)
    return np.minimum(scaled, apart), scaled, correlation


def descend(moments: Moments, l1, l2, start, gap=1e-4, settled=1e-12, max_iter=100_000, screen=True, target=None):
    """Weights (features x columns), and whether each column has ended. ``l1``, ``l2`` and ``target`` are per column.

    A column ends when its gap is at most ``gap`` times the mean square of its target, or when a sweep moves no weight by more
    than ``settled``.
    """
    xx, diagonal = moments.xx, np.diag(moments.xx)
    xy, yy = moments.xy[:, target], moments.yy[target]
    out, ended = start.copy(), np.zeros(len(l1), bool)
    live = np.arange(len(l1))
    useful = diagonal > 1e-14
    out[~useful] = 0
    w, c, y, a, b = out.copy(), xy, yy, l1, l2
    zero = np.zeros(w.shape, bool)
    xxw = xx @ w
    moved = np.full(len(l1), np.inf)
    for sweep in range(max_iter + 1):
        if sweep % LOOK == 0 or sweep == max_iter:
            xxw = xx @ w  # sums of many small steps drift
            least, scaled, correlation = duality_gaps(xx, c, y, w, xxw, a, b)
            done = (least <= gap * y) | (moved <= settled)
            if done.any():
                out[:, live[done]], ended[live[done]] = w[:, done], True
                live, w, c, y, a, b, xxw, zero = live[~done], w[:, ~done], c[:, ~done], y[~done], a[~done], b[~done], xxw[:, ~done], zero[:, ~done]
                scaled, correlation, moved = scaled[~done], correlation[:, ~done], moved[~done]
            if not len(live) or sweep == max_iter:
                break
            if screen:
                radius = np.sqrt(2 * np.maximum(scaled, 0)) / np.maximum(a, 1e-300)
                zero |= correlation + radius * np.sqrt(diagonal[:, None] + b) < 1
                if (zero & (w != 0)).any():
                    w[zero] = 0
                    xxw = xx @ w
            visited = np.flatnonzero(useful & ~zero.all(axis=1))
        moved = np.zeros(len(live))
        for j in visited:
            reach = c[j] - xxw[j] + diagonal[j] * w[j]
            new = np.sign(reach) * np.maximum(np.abs(reach) - a, 0) / (diagonal[j] + b)
            new[zero[j]] = 0
            step = new - w[j]
            if step.any():
                w[j] = new
                xxw += np.multiply.outer(xx[:, j], step)
                np.maximum(moved, np.abs(step), out=moved)
    out[:, live] = w
    return out, ended


def elastic_path(moments: Moments, alphas, ratios, **options) -> tuple[np.ndarray, np.ndarray]:
    """Weights (trials x features x targets) and whether each trial has ended, for trials in any order."""
    features, targets = moments.xy.shape
    alphas, ratios = np.asarray(alphas, float), np.asarray(ratios, float)
    weights, ended = np.zeros((len(alphas), features, targets)), np.zeros(len(alphas), bool)
    order = np.argsort(-alphas, kind="stable")
    last = np.zeros((features, targets))
    for at in range(0, len(order), WAVE):
        wave = order[at : at + WAVE]
        alpha, ratio = np.repeat(alphas[wave], targets), np.repeat(ratios[wave], targets)
        w, done = descend(moments, alpha * ratio, alpha * (1 - ratio), np.tile(last, len(wave)), target=np.tile(np.arange(targets), len(wave)), **options)
        weights[wave] = w.reshape(features, len(wave), targets).transpose(1, 0, 2)
        ended[wave] = done.reshape(len(wave), targets).all(axis=1)
        last = weights[wave[-1]]
    return weights, ended


def ridge_path(xx: np.ndarray, xy: np.ndarray, alphas) -> np.ndarray:
    """Weights (trials x features x targets) of all strengths from one eigendecomposition of the summed products."""
    values, vectors = np.linalg.eigh(xx)
    turned = vectors.T @ xy
    alphas = np.asarray(alphas, float)
    return np.einsum("ij,njt->nit", vectors, turned / (np.maximum(values, 0)[None, :] + alphas[:, None])[:, :, None])
