"""Logistic regression on a bounded number of sparse binary features, fitted on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, n_features: int, steps: int = 400, rate: float = 0.1,
        penalty: float = 1e-4, lift: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias; each row lists the features that are present.

    Rows with label 1 count `lift` times, so that a rare label is not held back by being rare.
    """
    labels = labels.astype(np.float64)
    importance = np.where(labels == 1, lift, 1.0)
    share = np.clip(np.average(labels, weights=importance) if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    weights, bias = np.zeros(n_features), float(np.log(share / (1 - share)))
    if not n_features or not len(rows):
        return weights, bias
    importance /= importance.sum()
    features = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        scores = np.bincount(owner, weights[features], minlength=len(rows)) + bias
        error = (sigmoid(scores) - labels) * importance
        gradient = np.append(np.bincount(features, error[owner], minlength=n_features) + penalty * weights, error.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias


def raw_scores(rows: list[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weights[r].sum() for r in rows]) + bias


def threshold(scores: np.ndarray, labels: np.ndarray, cost: float = 2.0) -> float:
    """The score above which predicting 1 gains most: hits less `cost` times false alarms. In the middle of the widest gap."""
    order = np.argsort(scores, kind="stable")
    scores, labels = scores[order], labels[order].astype(bool)
    above = np.append((labels - cost * ~labels)[::-1].cumsum()[::-1], 0.0)
    edges = np.concatenate([[scores[0] - 2], scores, [scores[-1] + 2]])
    gaps = np.diff(edges)
    best = np.flatnonzero((above >= above.max() - 1e-9) & (gaps > 0))
    at = best[np.argmax(gaps[best])]
    return float((edges[at] + edges[at + 1]) / 2)


def fit_at(rows: list[np.ndarray], labels: np.ndarray, n_features: int, level: float, **options) -> tuple[np.ndarray, float]:
    """Weights and a bias that puts the best threshold at the probability `level`.

    The threshold is sought on scores of rows by a model that was fitted on the other half of the rows.
    """
    weights, bias = fit(rows, labels, n_features, **options)
    halves = [np.arange(len(rows)) % 2 == h for h in (0, 1)]
    if any(len(set(labels[h].tolist())) < 2 for h in halves):
        return weights, bias
    scores = np.empty(len(rows))
    for half, other in (halves, halves[::-1]):
        own = fit([r for r, o in zip(rows, other) if o], labels[other], n_features, **options)
        scores[half] = raw_scores([r for r, h in zip(rows, half) if h], *own)
    return weights, bias + float(np.log(level / (1 - level))) - threshold(scores, labels)
