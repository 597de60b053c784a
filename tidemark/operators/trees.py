"""Forests and boosted trees by Spark ML's rules in one task a fit, for tables of which a task holds the training rows.

A round of boosting in Spark ML is a row of small jobs, whatever the table's size; here a round is a few sums of
arrays. Rules as there: splits by weighted quantiles over up to 32 bins, features drawn by node, counts of drawn rows
against the least leaf, Poisson counts for a forest and rows left out for boosting, first tree of weight 1 on the
classes, then trees on the residuals of the log loss. For two classes the Gini gain is twice the gain in variance, so
one kind of tree serves both. Random numbers differ from Spark's.
"""

from __future__ import annotations

from math import ceil, log2, sqrt

import numpy as np
from pyspark.ml.classification import GBTClassifier

CELLS = 2_000_000  # rows times trees grown together


def settings_of(model) -> dict:
    """What a Spark ML forest or boosted classifier is set to, as plain values for a task."""
    out = {"boosted": isinstance(model, GBTClassifier), "depth": model.getMaxDepth(), "leaf": model.getMinInstancesPerNode(), "bins": model.getMaxBins()}
    out |= {"trees": model.getMaxIter() if out["boosted"] else model.getNumTrees(), "sample": model.getSubsamplingRate(), "seed": model.getSeed()}
    return out | {"features": model.getFeatureSubsetStrategy(), "rate": model.getStepSize() if out["boosted"] else 1.0}


def looked_at(strategy: str, n: int, boosted: bool) -> int:
    """How many of n features a node looks at."""
    if strategy == "auto":
        strategy = "all" if boosted else "sqrt"
    named = {"all": n, "sqrt": ceil(sqrt(n)), "log2": max(1, ceil(log2(n))), "onethird": ceil(n / 3)}
    if strategy in named:
        return named[strategy]
    return min(n, int(strategy)) if strategy.isdigit() else min(n, ceil(float(strategy) * n))


def split_points(x: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Between neighbouring values of a column: all, or those nearest to equal shares of the weight."""
    values, place = np.unique(x, return_inverse=True)
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < bins:
        return middles
    reached = np.cumsum(np.bincount(place, weight)).tolist()
    stride = reached[-1] / bins
    out, target = [], stride
    for i in range(1, len(values)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def binned(x: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(p, x[:, j], "left") for j, p in enumerate(points)], axis=1)


def grow(bins: np.ndarray, width: int, count: np.ndarray, weight: np.ndarray, target: np.ndarray, depth: int, leaf: int, look: int, rng) -> tuple:
    """Trees on (trees, rows) counts, level by level and all together: feature (-1: leaf), last bin on the left, and mean
    of each node; the children of node i are 2 i + 1 and 2 i + 2."""
    n_trees, n_features = len(count), bins.shape[1]
    nodes = 2 ** (depth + 1) - 1
    feature, cut, value = np.full((n_trees, nodes), -1), np.zeros((n_trees, nodes), int), np.zeros((n_trees, nodes))
    tree, row = np.nonzero(count)
    k = count[tree, row].astype(float)
    w = k * weight[row]
    s, at = w * target[row], np.zeros(len(tree), int)
    for level in range(depth + 1):
        live, own = np.unique(tree * nodes + at, return_inverse=True)
        if not len(live):
            break
        t, node = live // nodes, live % nodes
        whole = [np.bincount(own, v) for v in (k, w, s)]
        value[t, node] = np.divide(whole[2], whole[1], out=np.zeros(len(live)), where=whole[1] > 0)
        if level == depth or width < 2:
            break
        if look < n_features:
            seen = np.argsort(rng.random((len(live), n_features)), axis=1)[:, :look]
        else:
            seen = np.broadcast_to(np.arange(n_features), (len(live), n_features))
        cell = ((own[:, None] * look + np.arange(look)) * width + bins[row[:, None], seen[own]]).ravel()
        left = [np.bincount(cell, np.repeat(v, look), len(live) * look * width).reshape(len(live), look, width).cumsum(2)[:, :, :-1] for v in (k, w, s)]
        right = [v[:, None, None] - x for v, x in zip(whole, left, strict=True)]
        fits = (left[0] >= leaf) & (right[0] >= leaf) & (left[1] > 0) & (right[1] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = left[2] ** 2 / left[1] + right[2] ** 2 / right[1]
            together = whole[2] ** 2 / whole[1]
        gain = np.where(fits, apart - together[:, None, None], -1.0).reshape(len(live), -1)
        best = gain.argmax(axis=1)
        split = gain[np.arange(len(live)), best] > 1e-12 * np.maximum(1.0, np.abs(together))
        f, c = seen[np.arange(len(live)), best // (width - 1)], best % (width - 1)
        feature[t[split], node[split]], cut[t[split], node[split]] = f[split], c[split]
        stays = split[own]
        tree, row, k, w, s, at, own = (v[stays] for v in (tree, row, k, w, s, at, own))
        at = 2 * at + 1 + (bins[row, f[own]] > c[own])
    return feature, cut, value


def reached(grown: tuple, bins: np.ndarray, depth: int) -> np.ndarray:
    """The value of each row's leaf, by tree."""
    feature, cut, value = grown
    t, rows = np.arange(len(feature))[:, None], np.arange(len(bins))[None, :]
    at = np.zeros((len(feature), len(bins)), int)
    for _ in range(depth):
        f = feature[t, at]
        at = np.where(f >= 0, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > cut[t, at]), at)
    return value[t, at]


def probabilities(train: np.ndarray, classes: np.ndarray, weight: np.ndarray, test: np.ndarray, given: dict) -> np.ndarray:
    """Probability of class 1 of each test row, by a model of the training rows (classes 0 and 1)."""
    if not len(train):
        raise ValueError("a model needs training rows")
    points = [split_points(train[:, j], weight, min(given["bins"], len(train))) for j in range(train.shape[1])]
    width = max(len(p) for p in points) + 1
    bins, others = binned(train, points), binned(test, points)
    look = looked_at(given["features"], train.shape[1], given["boosted"])
    rng, n, depth = np.random.default_rng(given["seed"]), len(train), given["depth"]
    rule = (depth, given["leaf"], look, rng)
    if given["boosted"]:
        sign, at, out = 2.0 * classes - 1.0, np.zeros(n), np.zeros(len(test))
        for i in range(given["trees"]):
            residual = 4.0 * sign / (1.0 + np.exp(2.0 * sign * at)) if i else sign
            drawn = rng.random((1, n)) < given["sample"] if given["sample"] < 1 else np.ones((1, n), bool)
            grown, rate = grow(bins, width, drawn, weight, residual, *rule), given["rate"] if i else 1.0
            at += rate * reached(grown, bins, depth)[0]
            out += rate * reached(grown, others, depth)[0]
        return 1.0 / (1.0 + np.exp(-2.0 * out))
    out, together = np.zeros(len(test)), max(1, CELLS // max(n, len(test)))
    for first in range(0, given["trees"], together):
        size = min(together, given["trees"] - first)
        out += reached(grow(bins, width, rng.poisson(given["sample"], (size, n)), weight, classes, *rule), others, depth).sum(axis=0)
    return out / given["trees"]
