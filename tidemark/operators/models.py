"""Models that Spark's own library doesn't have in this form: tied to swaps, fitted per fold, without scipy.

Fits over tables go through `newton`, one aggregation a step for all folds. `ridge` and `fit_softmax` are the same models
for arrays in memory.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import newton


def ridge(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """L2 logistic regression without intercept on standardised differences, each row also swapped; Newton's method.

    The swapped copy makes the fit odd in its inputs, so a corner's probability and its opponent's add up to 1. Scales
    are population deviations, and the objective is C times the summed loss plus half the squared norm.
    """
    both, targets = np.vstack([x, -x]), np.concatenate([y, 1 - y])
    scale = both.std(axis=0)
    scale[scale == 0] = 1.0
    z = both / scale
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = c * z.T @ (p - targets) + w
        hess = c * (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-10:
            break
    return w / scale


def _folds(rows: DataFrame, fold: str) -> list:
    """The folds, few beside their rows."""
    return [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]


def fit_ridge_by(rows: DataFrame, fold: str, features: Sequence[str], label: str, c: float = 1.0) -> DataFrame:
    """(fold, weights, n), one fit per fold, all folds at once; rows without a fold are left out."""
    kind, rows = rows.schema[fold].dataType.simpleString(), rows.where(F.col(fold).isNotNull())
    folds = _folds(rows, fold)
    schema = f"`{fold}` {kind}, weights array<double>, n long"
    if not folds:
        return rows.sparkSession.createDataFrame([], schema)
    wide = rows.select(fold, *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias(label))
    theta, n = newton.fit_ridge(wide, features, label, newton.fold_weights(fold, folds), len(folds), c)
    return rows.sparkSession.createDataFrame([(k, t.tolist(), int(m)) for k, t, m in zip(folds, theta, n, strict=True)], schema)


def win_probability(weights: Column, features: Column) -> Column:
    """Sigmoid of the dot product, in the JVM."""
    z = F.aggregate(F.zip_with(weights, features, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.exp(-z))


def platt(logit: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, penalty: float = 1e-4, bound: float = 50.0) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps on the mean loss with a small ridge; a fit at its bounds is an error. `times`: how often each row occurs."""
    share = np.full(len(y), 1 / len(y)) if times is None else times / times.sum()
    design, theta = np.column_stack([logit, np.ones_like(logit)]), np.array([1.0, 0.0])
    sign = 2 * y - 1
    objective = lambda t: share @ np.logaddexp(0, -sign * (design @ t)) + penalty / 2 * (t @ t)
    loss = objective(theta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -35, 35)))
        grad = design.T @ (share * (p - y)) + penalty * theta
        hess = (design * (share * p * (1 - p))[:, None]).T @ design + penalty * np.eye(2)
        move, size = np.linalg.solve(hess, grad), 1.0
        while (new := objective(theta - size * move)) > loss - 1e-4 * size * (grad @ move) and size > 1e-8:
            size /= 2
        theta, loss = theta - size * move, new
        if np.abs(size * move).max() < 1e-10:
            break
    if np.abs(theta).max() >= bound:
        raise ValueError("the calibrator ran to its bound")
    return float(theta[0]), float(theta[1])


def temperature(logits: np.ndarray, classes: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """One temperature by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), classes]).mean())

    a, b, g = np.log(low), np.log(high), (5**0.5 - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    while b - a > 1e-6:
        if loss(c) < loss(d):
            b, d = d, c
            c = b - g * (b - a)
        else:
            a, c = c, d
            d = a + g * (b - a)
    return float(np.exp((a + b) / 2))


def softmax_loss(theta: np.ndarray, x: np.ndarray, classes: np.ndarray, c: float) -> tuple[float, np.ndarray]:
    """C times the summed negative log likelihood plus half the squared norm, and its gradient."""
    z = x @ theta
    z = z - z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    p, rows = np.exp(z), np.arange(len(x))
    loss = -c * z[rows, classes].sum() + 0.5 * (theta**2).sum()
    p[rows, classes] -= 1
    return float(loss), c * x.T @ p + theta


def fit_softmax(x: np.ndarray, classes: np.ndarray, n_classes: int, c: float = 1.0, steps: int = 200, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    theta = np.zeros((x.shape[1], n_classes))
    loss, grad = softmax_loss(theta, x, classes, c)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, used = grad.ravel().copy(), []
        for s, y in reversed(past):
            a = s @ q / (y @ s)
            q -= a * y
            used.append(a)
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(used), strict=True):
            q += s * (a - y @ q / (y @ s))
        move, size = -q.reshape(theta.shape), 1.0
        while True:
            new_loss, new_grad = softmax_loss(theta + size * move, x, classes, c)
            if new_loss <= loss + 1e-4 * size * (grad * move).sum() or size < 1e-10:
                break
            size /= 2
        s, y = (size * move).ravel(), (new_grad - grad).ravel()
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = abs(loss - new_loss) < 1e-10 * max(1.0, abs(loss))
        theta, loss, grad = theta + size * move, new_loss, new_grad
        if done:
            break
    return theta


def fit_hazards_by(periods: DataFrame, fold: str, features: Sequence[str], klass: str, classes: Sequence[str], c: float = 1.0) -> DataFrame:
    """Competing-risks softmax over person periods with free parameters for each class, all folds at once: (fold, theta as rows of a constant and the features by classes). A fold without a class is an error."""
    kind, rows = periods.schema[fold].dataType.simpleString(), periods.where(F.col(fold).isNotNull())
    folds = _folds(rows, fold)
    code = F.array_position(F.array(*map(F.lit, classes)), F.col(klass)).cast("int") - 1
    wide = rows.select(fold, *[F.col(f).cast("double").alias(f) for f in features], code.alias("__class"))

    def design(columns: dict[str, np.ndarray], _: int) -> list[tuple[int, np.ndarray] | None]:
        x = np.column_stack([np.ones(len(columns["__class"])), *(columns[f] for f in features)])
        return [(k, x) for k in range(len(classes))]

    theta = newton.fit_softmax(wide, "__class", newton.fold_weights(fold, folds), len(folds), len(classes), len(classes), 1 + len(features), design, c)
    return rows.sparkSession.createDataFrame([(k, t.T.tolist()) for k, t in zip(folds, theta, strict=True)], f"`{fold}` {kind}, theta array<array<double>>")
