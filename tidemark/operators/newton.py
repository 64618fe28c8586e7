"""Model fits by sums: Newton's method for many folds or replicates at once, without a fold's rows ever in one task.

A step is one aggregation. Each task adds up loss, gradient and Hessian of its rows for every fold (arrays of a size
that the model's parameters give), Spark adds those sums by place, and the driver solves small systems. A row takes part
in a fold with a weight, so folds may overlap and replicates of a bootstrap are weights, not copies of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Columns = dict[str, np.ndarray]
#: Of some rows and a fold: for each class the parameter block and the design that make its logit; None where it is 0.
Design = Callable[[Columns, int], list[tuple[int, np.ndarray] | None]]
#: Of some rows: their weight in each fold, rows by folds.
Weights = Callable[[Columns], np.ndarray]


def sums(rows: DataFrame, contribute: Callable[[Columns, np.ndarray], None], groups: int, size: int) -> np.ndarray:
    """Groups by size: what `contribute(columns, total)` adds to a task's total, over all tasks. The driver gets groups * size numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, size))
        for batch in batches:
            if batch.num_rows:
                contribute({n: _dense(batch.column(k)) for k, n in enumerate(batch.schema.names)}, total)
        group, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(place, pa.int32()), pa.array(total[group, place])], names=["g", "p", "v"])

    out = np.zeros((groups, size))
    for g, p, v in rows.mapInArrow(run, "g int, p int, v double").groupBy("g", "p").agg(F.sum("v").alias("v")).collect():
        out[g, p] = v
    return out


def _dense(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix, another as a vector."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


class NotConverged(ArithmeticError):
    """A fold's fit moved still after the last step, or its loss isn't finite."""


class MissingClass(ValueError):
    """A fold has no row of some class."""


def minimise(evaluate: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], groups: int, size: int, steps: int = 60, tol: float = 1e-9) -> np.ndarray:
    """Damped Newton for strictly convex losses of all groups side by side; evaluate(theta, active) gives losses, gradients and Hessians. A group that has come to rest takes no further part."""
    theta, active = np.zeros((groups, size)), np.ones(groups, bool)
    loss, grad, hess = evaluate(theta, active)
    for _ in range(steps):
        move = np.zeros_like(theta)
        for g in np.flatnonzero(active):
            move[g] = np.linalg.solve(hess[g], grad[g])
        scale, slope = active.astype(float), (grad * move).sum(axis=1)
        while True:
            there = theta - scale[:, None] * move
            new = evaluate(there, active)
            if not np.isfinite(new[0][active]).all():
                raise NotConverged("the loss isn't finite")
            worse = active & (new[0] > loss - 1e-4 * scale * slope + 1e-12 * np.maximum(1, np.abs(loss)))
            if not worse.any():
                break
            scale[worse] /= 2
            if (scale[worse] < 1e-10).any():
                raise NotConverged("no step lowers the loss")
        theta, (loss, grad, hess) = there, new
        active = active & (np.abs(scale[:, None] * move).max(axis=1) > tol)
        if not active.any():
            return theta
    raise NotConverged(f"{int(active.sum())} of {groups} folds still move after {steps} steps")


def fit_softmax(rows: DataFrame, label: str, weights: Weights, groups: int, n_classes: int, blocks: int, width: int, design: Design, c: float = 1.0, steps: int = 60) -> np.ndarray:
    """Parameters (groups, blocks, width) that minimise c times the weighted negative log likelihood plus half their squared norm.

    label: classes as 0, 1, 2... Every class must occur in every fold with a positive weight.
    """
    size = blocks * width

    def counts(columns: Columns, total: np.ndarray) -> None:
        w = weights(columns)
        for k in range(n_classes):
            total[:, k] += w[columns[label] == k].sum(axis=0)

    missing = sums(rows, counts, groups, n_classes) <= 0
    if missing.any():
        raise MissingClass(f"folds without a class: {[(int(g), int(k)) for g, k in np.argwhere(missing)]}")

    def evaluate(theta: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def contribute(columns: Columns, total: np.ndarray) -> None:
            y, w = columns[label].astype(int), weights(columns)
            for g in np.flatnonzero(active):
                used = np.flatnonzero(w[:, g])
                if not len(used):
                    continue
                parts, v, t = design({n: x[used] for n, x in columns.items()}, g), w[used, g], theta[g].reshape(blocks, width)
                z = np.zeros((len(used), n_classes))
                for k, part in enumerate(parts):
                    if part is not None:
                        z[:, k] = part[1] @ t[part[0]]
                z -= z.max(axis=1, keepdims=True)
                z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
                p, at = np.exp(z), np.arange(len(used))
                total[g, 0] += -(v * z[at, y[used]]).sum()
                rest = p.copy()
                rest[at, y[used]] -= 1
                grad, hess = np.zeros((blocks, width)), np.zeros((blocks, width, blocks, width))
                for i, one in enumerate(parts):
                    if one is None:
                        continue
                    grad[one[0]] += one[1].T @ (v * rest[:, i])
                    for j, other in enumerate(parts):
                        if other is not None:
                            hess[one[0], :, other[0], :] += (one[1] * (v * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ other[1]
                total[g, 1 : 1 + size] += grad.ravel()
                total[g, 1 + size :] += hess.ravel()

        found = c * sums(rows, contribute, groups, 1 + size + size * size)
        loss = found[:, 0] + 0.5 * (theta**2).sum(axis=1)
        return loss, found[:, 1 : 1 + size] + theta, found[:, 1 + size :].reshape(groups, size, size) + np.eye(size)

    return minimise(evaluate, groups, size, steps).reshape(groups, blocks, width)


# ---- ridge on differences --------------------------------------------------------------------------------------------


def fit_ridge(rows: DataFrame, features: Sequence[str], label: str, weights: Weights, groups: int, c: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights by fold, sum of row weights by fold): logistic regression without intercept, tied to swaps.

    Every row counts also with its sides exchanged, so scales are root mean squares and a side's probability and its
    opponent's add up to 1. A feature that is always 0 has scale 1.
    """
    n = len(features)
    x_of = lambda columns: np.column_stack([columns[f].astype(float) for f in features])

    def squares(columns: Columns, total: np.ndarray) -> None:
        w = weights(columns)
        total[:, :n] += w.T @ x_of(columns) ** 2
        total[:, n] += w.sum(axis=0)

    found = sums(rows, squares, groups, n + 1)
    scale = np.sqrt(found[:, :n] / np.maximum(found[:, n:], 1e-300))
    scale[scale == 0] = 1.0
    theta = fit_softmax(rows, label, weights, groups, 2, 1, n, lambda columns, g: [None, (0, x_of(columns) / scale[g])], 2 * c)
    return theta[:, 0] / scale, found[:, n]


# ---- causes tied between two corners ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Corners:
    """Feature columns by what a swap of the corners does: nothing, exchanging a and b, changing the sign."""

    shared: tuple[str, ...] = ()
    paired: tuple[tuple[str, str], ...] = ()
    differences: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.shared, *(x for pair in self.paired for x in pair), *self.differences)


@dataclass(frozen=True)
class Tied:
    """Parameters (fold, pair of causes, width) with the scaler of each fold. Width: symmetric features, places in time (or one constant), antisymmetric features."""

    corners: Corners
    theta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    intervals: int

    def probabilities(self, fold: int, interval: Column | int = 0) -> Column:
        """Array of the classes' chances (none of the causes, then A and B of each pair), in the JVM."""
        names, mean, scale = self.corners.names, self.mean[fold], self.scale[fold]
        z = {n: (F.col(n) - float(m)) / float(s) for n, m, s in zip(names, mean, scale, strict=True)}
        sym = [*(z[n] for n in self.corners.shared), *(z[a] + z[b] for a, b in self.corners.paired)]
        anti = [*(z[a] - z[b] for a, b in self.corners.paired), *(z[n] for n in self.corners.differences)]
        at = interval if isinstance(interval, Column) else F.lit(interval)
        places = [(at == k).cast("double") for k in range(self.intervals)] or [F.lit(1.0)]
        logits = [F.lit(0.0)]
        for t in self.theta[fold]:
            total = lambda xs, ws: sum((x * float(w) for x, w in zip(xs, ws, strict=True)), F.lit(0.0))
            even, odd = total([*sym, *places], t[: len(sym) + len(places)]), total(anti, t[len(sym) + len(places) :])
            logits += [even + odd, even - odd]
        top = F.greatest(*logits)
        up = [F.exp(x - top) for x in logits]
        return F.array(*[u / sum(up, F.lit(0.0)) for u in up])


def tied_scaler(rows: DataFrame, corners: Corners, weights: Weights, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations by fold; those of a pair are the mean of both sides', means of differences are 0, and a deviation of nothing is 1."""
    names = corners.names
    n = len(names)

    def moments(columns: Columns, total: np.ndarray) -> None:
        w, x = weights(columns), np.column_stack([columns[f].astype(float) for f in names])
        total[:, 0] += w.sum(axis=0)
        total[:, 1 : 1 + n] += w.T @ x

    first = sums(rows, moments, groups, 1 + n)
    mean = first[:, 1:] / np.maximum(first[:, :1], 1e-300)

    def spreads(columns: Columns, total: np.ndarray) -> None:  # about the mean, as squares of large numbers cancel
        w, x = weights(columns), np.column_stack([columns[f].astype(float) for f in names])
        for g in range(groups):
            total[g] += w[:, g] @ (x - mean[g]) ** 2

    scale = np.sqrt(sums(rows, spreads, groups, n) / np.maximum(first[:, :1], 1e-300))
    scale[scale < 1e-12] = 1.0
    mean = mean.copy()
    for a, b in corners.paired:
        i, j = names.index(a), names.index(b)
        mean[:, i] = mean[:, j] = (mean[:, i] + mean[:, j]) / 2
        scale[:, i] = scale[:, j] = (scale[:, i] + scale[:, j]) / 2
    mean[:, [names.index(f) for f in corners.differences]] = 0.0
    return mean, scale


def fit_tied(rows: DataFrame, corners: Corners, label: str, weights: Weights, groups: int, pairs: int, c: float = 1.0, interval: str | None = None, intervals: int = 0, steps: int = 60) -> Tied:
    """Competing causes that come in pairs, one for each corner: swapping the corners exchanges their chances exactly.

    label: 0 for none of them, 2k - 1 and 2k for corner A's and B's cause k. Both share a cause's parameters: symmetric
    features (shared ones and sums of pairs) and the interval add to both logits, antisymmetric ones (differences) add
    to A's and subtract from B's. With `interval` rows are person periods, each with its own constant; without it
    there is one constant, as for decisions. Raises MissingClass and NotConverged.
    """
    mean, scale = tied_scaler(rows, corners, weights, groups)
    names, n_sym = corners.names, len(corners.shared) + len(corners.paired)
    at = {n: k for k, n in enumerate(names)}
    width = n_sym + max(1, intervals) + len(corners.paired) + len(corners.differences)

    def design(columns: Columns, g: int) -> list[tuple[int, np.ndarray] | None]:
        z = {n: (columns[n].astype(float) - mean[g, k]) / scale[g, k] for n, k in at.items()}
        length = len(columns[label])
        places = np.eye(intervals)[columns[interval].astype(int)] if interval else np.ones((length, 1))
        even = np.column_stack([*(z[n] for n in corners.shared), *(z[a] + z[b] for a, b in corners.paired), places])
        odd = np.column_stack([np.zeros((length, 0)), *(z[a] - z[b] for a, b in corners.paired), *(z[n] for n in corners.differences)])
        a, b = np.hstack([even, odd]), np.hstack([even, -odd])
        return [None, *(x for k in range(pairs) for x in ((k, a), (k, b)))]

    theta = fit_softmax(rows, label, weights, groups, 1 + 2 * pairs, pairs, width, design, c, steps)
    return Tied(corners, theta, mean, scale, intervals if interval else 0)


def fold_weights(column: str, folds: Sequence) -> Weights:
    """Rows of one fold each."""
    return lambda columns: (columns[column][:, None] == np.array(folds)[None, :]).astype(float)


def earlier_weights(column: str, first: int, groups: int) -> Weights:
    """Walk-forward: fold g trains on all rows before `first` + g."""
    return lambda columns: (columns[column][:, None] < first + np.arange(groups)[None, :]).astype(float)


def drawn_weights(column: str, draws: np.ndarray) -> Weights:
    """Replicates of a bootstrap: draws[block, replicate] is how often a block was drawn."""
    return lambda columns: draws[columns[column].astype(int)]
