"""Fits by sums: equal to fits in memory, the same for swapped corners, refused where they can't be right."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, newton, resample

CORNERS = newton.Corners(shared=("s",), paired=(("p_a", "p_b"),), differences=("d",))


def contests(n: int = 900, seed: int = 5):
    rng = np.random.default_rng(seed)
    x = {"s": rng.normal(2, 3, n), "p_a": rng.normal(1, 2, n), "p_b": rng.normal(-1, 1, n), "d": rng.normal(0, 1, n)}
    lean = 0.6 * (x["p_a"] - x["p_b"]) / 2 + 0.4 * x["d"]
    z = np.column_stack([np.zeros(n), 0.2 * x["s"] + lean, 0.2 * x["s"] - lean, -0.3 + lean / 2, -0.3 - lean / 2])
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    return x | {"label": np.array([rng.choice(5, p=q) for q in p]), "interval": rng.integers(0, 3, n), "fold": rng.integers(0, 2, n)}


def frame(spark, x):
    rows = list(zip(*(v.tolist() for v in x.values()), strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{k} {'int' if v.dtype.kind == 'i' else 'double'}" for k, v in x.items())).repartition(5)


def swapped(x, which):
    flip = {0: 0, 1: 2, 2: 1, 3: 4, 4: 3}
    y = {k: v.copy() for k, v in x.items()}
    y["p_a"][which], y["p_b"][which], y["d"][which] = x["p_b"][which], x["p_a"][which], -x["d"][which]
    y["label"][which] = [flip[k] for k in x["label"][which]]
    return y


def in_memory(x, fold, c=1.0):
    """The same objective over explicit designs, by gradient steps with a dense Hessian from differences of gradients."""
    use = x["fold"] == fold
    v = {k: a[use] for k, a in x.items()}
    mean, scale = {k: v[k].mean() for k in CORNERS.names}, {k: v[k].std() for k in CORNERS.names}
    mean["p_a"] = mean["p_b"] = (mean["p_a"] + mean["p_b"]) / 2
    scale["p_a"] = scale["p_b"] = (scale["p_a"] + scale["p_b"]) / 2
    mean["d"] = 0
    z = {k: (v[k] - mean[k]) / scale[k] for k in CORNERS.names}
    even = np.column_stack([z["s"], z["p_a"] + z["p_b"], np.eye(3)[v["interval"]]])
    odd = np.column_stack([z["p_a"] - z["p_b"], z["d"]])
    full = np.zeros((use.sum(), 5, 14))
    for k in range(2):
        full[:, 1 + 2 * k, 7 * k : 7 * k + 7], full[:, 2 + 2 * k, 7 * k : 7 * k + 7] = np.hstack([even, odd]), np.hstack([even, -odd])

    def grad(t):
        logits = full @ t
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), v["label"]] -= 1
        return c * np.einsum("nk,nkp->p", p, full) + t

    t = np.zeros(14)
    for _ in range(40):
        g = grad(t)
        h = np.column_stack([(grad(t + 1e-5 * e) - grad(t - 1e-5 * e)) / 2e-5 for e in np.eye(14)])
        t = t - np.linalg.solve(h, g)
    return t.reshape(2, 7), grad


@pytest.fixture(scope="module")
def fit(spark):
    x = contests()
    return x, newton.fit_tied(frame(spark, x), CORNERS, "label", newton.fold_weights("fold", [0, 1]), 2, 2, interval="interval", intervals=3)


def test_tied_fit_equals_one_in_memory(fit):
    x, tied = fit
    for fold in (0, 1):
        theta, grad = in_memory(x, fold)
        assert np.abs(tied.theta[fold] - theta).max() < 1e-8 and np.abs(grad(tied.theta[fold].ravel())).max() < 1e-6


def test_corners_may_be_swapped(spark, fit):
    """Rows told from the other corner give the same parameters, and a swapped contest gets the swapped chances."""
    x, tied = fit
    which = np.flatnonzero(np.random.default_rng(1).random(len(x["s"])) < 0.4)
    again = newton.fit_tied(frame(spark, swapped(x, which)), CORNERS, "label", newton.fold_weights("fold", [0, 1]), 2, 2, interval="interval", intervals=3)
    # Pooled means and deviations of a pair depend on who stands where; with the scaler held, only the sides change.
    assert np.abs(again.mean[:, [0, 3]] - tied.mean[:, [0, 3]]).max() < 1e-12
    p = tied.probabilities(1, F.col("interval"))
    ours = [r[0] for r in frame(spark, x).orderBy(*x).select(p).collect()]
    both = frame(spark, {k: np.concatenate([v, w]) for (k, v), w in zip(x.items(), swapped(x, np.arange(len(x["s"]))).values(), strict=True)} | {"id": np.tile(np.arange(len(x["s"])), 2)})
    pairs = both.groupBy("id").agg(F.sort_array(F.collect_list(p)).alias("p")).collect()
    assert len(ours) == len(pairs) == 900
    for r in pairs:
        (n1, a1, b1, c1, d1), (n2, a2, b2, c2, d2) = r.p
        assert np.allclose([n1, a1, b1, c1, d1], [n2, b2, a2, d2, c2], atol=1e-12)


def test_scaler_ties_pairs(spark):
    x = {"s": np.array([1.0, 3.0, 5.0]), "p_a": np.array([0.0, 2.0, 4.0]), "p_b": np.array([7.0, 7.0, 7.0]), "d": np.array([4.0, 5.0, 6.0]), "fold": np.zeros(3, int)}
    mean, scale = newton.tied_scaler(frame(spark, x), CORNERS, newton.fold_weights("fold", [0]), 1)
    side = np.std([0, 2, 4])
    assert np.allclose(mean, [[3, 4.5, 4.5, 0]]) and np.allclose(scale, [[np.std([1, 3, 5]), (side + 1) / 2, (side + 1) / 2, np.std([4, 5, 6])]])


def test_fits_are_refused(spark):
    x = contests(200)
    df = frame(spark, x)
    one = newton.fold_weights("fold", [0, 1])
    with pytest.raises(newton.MissingClass):
        newton.fit_tied(df.where("label <> 3"), CORNERS, "label", one, 2, 2)
    with pytest.raises(newton.MissingClass):
        newton.fit_tied(df, CORNERS, "label", newton.fold_weights("fold", [0, 1, 2]), 3, 2)
    with pytest.raises(newton.NotConverged):
        newton.fit_tied(df, CORNERS, "label", one, 2, 2, steps=1)
    with pytest.raises(newton.NotConverged):
        newton.fit_tied(df.withColumn("s", F.lit(float("nan"))), CORNERS, "label", one, 2, 2)


def test_ridge_and_hazards_equal_memory(spark):
    x = contests(400)
    df = frame(spark, x).withColumn("y", (F.col("label") % 2).cast("int"))
    got = {r.fold: r for r in models.fit_ridge_by(df, "fold", ["s", "d"], "y").collect()}
    for k in (0, 1):
        use = x["fold"] == k
        want = models.ridge(np.column_stack([x["s"], x["d"]])[use], (x["label"] % 2)[use].astype(float))
        assert np.abs(np.array(got[k].weights) - want).max() < 1e-8 and got[k].n == use.sum()
    classes = df.withColumn("class", F.concat(F.lit("c"), F.col("label").cast("string")))
    theta = np.array({r.fold: r.theta for r in models.fit_hazards_by(classes, "fold", ["s", "d"], "class", [f"c{k}" for k in range(5)]).collect()}[1])
    use = x["fold"] == 1
    design = np.column_stack([np.ones(use.sum()), x["s"][use], x["d"][use]])
    assert np.abs(models.softmax_loss(theta, design, x["label"][use], 1.0)[1]).max() < 1e-6
    assert models.fit_ridge_by(df.limit(0), "fold", ["s", "d"], "y").count() == 0


def test_replicates_equal_copied_rows(spark):
    x = contests(240)
    df = frame(spark, x | {"place": np.arange(240) % 6}).withColumn("y", (F.col("label") % 2).cast("int"))
    got = {r.rep: r for r in resample.refits(df, "place", 6, 5, ["s", "d"], "y").collect()}
    for rep, rows in resample.hashed_draws(df, "place", 6, 5).join(df, "place").toPandas().groupby("rep"):
        want = models.ridge(rows[["s", "d"]].to_numpy(), rows["y"].to_numpy(float))
        assert np.abs(np.array(got[rep].weights) - want).max() < 1e-8 and got[rep].n == len(rows)
