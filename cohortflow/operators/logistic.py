"""Penalised logistic regression by IRLS on sufficient statistics.

Every Newton pass is one Spark job that updates *all* models of a search at
once (penalty x held-out fold, plus the refits) that has not converged: each task evaluates
the current coefficients of these models on its rows and emits the weighted Gram
``Z'WZ`` and score ``Z'(a-p)`` per model; Spark sums them.  The driver takes a
Newton step (ridge) or a proximal Newton step solved by coordinate descent
(lasso) on (k+1) x (k+1) matrices.  Penalties act on standardised
coefficients (scale = population sd of the model's training rows), i.e. the
same objective as fitting on standardised features: sum of log losses plus
0.5*|w|^2 (l2) or |w|_1 (l1), as with the public default C=1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE_FLOOR = 1e-6   # keeps the unpenalised Newton system solvable under separation


def _prox_step(H: np.ndarray, b: np.ndarray, lam: np.ndarray, w0: np.ndarray) -> np.ndarray:
    """argmin 0.5 w'Hw - b'w + sum(lam_j |w_j|) (lam_j = 0: free), solved exactly."""
    from cohortflow.operators.linear import _admm_enet
    return _admm_enet(H, b, lam, 0.0, w0)


def fit_many(df: DataFrame, features: list[str], label: str, fold_col: str, models: list[tuple],
             scales: dict, max_iter: int = 25, tol: float = 1e-8):
    """Fit logistic models that share one data set.

    ``models``: (name, held_out_fold or None, penalty in {None, 'l1', 'l2'}).
    ``scales``: name -> per-feature population sd of that model's training rows.
    Returns name -> coefficient vector [w_1..w_k, intercept] on raw features, and
    name -> held-out (sum log loss, n) evaluated at the final coefficients, and
    name -> whether the fit converged (without a penalty, separable arms do not).
    """
    k = len(features)
    m = k + 1
    M = len(models)
    beta = np.zeros((M, m))
    data = df.select(F.col(fold_col).cast("int").alias("_f"), F.col(label).cast("double").alias("_a"),
                     *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]).cache()
    held = np.array([-1 if h is None else int(h) for _, h, _ in models])
    loss = {}
    delta = np.full(M, np.inf)
    try:
        for it in range(max_iter):
            live = np.flatnonzero(~(delta < tol))         # a converged model takes no part in later passes
            B, out_of = beta[live], held[live]

            def step(batches, B=B, held=out_of):
                M = len(B)
                H = np.zeros((M, m, m))
                g = np.zeros((M, m))
                ll = np.zeros(M)
                nn = np.zeros(M)
                for pdf in batches:
                    if pdf.empty:
                        continue
                    Z = np.ones((len(pdf), m))
                    Z[:, :k] = pdf[[f"x{i}" for i in range(k)]].to_numpy(dtype=float)
                    a = pdf["_a"].to_numpy(dtype=float)
                    f = pdf["_f"].to_numpy()
                    eta = Z @ B.T                                   # rows x models
                    p = 1.0 / (1.0 + np.exp(-np.clip(eta, -35, 35)))
                    train = (f[:, None] != held[None, :])           # held = -1: every row trains
                    out = (f[:, None] == held[None, :])
                    wts = p * (1 - p) * train
                    r = (a[:, None] - p) * train
                    for i in range(M):                # a matrix product per model
                        H[i] += (Z * wts[:, i:i + 1]).T @ Z
                    g += r.T @ Z
                    pc = np.clip(p, 1e-15, 1 - 1e-15)
                    ll += (-(a[:, None] * np.log(pc) + (1 - a[:, None]) * np.log(1 - pc)) * out).sum(axis=0)
                    nn += out.sum(axis=0)
                vals = np.concatenate([H.reshape(M, -1), g, ll[:, None], nn[:, None]], axis=1)
                yield pd.DataFrame({"mi": np.repeat(np.arange(M, dtype=np.int32), vals.shape[1]),
                                    "pos": np.tile(np.arange(vals.shape[1], dtype=np.int32), M), "v": vals.ravel()})

            rows = (data.mapInPandas(step, "mi int, pos int, v double")
                    .groupBy("mi", "pos").agg(F.sum("v").alias("v")).toPandas())
            acc = np.zeros((M, m * m + m + 2))
            acc[live[rows["mi"].to_numpy()], rows["pos"].to_numpy()] = rows["v"].to_numpy()
            for i in live:
                name, _, pen = models[i]
                Hm = acc[i, :m * m].reshape(m, m)
                gm = acc[i, m * m:m * m + m]
                loss[name] = (acc[i, -2], acc[i, -1])
                sd = np.append(np.asarray(scales[name], dtype=float), 0.0)
                if pen == "l1":
                    new = _prox_step(Hm + RIDGE_FLOOR * np.eye(m), Hm @ beta[i] + gm, sd, beta[i])
                else:
                    R = np.diag(sd ** 2) if pen == "l2" else RIDGE_FLOOR * np.diag(np.append(np.ones(k), 0.0))
                    new = beta[i] + np.linalg.solve(Hm + R + 1e-12 * np.eye(m), gm - R @ beta[i])
                delta[i] = np.max(np.abs(new - beta[i])) / (1.0 + np.max(np.abs(new)))
                beta[i] = new
            if (delta < tol).all():
                break
    finally:
        data.unpersist()
    names = [name for name, _, _ in models]
    return {n: beta[i] for i, n in enumerate(names)}, loss, {n: bool(delta[i] < tol) for i, n in enumerate(names)}


def prob_col(beta: np.ndarray, features: list[str]):
    """Probability as a JVM-side column expression of (imputed) feature columns."""
    eta = F.lit(float(beta[-1]))
    for f, c in zip(features, beta[:-1]):
        if c != 0.0:
            eta = eta + F.lit(float(c)) * F.col(f"`{f}`")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
