"""Kernel regression re-aimed for Spark (M8).

The reference tunes an exact RBF support-vector regressor, a single-machine dual
solver.  Here the RBF kernel exp(-gamma |x - x'|^2) is approximated by D random
Fourier features z_j(x) = sqrt(2/D) cos(w_j . x + b_j), w_j ~ N(0, 2 gamma I),
b_j ~ U(0, 2 pi), computed in the tasks by a product with one projection matrix (D x k
numbers).  A ridge fit on z (closed form from Gram statistics, one pass) plays
the role of the kernel machine; the loss is squared, not epsilon-insensitive.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.operators import linear as lin


def rff_params(k: int, n_features: int = 200, gamma: float | None = None, seed: int = 42):
    """Projection (D x k) and phases; gamma defaults to 1/k ('scale' on standardised inputs)."""
    g = 1.0 / max(k, 1) if gamma is None else float(gamma)
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2.0 * g), size=(n_features, k))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_features)
    return W, b


def rff_matrix(x: np.ndarray, mean, sd, W: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, D) random features of the imputed inputs, standardised."""
    return math.sqrt(2.0 / W.shape[0]) * np.cos((x - mean) / sd @ W.T + b)


def fit_rff_ridge(train: DataFrame, features: list[str], label: str, med: dict, n_features: int = 200,
                  gamma: float | None = None, alpha: float = 1.0, seed: int = 42):
    """Returns (scoring column builder, fit).  Two passes: moments, then Gram statistics."""
    imp = train.select(F.col(label).cast("double").alias("_y"), *lin.imputed(features, med)).where(F.col("_y").isNotNull())
    mom = imp.agg(*[F.avg(f"`{f}`").alias(f"m{i}") for i, f in enumerate(features)],
                  *[F.stddev_pop(f"`{f}`").alias(f"s{i}") for i, f in enumerate(features)]).first()
    mean = np.array([mom[f"m{i}"] or 0.0 for i in range(len(features))])
    sd = np.array([(mom[f"s{i}"] or 1.0) or 1.0 for i in range(len(features))])
    W, b = rff_params(len(features), n_features, gamma, seed)
    names = [f"rff{j}" for j in range(n_features)]
    st = lin.gram_stats(imp, features, "_y", expand=(n_features, lambda x: rff_matrix(x, mean, sd, W, b)))["all"]
    fit = lin.fit_linear(st, names, {}, "ridge", alpha=alpha)
    coef, shift = fit.raw_coef, float(fit.raw_intercept)

    @F.pandas_udf("double")
    def score(*x: pd.Series) -> pd.Series:
        z = np.column_stack([v.to_numpy(dtype=float) for v in x])
        return pd.Series(np.concatenate([rff_matrix(z[i:i + lin.SLICE], mean, sd, W, b) @ coef + shift for i in range(0, len(z), lin.SLICE)] or [np.zeros(0)]))

    def predict(df: DataFrame) -> Column:
        del df
        return score(*lin.imputed(features, med))

    return predict, fit
