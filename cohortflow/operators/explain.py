"""Model-agnostic attribution re-aimed for Spark.

Permutation-sampled Shapley values against one background point (the feature
means): for each explained row and each of P permutations, the k+1 hybrid
vectors (first t features of the permutation from the row, the rest from the
background) are built and scored with numpy inside the tasks, and consecutive
differences along the permutation are the marginal contributions.  Work is
rows x P x (k+1) model evaluations; what a task holds is bounded by
``HYBRIDS`` hybrid vectors, whatever the Arrow batch, P or k.  A model that knows its marginal
contributions along a permutation (``FlatTrees.contributions``) gives the same values with less work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HYBRIDS = 4096               # hybrid vectors scored at once
DEALT = 4                    # tasks for every core


def permutations(k: int, n_perm: int, seed: int) -> np.ndarray:
    """P deterministic permutations of the k features (shared by all rows)."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(k) for _ in range(n_perm)])


def shapley_rows(predict: Callable[[np.ndarray], np.ndarray], x: np.ndarray, background: np.ndarray, perm: np.ndarray) -> np.ndarray:
    """Mean marginal contributions (rows, k) over the permutations, one permutation and a few rows at a time."""
    n, k = x.shape
    phi = np.zeros((n, k))
    step = max(1, HYBRIDS // (k + 1))
    for order in perm:
        rank = np.argsort(order)                                              # position of each feature
        take = rank[None, :] < np.arange(k + 1)[:, None]                      # (k+1) x k: feature from the row?
        for i in range(0, n, step):
            part = x[i:i + step]
            hybrid = np.where(take[None], part[:, None, :], background[None, None, :]).reshape(-1, k)
            f = predict(hybrid).reshape(len(part), k + 1)
            phi[i:i + step, order] += np.diff(f, axis=1)
    return phi / len(perm)


def permutation_shapley(predict: Callable[[np.ndarray], np.ndarray], rows: DataFrame, features: list[str], background: list[float], n_perm: int = 10,
                        seed: int = 42, top_n: int = 30, per_row: bool = False, contributions: Callable | None = None) -> DataFrame:
    """``predict``: matrix (rows, k) -> predictions, sent to the tasks.  ``contributions``, if given, takes the
    place of ``shapley_rows``: (rows, background, permutations) -> mean marginal contributions of the same model.

    ``rows`` holds the explained rows with one column per (imputed) feature and a
    unique string or integer key ``_rid``.  Returns (feature, mean_abs_shap) for the
    top n features, or per-row values with ``per_row``.
    """
    perm = permutations(len(features), n_perm, seed)
    bg = np.asarray(background, dtype=float)
    rid_type = rows.schema["_rid"].dataType.simpleString()
    base = rows.select("_rid", F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_x"))
    # a row costs milliseconds: few bytes, which may be stored in a file or two, are work for every core
    base = base.repartition(max(DEALT * base.sparkSession.sparkContext.defaultParallelism, base.rdd.getNumPartitions()))

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["_x"].to_numpy())
            phi = contributions(x, bg, perm) if contributions else shapley_rows(predict, x, bg, perm)
            if per_row:
                n, k = phi.shape
                yield pd.DataFrame({"_rid": np.repeat(pdf["_rid"].to_numpy(), k), "_j": np.tile(np.arange(k, dtype=np.int32), n), "v": phi.ravel(), "n": 1})
            else:                                                             # one row per feature and batch
                yield pd.DataFrame({"_rid": pdf["_rid"].iloc[0], "_j": np.arange(phi.shape[1], dtype=np.int32), "v": np.abs(phi).sum(axis=0), "n": len(phi)})

    out = base.mapInPandas(run, f"_rid {rid_type}, _j int, v double, n bigint")
    names = F.array(*[F.lit(f) for f in features])
    if per_row:
        return out.select("_rid", F.element_at(names, F.col("_j") + 1).alias("feature"), F.col("v").alias("phi"))
    out = out.groupBy("_j").agg((F.sum("v") / F.sum("n")).alias("mean_abs_shap"))
    return (out.select(F.element_at(names, F.col("_j") + 1).alias("feature"), "mean_abs_shap")
            .orderBy(F.desc("mean_abs_shap"), "feature").limit(int(top_n)))
