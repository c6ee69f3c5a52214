"""Linear learners from sufficient statistics.

One distributed pass computes, per group (fold, arm, replicate ...), the Gram
statistics of ``z = [x_imputed, 1]``: ``Z'Z``, ``Z'y``, ``y'y``.  Each task
folds its Arrow batches with numpy and emits (group, position, value) rows;
Spark sums them with partial aggregation.  The result is (k+1)^2 numbers per
group, independent of the row count, so every fit of a grid, every fold and
every arm is solved on the driver from small matrices, exactly:

* standardising (population sd, as the public StandardScaler) is algebra on the
  statistics of the training part;
* ridge is the closed form; lasso / elastic net solve the covariance form of
  (1/2n)||y - Xw - b||^2 + a*r*|w|_1 + a*(1-r)/2*|w|^2 by ADMM and an exact
  active-set step; a fit that does not converge raises.

Rows are scored by column expressions, or by one broadcast table of
coefficients (bounded by settings x folds x features).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.scalar import scrub_nonfinite
from cohortflow.operators.quantiles import RowSet, column_quantiles

#: numbers of per-id statistics that a task holds at once, and rows that it scores at once
HELD, SLICE = 4_000_000, 2048


# ----------------------------------------------------------------------------- statistics


def medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact median per feature on the rows given, 0 when a feature has no value.

    Found by counting passes that all features share (``quantiles.column_quantiles``).
    """
    if not features:
        return {}
    got = column_quantiles(df, features, [0.5])
    return {f: float(got[(RowSet(), f)][0] or 0.0) for f in features}


def fold_medians(df: DataFrame, features: list[str], fold_col: str, folds: list) -> dict:
    """{None: medians of all rows, k: medians of the rows outside fold k} in the same passes."""
    sets = (RowSet(), *[RowSet(k, True) for k in folds])
    got = column_quantiles(df, features, [0.5], fold_col, sets)
    return {k: {f: float(got[(s, f)][0] or 0.0) for f in features} for k, s in zip([None, *folds], sets)}


def imputed(features: list[str], med: dict[str, float]) -> list[Column]:
    """``coalesce(x, median)`` after scrubbing +-inf/NaN."""
    return [F.coalesce(scrub_nonfinite(F.col(f"`{f}`").cast("double")), F.lit(float(med.get(f, 0.0)))).alias(f) for f in features]


@dataclass
class Gram:
    """Sufficient statistics of one group: Z = [x_1..x_k, 1]."""
    zz: np.ndarray
    zy: np.ndarray
    yy: float

    @property
    def n(self) -> float:
        return float(self.zz[-1, -1])

    def __add__(self, o):
        return Gram(self.zz + o.zz, self.zy + o.zy, self.yy + o.yy)

    def __sub__(self, o):
        return Gram(self.zz - o.zz, self.zy - o.zy, self.yy - o.yy)


def gram_stats(df: DataFrame, features: list[str], label: str, group_col: str | None = None,
               weight_col: str | None = None, expand=None) -> dict:
    """Per-group Gram statistics of imputed features (NULL-free input expected).

    ``expand``: (width, function) of a map that tasks apply to the rows of the feature matrix first.
    """
    k, wide = len(features), expand[0] if expand else len(features)
    g = F.col(group_col).cast("string") if group_col else F.lit("all")
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    data = df.select(g.alias("_g"), w.alias("_w"), F.col(label).cast("double").alias("_y"),
                     *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    m = wide + 1

    def fold(batches):
        acc = {}
        for pdf in batches:
            if pdf.empty:
                continue
            for key, part in pdf.groupby("_g", sort=False):
                Z = np.ones((len(part), m))
                if wide:
                    x = part[[f"x{i}" for i in range(k)]].to_numpy(dtype=float)
                    Z[:, :wide] = expand[1](x) if expand else x
                y = part["_y"].to_numpy(dtype=float)
                wt = part["_w"].to_numpy(dtype=float)
                Zw = Z * wt[:, None]
                a = acc.setdefault(key, [np.zeros((m, m)), np.zeros(m), 0.0])
                a[0] += Zw.T @ Z
                a[1] += Zw.T @ y
                a[2] += float(np.dot(wt * y, y))
        for key, (zz, zy, yy) in acc.items():
            vals = np.concatenate([zz.ravel(), zy, [yy]])
            yield pd.DataFrame({"_g": key, "pos": np.arange(len(vals), dtype=np.int32), "v": vals})

    parts = data.mapInPandas(fold, "_g string, pos int, v double")
    summed = parts.groupBy("_g", "pos").agg(F.sum("v").alias("v")).toPandas()   # groups x (k+1)^2 rows, via Arrow
    res = {}
    for key, part in summed.groupby("_g", sort=False):
        vec = np.zeros(m * m + m + 1)
        vec[part["pos"].to_numpy()] = part["v"].to_numpy()
        res[key] = Gram(vec[:m * m].reshape(m, m), vec[m * m:m * m + m], float(vec[-1]))
    return res


# ----------------------------------------------------------------------------- solvers (k x k, driver)


@dataclass
class LinearFit:
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray            # on standardised features
    intercept: float            # on standardised features (equals the training mean of y)
    medians: dict = field(default_factory=dict)

    @property
    def raw_coef(self) -> np.ndarray:
        return self.coef / self.scale

    @property
    def raw_intercept(self) -> float:
        return float(self.intercept - np.dot(self.coef / self.scale, self.mean))

    def predict_col(self) -> Column:
        """Prediction as one JVM-side column expression (imputation included)."""
        expr = F.lit(self.raw_intercept)
        for f, c in zip(self.features, self.raw_coef):
            if c != 0.0:
                x = F.coalesce(scrub_nonfinite(F.col(f"`{f}`").cast("double")), F.lit(float(self.medians.get(f, 0.0))))
                expr = expr + F.lit(float(c)) * x
        return expr


def _standardised(gr: Gram):
    n = gr.n
    k = gr.zz.shape[0] - 1
    s = gr.zz[:k, k]
    mu = s / n
    ybar = gr.zy[k] / n
    cov = gr.zz[:k, :k] / n - np.outer(mu, mu)
    var = np.clip(np.diag(cov).copy(), 0.0, None)
    sd = np.sqrt(var)
    sd[sd <= 1e-12 * np.maximum(1.0, np.abs(mu))] = 1.0     # constant feature: scale 1, as StandardScaler
    G = cov / np.outer(sd, sd)                               # (1/n) Xs'Xs of the centred, scaled design
    c = (gr.zy[:k] / n - mu * ybar) / sd                     # (1/n) Xs'(y - ybar)
    return n, mu, sd, ybar, G, c


def solve(gr: Gram, kind: str = "ridge", alpha: float = 1.0, l1_ratio: float = 0.5, w0: np.ndarray | None = None) -> tuple:
    """Fit on statistics: returns (mean, scale, coef, intercept) on standardised features."""
    n, mu, sd, ybar, G, c = _standardised(gr)
    k = len(c)
    if kind in ("ridge", "ols"):
        a = 0.0 if kind == "ols" else float(alpha)
        A = n * G + a * np.eye(k)
        w = np.linalg.lstsq(A, n * c, rcond=None)[0] if a == 0.0 else np.linalg.solve(A, n * c)
        return mu, sd, w, ybar
    if kind == "lasso":
        l1, l2 = float(alpha), 0.0
    elif kind == "elasticnet":
        l1, l2 = float(alpha) * float(l1_ratio), float(alpha) * (1.0 - float(l1_ratio))
    else:
        raise ValueError(f"unknown linear model {kind!r}")
    w = _admm_enet(G, c, l1, l2, w0)
    return mu, sd, w, ybar


def _admm_enet(G: np.ndarray, c: np.ndarray, l1, l2: float, w0=None, rho: float = 1.0,
               max_iter: int = 500, most_rounds: int = 400) -> np.ndarray:
    """argmin 0.5 w'Gw - c'w + sum_j l1_j |w_j| + 0.5 l2 |w|^2 (``l1`` scalar or per coordinate).

    A short ADMM run (one cached inverse, vectorised iterations) finds the support
    and signs; an active-set step then solves the optimality conditions on that
    support exactly and repairs it until they hold everywhere.
    """
    k = len(c)
    if k == 0:
        return np.zeros(0)
    lam = np.full(k, float(l1)) if np.isscalar(l1) else np.asarray(l1, dtype=float)
    Gl = G + l2 * np.eye(k)
    Minv = np.linalg.inv(Gl + rho * np.eye(k))
    z = np.zeros(k) if w0 is None else np.array(w0, dtype=float)
    u = np.zeros(k)
    thr = lam / rho
    for rounds in range(1, most_rounds + 1):
        for _ in range(max_iter):
            x = Minv @ (c + rho * (z - u))
            z_old = z
            v = x + u
            z = np.sign(v) * np.maximum(np.abs(v) - thr, 0.0)
            u = u + x - z
            if np.max(np.abs(x - z)) < 1e-9 and np.max(np.abs(z - z_old)) < 1e-9:
                break
        w = _active_set(Gl, c, lam, z)
        if w is not None:
            return w
        # collinear columns have no unique support to settle on: the ADMM point is an optimum once
        # the optimality conditions hold
        grad = c - Gl @ z
        gap = np.where(z != 0, np.abs(grad - lam * np.sign(z)), np.maximum(np.abs(grad) - lam, 0.0))
        if np.max(gap) <= 1e-8 * max(1.0, float(np.max(np.abs(c)))):
            return z
    raise ArithmeticError(f"the penalised fit of {k} coefficients did not converge in {most_rounds * max_iter} rounds")


def _active_set(Gl: np.ndarray, c: np.ndarray, lam: np.ndarray, w: np.ndarray, max_rounds: int = 200):
    """Exact solution near a starting point: on support A with signs s,
    Gl_AA w_A = c_A - lam_A s_A; add the worst violator |c_j - Gl_j w| > lam_j, drop
    coordinates whose sign flips.  Unpenalised coordinates (lam = 0) are always in A."""
    k = len(c)
    free = set(np.flatnonzero(lam == 0).tolist())
    active = sorted(set(np.flatnonzero(w != 0).tolist()) | free)
    signs = {j: (np.sign(w[j]) if j not in free else 0.0) for j in active}
    slack = 1e-12 * max(1.0, float(np.max(np.abs(c))))
    for _ in range(max_rounds):
        sol = np.zeros(k)
        if active:
            A = np.array(active)
            sA = np.array([signs[j] for j in active])
            sol[A] = np.linalg.lstsq(Gl[np.ix_(A, A)], c[A] - lam[A] * sA, rcond=None)[0]
            flipped = [j for j in active if j not in free and np.sign(sol[j]) != signs[j]]
            if flipped:
                j = flipped[0]
                active.remove(j)
                signs.pop(j)
                continue
        grad = c - Gl @ sol
        viol = np.abs(grad) - lam
        if active:
            viol[np.array(active)] = -np.inf
        j = int(np.argmax(viol))
        if viol[j] <= slack:
            return sol
        active.append(j)
        signs[j] = np.sign(grad[j])
    return None


def fit_linear(gr: Gram, features: list[str], med: dict, kind: str = "ridge", alpha: float = 1.0,
               l1_ratio: float = 0.5, w0: np.ndarray | None = None) -> LinearFit:
    mu, sd, w, b = solve(gr, kind, alpha, l1_ratio, w0=w0)
    return LinearFit(features, mu, sd, w, float(b), med)


# ----------------------------------------------------------------------------- grids and cross-validation

# --- fixed values: the reference's parameter grids for the linear models --------------
ALPHAS = [float(a) for a in np.logspace(-5, 1, 9)]
L1_RATIOS = [0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95]


def linear_grid(kind: str) -> list[dict]:
    if kind in ("ridge", "lasso"):
        return [{"alpha": a} for a in ALPHAS]
    if kind == "elasticnet":
        return [{"alpha": a, "l1_ratio": r} for a in ALPHAS for r in L1_RATIOS]
    if kind == "ols":
        return [{}]
    raise ValueError(kind)


def fold_grams(df: DataFrame, features: list[str], meds: dict) -> dict:
    """Gram statistics of every training set: {None: all rows, k: rows outside fold k}, each
    imputed with its own medians, in one pass over (``_fold``, ``_y``, features with NULLs)."""
    keys = list(meds)
    fill = np.array([[meds[k][f] for f in features] for k in keys])
    m = len(features) + 1

    def fold(batches):
        acc = np.zeros((len(keys), m * m + m + 1))
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            x[~np.isfinite(x)] = np.nan
            y, f = pdf["_y"].to_numpy(dtype=float), pdf["_fold"].to_numpy()
            for i, k in enumerate(keys):
                use = slice(None) if k is None else f != k
                z = np.ones((len(y[use]), m))
                z[:, :-1] = np.where(np.isnan(x[use]), fill[i], x[use])
                acc[i] += np.concatenate([(z.T @ z).ravel(), z.T @ y[use], [y[use] @ y[use]]])
        yield pd.DataFrame({"i": np.repeat(np.arange(len(keys), dtype=np.int32), acc.shape[1]),
                            "pos": np.tile(np.arange(acc.shape[1], dtype=np.int32), len(keys)), "v": acc.ravel()})

    parts = df.mapInPandas(fold, "i int, pos int, v double").groupBy("i", "pos").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for i, part in parts.groupby("i"):
        vec = np.zeros(m * m + m + 1)
        vec[part["pos"].to_numpy()] = part["v"].to_numpy()
        out[keys[int(i)]] = Gram(vec[:m * m].reshape(m, m), vec[m * m:m * m + m], float(vec[-1]))
    return out


def cv_linear(df: DataFrame, features: list[str], label: str, fold_col: str, kind: str,
              grid: list[dict] | None = None) -> tuple[DataFrame, dict]:
    """Grid search with grouped folds and two metrics.

    Medians and statistics come from the training part of each fold, as in a pipeline that is
    refitted per fold.  The narrow input is read by a few counting passes (medians), one pass for
    the statistics of all training sets, and one that scores every setting on its held-out rows:
    a matrix product per Arrow batch and (setting, fold) sums, so no row is multiplied by the
    grid.  Returns the CV table (param_id, params, fold, mae, r2) and what a refit needs.
    """
    from pyspark import StorageLevel
    spark = df.sparkSession
    grid = grid if grid is not None else linear_grid(kind)
    base = (df.select(F.col(fold_col).cast("int").alias("_fold"), F.col(label).cast("double").alias("_y"),
                      *[scrub_nonfinite(F.col(f"`{f}`").cast("double")).alias(f) for f in features])
            .where(F.col("_y").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK))
    try:
        folds = sorted(r[0] for r in base.select("_fold").distinct().collect())
        meds = fold_medians(base, features, "_fold", folds)
        stats = fold_grams(base, features, meds)
        order = sorted(range(len(grid)), key=lambda i: (grid[i].get("l1_ratio", 0.0), -grid[i].get("alpha", 0.0)))
        coef = {}
        for k in folds:
            warm: dict = {}                                         # strongest penalty first, per l1 ratio
            w = np.zeros((len(features) + 1, len(grid)))
            for pid in order:
                params = grid[pid]
                fit = fit_linear(stats[k], features, meds[k], kind, w0=warm.get(params.get("l1_ratio")), **params)
                warm[params.get("l1_ratio")] = fit.coef
                w[:-1, pid], w[-1, pid] = fit.raw_coef, fit.raw_intercept
            coef[k] = w
        fill = {k: np.array([meds[k][f] for f in features]) for k in folds}
        size = len(grid)

        def held(batches):
            acc = {k: np.zeros((size + 1, 4)) for k in folds}
            for pdf in batches:
                x, y, f = pdf[features].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float), pdf["_fold"].to_numpy()
                for k in folds:
                    use = f == k
                    if use.any():
                        z = np.where(np.isnan(x[use]), fill[k], x[use])
                        e = y[use][:, None] - (z @ coef[k][:-1] + coef[k][-1])
                        a = acc[k]
                        a[:size, 0] += np.abs(e).sum(axis=0)
                        a[:size, 1] += (e * e).sum(axis=0)
                        shift = y[use] - stats[k].zy[-1] / stats[k].n           # about the training mean: no cancellation
                        a[size] += [use.sum(), shift.sum(), (shift * shift).sum(), 0]
            for k, a in acc.items():
                yield pd.DataFrame({"fold": np.int32(k), "param_id": np.arange(size + 1, dtype=np.int32), "s0": a[:, 0], "s1": a[:, 1], "s2": a[:, 2]})

        sums = base.mapInPandas(held, "fold int, param_id int, s0 double, s1 double, s2 double").groupBy("fold", "param_id").agg(
            *[F.sum(c).alias(c) for c in ("s0", "s1", "s2")]).toPandas().set_index(["fold", "param_id"])       # folds x settings rows
    finally:
        base.unpersist()
    rows = []
    for k in folds:
        n, s, ss = sums.loc[(k, size)]
        sst = ss - s * s / n if n else 0.0
        for pid, params in enumerate(grid):
            sae, sse, _ = sums.loc[(k, pid)]
            r2 = float(1 - sse / sst) if n >= 2 and sst > 1e-12 * max(1.0, ss) else None
            rows.append((pid, {a: str(b) for a, b in params.items()}, int(k), float(sae / n), r2))
    cv = spark.createDataFrame(rows, "param_id int, params map<string,string>, fold int, mae double, r2 double")
    return cv, {"stats": stats, "total": stats[None], "medians": meds[None], "grid": grid}


def best_setting(cv_summary: DataFrame, grid: list[dict], refit: str = "r2") -> dict:
    """Setting ranked first by the refit metric."""
    col = "rank_test_r2" if refit == "r2" else "rank_test_mae"
    r = cv_summary.orderBy(col, "param_id").first()
    return grid[int(r["param_id"])]


def coefficient_table(spark, fit: LinearFit) -> DataFrame:
    """Non-zero coefficients (standardised scale) by magnitude."""
    rows = [(f, float(c)) for f, c in zip(fit.features, fit.coef) if c != 0.0]
    rows.sort(key=lambda t: -abs(t[1]))
    return spark.createDataFrame(rows, "feature string, coef double")


def linear_attribution(df: DataFrame, fit: LinearFit, top_n: int = 20) -> DataFrame:
    """Mean |coef_j * (z_j - mean z_j)| per feature, top n (M20, O2).  One aggregate."""
    zs = []
    for f, mu, sd in zip(fit.features, fit.mean, fit.scale):
        x = F.coalesce(scrub_nonfinite(F.col(f"`{f}`").cast("double")), F.lit(float(fit.medians.get(f, 0.0))))
        zs.append(((x - F.lit(float(mu))) / F.lit(float(sd))).alias(f))
    z = df.select(*zs)
    means = z.agg(*[F.avg(f"`{f}`").alias(f) for f in fit.features]).first()
    agg = z.agg(*[F.avg(F.abs(F.lit(float(c)) * (F.col(f"`{f}`") - F.lit(float(means[f] or 0.0))))).alias(f"a{i}")
                  for i, (f, c) in enumerate(zip(fit.features, fit.coef))])
    stack = ", ".join(f"'{f}', a{i}" for i, f in enumerate(fit.features))
    long = agg.selectExpr(f"stack({len(fit.features)}, {stack}) as (feature, mean_abs_attr)")
    return long.orderBy(F.desc("mean_abs_attr"), "feature").limit(int(top_n))


# ----------------------------------------------------------------------------- bootstrap refits


def bootstrap_gram(train: DataFrame, features: list[str], label: str, med: dict, id_col: str = "id",
                   n_boot: int = 200, seed: int = 42, partitions: int | None = None) -> list[Gram]:
    """Gram statistics of B id-resampled training sets (draws with multiplicity).

    Rows meet their id's draw list (at most B entries, a fixed bound) by a join on
    id; each task reduces the ids of a batch to per-id statistics S and adds W'S for
    all replicates at once (B x ids_in_task x (k+1)^2 work, never B x rows).
    """
    from cohortflow.operators.resample import bootstrap_weights, draw_lists, draw_matrix, replicate_rows, summed_replicates
    k = len(features)
    m = k + 1
    width = m * m + m + 1
    B = int(n_boot)
    draws = draw_lists(bootstrap_weights(train.select(id_col).distinct(), B, id_col, seed, "weighted"), id_col)
    imp = train.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_y"),
                       *[c.alias(f"x{i}") for i, c in enumerate(imputed(features, med))]).where(F.col("_y").isNotNull())
    j = imp.join(draws.withColumnRenamed(id_col, "_id"), "_id")
    if partitions:
        j = j.coalesce(int(partitions))
    block = max(1, min(512, HELD // width))

    def fold(batches):
        acc = np.zeros((B, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("_id").dictionary_encode().indices.to_numpy()
            order = np.argsort(own, kind="stable")
            start = np.flatnonzero(np.diff(own[order], prepend=-1))
            z = np.column_stack([*[batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(k)], np.ones(batch.num_rows)])[order]
            y = batch.column("_y").to_numpy(zero_copy_only=False)[order]
            end = np.append(start[1:], len(own))
            for at in range(0, len(start), block):
                s = np.empty((len(start[at:at + block]), width))
                for i, (lo, hi) in enumerate(zip(start[at:at + block], end[at:at + block])):
                    zi, yi = z[lo:hi], y[lo:hi]
                    s[i, :m * m], s[i, m * m:-1], s[i, -1] = (zi.T @ zi).ravel(), zi.T @ yi, yi @ yi
                acc += draw_matrix(batch.column("_draws"), order[start[at:at + block]], B).T @ s
        yield replicate_rows(acc)

    got = {r["b"]: np.frombuffer(r["v"]) for r in summed_replicates(j.mapInArrow(fold, "b int, v binary")).collect()}   # B rows of (k+1)^2 numbers
    none = np.zeros(width)
    return [Gram(vec[:m * m].reshape(m, m), vec[m * m:m * m + m], float(vec[-1])) for vec in (got.get(b, none) for b in range(B))]


def bootstrap_intervals(test: DataFrame, fits: list[LinearFit], base_col: str | None = None, alpha: float = 0.05,
                        bounds=(0.0, 10.0)) -> DataFrame:
    """Per test row: quantiles a/2 and 1-a/2 of the B clamped absolute forecasts.

    The B coefficient vectors (B x (k+1) numbers) go to the tasks, which score a slice of rows
    by one matrix product.
    """
    feats = fits[0].features
    coef = np.array([f.raw_coef for f in fits]).reshape(len(fits), len(feats)).T
    shift = np.array([f.raw_intercept for f in fits])
    lo_b, hi_b = bounds
    n = len(fits)

    def q(p, prob):
        pos = prob * (n - 1)
        lo = int(pos)
        return p[:, lo] + (p[:, min(lo + 1, n - 1)] - p[:, lo]) * (pos - lo)

    @F.pandas_udf("lo double, hi double")
    def interval(base: pd.Series, *x: pd.Series) -> pd.DataFrame:
        out = np.empty((len(base), 2))
        for i in range(0, len(base), SLICE):
            z = np.column_stack([v.to_numpy(dtype=float)[i:i + SLICE] for v in x]) if x else np.zeros((len(base[i:i + SLICE]), 0))
            p = z @ coef + shift + base.to_numpy(dtype=float)[i:i + SLICE, None]
            p = np.sort(np.fmax(lo_b, np.fmin(hi_b, p)), axis=1)                  # a missing forecast takes the upper bound
            out[i:i + SLICE, 0], out[i:i + SLICE, 1] = q(p, alpha / 2), q(p, 1 - alpha / 2)
        return pd.DataFrame({"lo": out[:, 0], "hi": out[:, 1]})

    base = F.col(base_col).cast("double") if base_col else F.lit(0.0)
    both = test.select("*", interval(base, *imputed(feats, fits[0].medians)).alias("_interval"))
    return both.select(*[F.col(f"`{c}`") for c in test.columns], F.col("_interval.lo").alias("y_pred_abs_ci_low"), F.col("_interval.hi").alias("y_pred_abs_ci_high"))
