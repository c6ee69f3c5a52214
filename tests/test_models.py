"""Linear learners and the logistic IRLS against closed forms on small data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import linear as lin
from cohortflow.operators import logistic as lg
from cohortflow.operators.quantiles import exact_quantiles


def _data(spark, n=400, k=5, seed=0, missing=0.05):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, k))
    y = 2 * X[:, 0] - X[:, 1] + 0.5 * rng.normal(size=n)
    Xm = X.copy()
    Xm[rng.random((n, k)) < missing] = np.nan
    pdf = pd.DataFrame(Xm, columns=[f"f{i}" for i in range(k)])
    pdf["y"] = y
    pdf["fold"] = np.arange(n) % 5
    return pdf, spark.createDataFrame(pdf)


def _prep(pdf, feats, med):
    X = pdf[feats].fillna(pd.Series(med)).to_numpy()
    mu, sd = X.mean(0), X.std(0)
    return (X - mu) / sd, pdf["y"].to_numpy()


def test_medians_exact(spark):
    pdf, df = _data(spark)
    feats = [f"f{i}" for i in range(5)]
    med = lin.medians(df, feats)
    for f in feats:
        assert med[f] == pytest.approx(float(pdf[f].median()))


def test_ridge_equals_closed_form(spark):
    pdf, df = _data(spark)
    feats = [f"f{i}" for i in range(5)]
    med = lin.medians(df, feats)
    st = lin.gram_stats(df.select("y", *lin.imputed(feats, med)), feats, "y")["all"]
    Xs, y = _prep(pdf, feats, med)
    for a in (1e-5, 0.1, 10.0):
        fit = lin.fit_linear(st, feats, med, "ridge", alpha=a)
        yc = y - y.mean()
        w = np.linalg.solve(Xs.T @ Xs + a * np.eye(5), Xs.T @ yc)
        np.testing.assert_allclose(fit.coef, w, rtol=1e-8, atol=1e-10)
        assert fit.intercept == pytest.approx(y.mean())


def test_lasso_and_enet_optimality(spark):
    pdf, df = _data(spark, k=8, seed=5)
    feats = [f"f{i}" for i in range(8)]
    med = lin.medians(df, feats)
    st = lin.gram_stats(df.select("y", *lin.imputed(feats, med)), feats, "y")["all"]
    Xs, y = _prep(pdf, feats, med)
    n = len(y)
    for kind, a, r in (("lasso", 0.05, 1.0), ("elasticnet", 0.1, 0.5)):
        fit = lin.fit_linear(st, feats, med, kind, alpha=a, l1_ratio=r)
        w = fit.coef
        grad = Xs.T @ (y - y.mean() - Xs @ w) / n - a * (1 - r) * w
        nz = w != 0
        np.testing.assert_allclose(grad[nz], a * r * np.sign(w[nz]), atol=1e-9)
        assert np.all(np.abs(grad[~nz]) <= a * r + 1e-9)


def test_prediction_column_matches_numpy(spark):
    pdf, df = _data(spark)
    feats = [f"f{i}" for i in range(5)]
    med = lin.medians(df, feats)
    st = lin.gram_stats(df.select("y", *lin.imputed(feats, med)), feats, "y")["all"]
    fit = lin.fit_linear(st, feats, med, "ridge", alpha=1.0)
    got = np.array([r[0] for r in df.select(fit.predict_col()).collect()])
    Xs, _ = _prep(pdf, feats, med)
    np.testing.assert_allclose(got, fit.intercept + Xs @ fit.coef, rtol=1e-9)


def test_cv_grid_runs_and_ranks(spark):
    from cohortflow.operators.metrics import cv_summary
    pdf, df = _data(spark)
    feats = [f"f{i}" for i in range(5)]
    cv, _ = lin.cv_linear(df, feats, "y", "fold", "ridge")
    s = cv_summary(cv, ("param_id",)).toPandas()
    assert len(s) == 9 and s.n_folds.eq(5).all() and s.rank_test_r2.min() == 1
    assert s.mean_test_r2.max() > 0.8


def test_logistic_irls_matches_newton(spark):
    rng = np.random.default_rng(7)
    n = 600
    X = rng.normal(size=(n, 3))
    a = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + X[:, 0] - 0.7 * X[:, 1])))).astype(float)
    pdf = pd.DataFrame(X, columns=["x0", "x1", "x2"])
    pdf["a"], pdf["fold"] = a, 0
    df = spark.createDataFrame(pdf)
    sd = X.std(0)
    betas, _, converged = lg.fit_many(df, ["x0", "x1", "x2"], "a", "fold", [("l2", None, "l2"), ("none", None, None)],
                           {"l2": sd, "none": sd})
    assert converged == {"l2": True, "none": True}
    Z = np.c_[X, np.ones(n)]
    for name, R in (("l2", np.diag(np.append(sd ** 2, 0.0))), ("none", np.zeros((4, 4)))):
        b = np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-Z @ b))
            b = b + np.linalg.solve(Z.T @ (Z * (p * (1 - p))[:, None]) + R, Z.T @ (a - p) - R @ b)
        np.testing.assert_allclose(betas[name], b, rtol=1e-5, atol=1e-6)


def test_exact_quantiles_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=997), np.full(500, 1.5)]         # a hot value
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.025, 0.1, 0.5, 0.9, 0.975, 1.0]
    np.testing.assert_allclose(exact_quantiles(df, "x", probs), np.quantile(x, probs), rtol=1e-12)


def test_bootstrap_refits_equal_explicit_refits(spark):
    """Weighted Gram statistics per replicate equal refits on explicitly resampled rows."""
    from cohortflow.operators.resample import bootstrap_weights
    rng = np.random.default_rng(11)
    rows = []
    for i in range(30):
        for d in range(rng.integers(3, 9)):
            x = rng.normal(size=3)
            rows.append((i, float(x[0]), float(x[1]), float(x[2]), float(x[0] - 2 * x[1] + rng.normal())))
    pdf = pd.DataFrame(rows, columns=["id", "f0", "f1", "f2", "y"])
    df = spark.createDataFrame(pdf)
    feats = ["f0", "f1", "f2"]
    med = {f: 0.0 for f in feats}
    grams = lin.bootstrap_gram(df, feats, "y", med, "id", n_boot=5, seed=3)
    w = bootstrap_weights(df.select("id").distinct(), 5, "id", 3).toPandas()
    for b in range(5):
        wb = w[w.b == b]
        rep = pd.concat([pdf[pdf.id == i] for i, k in zip(wb.id, wb.weight) for _ in range(int(k))])
        X, y = rep[feats].to_numpy(), rep["y"].to_numpy()
        Xs = (X - X.mean(0)) / X.std(0)
        coef = np.linalg.solve(Xs.T @ Xs + 1.0 * np.eye(3), Xs.T @ (y - y.mean()))
        fit = lin.fit_linear(grams[b], feats, med, "ridge", alpha=1.0)
        np.testing.assert_allclose(fit.coef, coef, rtol=1e-8)
    fits = [lin.fit_linear(g, feats, med, "ridge", alpha=1.0) for g in grams]
    iv = lin.bootstrap_intervals(df.limit(20), fits, bounds=(-100.0, 100.0)).toPandas()
    assert (iv.y_pred_abs_ci_low <= iv.y_pred_abs_ci_high).all()


def test_permutation_shapley_linear_is_exact(spark):
    """For a linear model and one background point every permutation gives coef*(x - bg)."""
    from cohortflow.operators.explain import HYBRIDS, permutation_shapley, shapley_rows
    rng = np.random.default_rng(9)
    X = rng.normal(size=(200, 3))
    coef, bg = np.array([1.5, -2.0, 0.3]), np.array([0.1, -0.2, 0.3])
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "_rid long, a double, b double, c double")
    got = permutation_shapley(lambda m: m @ coef, rows, ["a", "b", "c"], list(bg), n_perm=4, per_row=True).toPandas()
    wide = got.pivot(index="_rid", columns="feature", values="phi").sort_index()[["a", "b", "c"]].to_numpy()
    np.testing.assert_allclose(wide, (X - bg) * coef, atol=1e-9)
    top = permutation_shapley(lambda m: m @ coef, rows, ["a", "b", "c"], list(bg), n_perm=4).collect()
    assert [r["feature"] for r in top][-1] == "c"
    assert top[0]["mean_abs_shap"] == pytest.approx(np.abs((X - bg) * coef).mean(axis=0).max())
    # a full Arrow batch never holds more than HYBRIDS vectors at once
    sizes = []
    shapley_rows(lambda m: (sizes.append(len(m)), m.sum(axis=1))[1], rng.normal(size=(3000, 74)), np.zeros(74), np.array([rng.permutation(74)]))
    assert max(sizes) <= HYBRIDS and sum(sizes) == 3000 * 75


def test_flat_trees_equal_the_model(spark):
    from cohortflow.operators import trees as tr
    rng = np.random.default_rng(4)
    X = rng.normal(size=(400, 4))
    df = spark.createDataFrame([(int(i), *map(float, x), float(x[0] * 2 + (x[1] > 0) + rng.normal() * 0.1)) for i, x in enumerate(X)], "id long, a double, b double, c double, d double, y double")
    a = tr.assemble(df, ["a", "b", "c", "d"], {}, ["id", "y"])
    model = tr.fit_forest(a, "y", 12, 5, 2)
    flat = tr.flat_trees(model, spark)
    want = np.array([r["prediction"] for r in model.transform(a).orderBy("id").collect()])
    np.testing.assert_allclose(flat.mean(X), want, rtol=1e-12)
    one = np.stack([[t.predict(v) for t in model.trees] for v in (r["features"] for r in a.orderBy("id").limit(5).collect())])
    np.testing.assert_allclose(flat.predict(X[:5]), one, rtol=1e-12)
    iv = tr.forest_interval(model, a, bounds=(-10, 10)).orderBy("id").toPandas()
    np.testing.assert_allclose(iv.y_pred_lo.to_numpy()[:5], np.quantile(one, 0.1, axis=1), rtol=1e-12)
    assert (iv.y_pred_lo <= iv.y_pred_median).all() and (iv.y_pred_median <= iv.y_pred_hi).all()
    with pytest.raises(ValueError):
        tr.fit_forest(a, "y", 2, 31)


def test_column_quantiles_equal_numpy_in_every_set(spark):
    from cohortflow.operators import quantiles as q
    rng = np.random.default_rng(12)
    n = 3000
    cols = {"a": rng.normal(size=n), "b": rng.integers(-3, 4, n).astype(float), "c": np.where(rng.random(n) < 0.4, np.nan, rng.lognormal(sigma=8, size=n)),
            "d": np.full(n, np.nan), "e": np.where(rng.random(n) < 0.5, -0.0, 0.0)}
    g = rng.integers(0, 3, n)
    rows = [(int(s), *[None if np.isnan(v[i]) else float(v[i]) for v in cols.values()]) for i, s in enumerate(g)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double, e double").repartition(5)
    sets = (q.RowSet(), q.RowSet(0), q.RowSet(1, True), q.RowSet(9))
    probs = [0.0, 0.1, 0.5, 0.975, 1.0]
    for few in (q.FEW, 0):                                    # with the short cut, and by counting to the end
        old, q.FEW = q.FEW, few
        try:
            got = q.column_quantiles(df, list(cols), probs, "g", sets)
        finally:
            q.FEW = old
        for s, use in zip(sets, (np.ones(n, bool), g == 0, g != 1, g == 9)):
            for c, v in cols.items():
                x = v[use & ~np.isnan(v)]
                if len(x):
                    np.testing.assert_allclose(got[(s, c)], np.quantile(x, probs), rtol=1e-13, atol=0)
                else:
                    assert got[(s, c)] == [None] * len(probs)


def test_medians_move_no_rows(spark):
    from cohortflow.operators import quantiles as q
    seen = []
    df = spark.range(5000).selectExpr("CAST(id AS DOUBLE) % 97 AS a", "CAST(id AS DOUBLE) AS b")
    old = type(df).collect

    def spy(self):
        seen.append(self._jdf.queryExecution().optimizedPlan().toString())
        return old(self)

    type(df).collect = spy
    try:
        got = q.column_quantiles(df, ["a", "b"], [0.5])
    finally:
        type(df).collect = old
    assert got[(q.RowSet(), "b")] == [2499.5] and seen
    assert not any("Repartition" in p or "Sort [a" in p for p in seen)


def test_cv_uses_training_fold_medians(spark):
    rng = np.random.default_rng(5)
    n = 300
    x = np.where(rng.random(n) < 0.4, np.nan, rng.lognormal(size=n))
    z, fold = rng.normal(size=n), rng.integers(0, 3, n)
    y = np.nan_to_num(x) + z + rng.normal(size=n)
    df = spark.createDataFrame([(int(f), None if np.isnan(a) else float(a), float(b), float(c)) for f, a, b, c in zip(fold, x, z, y)], "fold int, x double, z double, y double")
    cv, _ = lin.cv_linear(df, ["x", "z"], "y", "fold", "ridge", [{"alpha": 0.5}])
    for r in cv.collect():
        tr, te = fold != r["fold"], fold == r["fold"]
        m = np.nanmedian(x[tr])
        X = np.c_[np.where(np.isnan(x), m, x), z]
        mu, sd = X[tr].mean(0), X[tr].std(0)
        S = (X - mu) / sd
        w = np.linalg.solve(S[tr].T @ S[tr] + 0.5 * np.eye(2), S[tr].T @ (y[tr] - y[tr].mean()))
        e = y[te] - S[te] @ w - y[tr].mean()
        assert r["mae"] == pytest.approx(np.abs(e).mean())
        assert r["r2"] == pytest.approx(1 - (e @ e) / ((y[te] - y[te].mean()) ** 2).sum())


def test_bootstrap_draws_are_a_matrix_per_slice_of_ids(spark):
    import pyarrow as pa
    from cohortflow.operators.resample import draw_lists, draw_matrix
    w = spark.createDataFrame([(0, 7, 2), (2, 7, 1), (1, 9, 3)], "b int, id long, weight long")
    lists = draw_lists(w).toArrow().sort_by("id").combine_chunks()["_draws"].combine_chunks()
    assert draw_matrix(lists, np.array([1, 0]), 4).tolist() == [[0, 3, 0, 0], [2, 0, 1, 0]]


def test_bootstrap_gram_with_ids_in_any_order_matches_expanded_rows(spark):
    from cohortflow.operators.resample import bootstrap_weights
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": rng.integers(0, 9, 200), "a": rng.normal(size=200), "y": rng.normal(size=200)})
    df = spark.createDataFrame(pdf).repartition(3)
    grams = lin.bootstrap_gram(df, ["a"], "y", {"a": 0.0}, "id", n_boot=6, seed=1)
    w = bootstrap_weights(df.select("id").distinct(), 6, "id", 1).toPandas()
    for b, g in enumerate(grams):
        own = pdf.merge(w[w["b"] == b], on="id")
        z = np.column_stack([own["a"], np.ones(len(own))])
        np.testing.assert_allclose(g.zz, (z * own["weight"].to_numpy()[:, None]).T @ z, rtol=1e-10, atol=1e-10)
        np.testing.assert_allclose(g.yy, float((own["weight"] * own["y"] ** 2).sum()), rtol=1e-10)
