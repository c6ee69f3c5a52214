"""Splits, folds and draws: disjoint, exhaustive, sized as specified, deterministic."""

import numpy as np

from cohortflow.operators import resample as rs


def _ids(spark, n):
    return spark.range(n).selectExpr("id * 7 + 3 as id")


def test_split_sizes_disjoint_exhaustive(spark):
    for n in (1, 2, 7, 150, 1001):
        sp = rs.split_ids(_ids(spark, n), "id", 0.15, 0.15).toPandas()
        assert len(sp) == n and sp.id.is_unique
        n_test = max(1, round(0.15 * n))
        n_val = max(1, round(0.15 * (n - n_test)))
        assert (sp.split == "test").sum() == min(n_test, n)
        if n > n_test:
            assert (sp.split == "val").sum() == min(n_val, n - n_test)


def test_ranks_are_a_permutation(spark):
    r = rs.ranked_ids(_ids(spark, 5000)).toPandas()
    assert sorted(r["rank"]) == list(range(5000))
    assert (r.sort_values("rank")["h"].diff().dropna() >= 0).all()


def test_grouped_folds_balanced(spark):
    f = rs.grouped_folds(_ids(spark, 103), 5).toPandas()
    sizes = f.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 1 and f.id.is_unique


def test_bootstrap_weights(spark):
    w = rs.bootstrap_weights(_ids(spark, 40), 25).toPandas()
    assert (w.groupby("b")["weight"].sum() == 40).all()
    m = rs.bootstrap_weights(_ids(spark, 40), 25, mode="membership").toPandas()
    assert m.weight.max() == 1
    frac = m.groupby("b").size().mean() / 40
    assert 0.5 < frac < 0.75                                   # about 1 - 1/e of ids drawn
    again = rs.bootstrap_weights(_ids(spark, 40), 25).toPandas()
    assert w.sort_values(["b", "id"]).reset_index(drop=True).equals(again.sort_values(["b", "id"]).reset_index(drop=True))


def test_bootstrap_metric_ci_equals_brute_force(spark):
    """A8 from per-id statistics equals recomputing R2/MAE on the drawn rows."""
    import pandas as pd
    from cohortflow.operators.metrics import bootstrap_metric_ci
    rng = np.random.default_rng(6)
    rows = [(int(i), float(y), float(y + rng.normal(0, 0.5))) for i in range(25)
            for y in rng.normal(i % 5, 1, size=int(rng.integers(2, 6)))]
    pdf = pd.DataFrame(rows, columns=["id", "y", "p"])
    df = spark.createDataFrame(pdf)
    got = bootstrap_metric_ci(df, "id", "y", "p", n_boot=30, seed=1).first()
    w = rs.bootstrap_weights(df.select("id").distinct(), 30, "id", 1, mode="membership").toPandas()
    r2s, maes = [], []
    for b in range(30):
        sel = pdf[pdf.id.isin(w[w.b == b].id)]
        e = sel.y - sel.p
        r2s.append(1 - (e ** 2).sum() / ((sel.y - sel.y.mean()) ** 2).sum())
        maes.append(e.abs().mean())
    np.testing.assert_allclose([got.Y_R2_ci_low, got.Y_R2_ci_high], np.quantile(r2s, [0.025, 0.975]), rtol=1e-9)
    np.testing.assert_allclose([got.Y_MAE_ci_low, got.Y_MAE_ci_high], np.quantile(maes, [0.025, 0.975]), rtol=1e-9)
