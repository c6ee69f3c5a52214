"""Descriptive operators against direct numpy evaluations."""

import math

import numpy as np
import pandas as pd

from cohortflow.operators import describe as ds


def test_grouped_exact_quantiles_numpy(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 4, size=3000)
    x = np.where(g == 2, 7.0, rng.normal(size=3000))        # one group is a single hot value
    df = spark.createDataFrame(pd.DataFrame({"g": g.astype(int), "x": x}))
    got = ds.grouped_exact_quantiles(df, "g", "x", [0.1, 0.5, 0.9]).toPandas()
    for (grp, q), v in got.set_index(["g", "q"])["value"].items():
        assert math.isclose(v, float(np.quantile(x[g == grp], q)), rel_tol=1e-12, abs_tol=1e-12)


def test_correlation_block_equals_pandas_on_pairwise_complete_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(1e6, 1.0, size=(700, 6))                    # far from zero: plain sums of squares would cancel
    x[:, 1] = x[:, 0] + rng.normal(size=700) * 0.1
    x[:, 4] = 3.0                                             # no spread
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:50] = np.nan                                           # rows without any value
    x[:, 5] = np.nan
    x[60, 5] = 1.0                                            # a single value
    pdf = pd.DataFrame(x, columns=["a", "b", "c", "d e", "flat", "rare"])
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{c}` double" for c in pdf.columns)).repartition(5)
    want = pdf.corr().abs().fillna(0.0)
    got = ds.correlation_block(df, list(pdf.columns)).collect()
    assert len(got) == 15
    for r in got:
        assert math.isclose(r["abs_corr"], want.loc[r["col_a"], r["col_b"]], abs_tol=1e-9), r
        assert r["near_duplicate"] == (0.95 < r["abs_corr"] < 1)
    assert any(r["near_duplicate"] for r in got)


def test_correlation_block_of_no_rows_and_of_infinite_values(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [tuple(r) for r in ds.correlation_block(empty, ["a", "b"]).collect()] == [("a", "b", 0.0, False)]
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (float("inf"), 7.0), (4.0, float("nan"))], "a double, b double")
    (r,) = ds.correlation_block(rows, ["a", "b"]).collect()
    assert math.isclose(r["abs_corr"], abs(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1]), abs_tol=1e-9)


def test_kde_grid_matches_formula(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(5, 2, size=400), 2)               # repeated values exercise the multiplicity
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = ds.kde_grid(df, "x").toPandas().sort_values("g")
    h = x.std(ddof=1) * len(x) ** (-0.2)
    grid = np.linspace(x.min(), x.max(), 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    np.testing.assert_allclose(got["x"].to_numpy(), grid, rtol=1e-12)
    np.testing.assert_allclose(got["density"].to_numpy(), dens, rtol=1e-9)
