"""Random Fourier features: tasks multiply matrices, nothing is folded row by row in the plan."""

import numpy as np
import pandas as pd

from cohortflow.operators import linear as lin
from cohortflow.operators.kernel import fit_rff_ridge, rff_matrix, rff_params


def test_rff_ridge_matches_numpy_and_folds_no_arrays(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = np.sin(x[:, 0]) + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    feats = ["a", "b", "c"]
    predict, fit = fit_rff_ridge(df, feats, "y", lin.medians(df, feats), 20, None, 1.0)
    out = df.select("a", "b", "c", predict(df).alias("p"))
    plan = out._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "aggregate(" not in plan
    W, b = rff_params(3, 20)
    got = out.toPandas()
    z = rff_matrix(got[feats].to_numpy(), x.mean(axis=0), x.std(axis=0), W, b)
    np.testing.assert_allclose(got["p"], z @ fit.raw_coef + fit.raw_intercept, rtol=1e-9, atol=1e-9)
    zt = rff_matrix(x, x.mean(axis=0), x.std(axis=0), W, b)
    zs = (zt - zt.mean(axis=0)) / zt.std(axis=0)
    np.testing.assert_allclose(fit.coef, np.linalg.solve(zs.T @ zs + np.eye(20), zs.T @ (y - y.mean())), rtol=1e-6, atol=1e-8)
