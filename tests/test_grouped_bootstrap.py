"""Bootstrap intervals of many groups against replicates formed row by row; digits counted in numpy."""

import numpy as np
import pandas as pd

from cohortflow.operators import metrics as mt
from cohortflow.operators.quantiles import _Digits
from cohortflow.operators.resample import bootstrap_weights


def test_grouped_intervals_match_replicates_and_join_only_ids(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": rng.integers(0, 15, 240), "g": rng.integers(0, 3, 240), "y": rng.normal(size=240)})
    pdf["p"] = pdf["y"] + rng.normal(size=240)
    rows = [(int(i), None if g == 2 else int(g), float(y), float(p)) for i, g, y, p in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "id long, g int, y double, p double")
    seen = []
    summed = mt.summed_replicates
    monkeypatch.setattr(mt, "summed_replicates", lambda parts: (seen.append(parts), summed(parts))[1])
    got = {r["g"]: r for r in mt.bootstrap_metric_ci_grouped(df, ["g"], "id", "y", "p", 40).collect()}
    assert len(seen) == 1 and set(got) == {0, 1, None}
    w = bootstrap_weights(df.select("id").distinct(), 40, "id", 42, "membership").toPandas()
    for g, r in got.items():
        own = pdf[pdf["g"] == (2 if g is None else g)]
        r2, mae = [], []
        for b in range(40):
            d = own[own["id"].isin(w[w["b"] == b]["id"])]
            r2.append(1 - ((d["y"] - d["p"]) ** 2).sum() / ((d["y"] - d["y"].mean()) ** 2).sum())
            mae.append((d["y"] - d["p"]).abs().mean())
        np.testing.assert_allclose([r["R2_ci_low"], r["R2_ci_high"]], np.quantile(r2, [0.025, 0.975]), rtol=1e-9)
        np.testing.assert_allclose([r["MAE_ci_low"], r["MAE_ci_high"]], np.quantile(mae, [0.025, 0.975]), rtol=1e-9)


def test_digits_are_counted_in_bounded_slices():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 65536, n).astype(np.uint16) for n in (10, 70_000, 3, 65_536)]
    d = _Digits()
    for x in parts:
        d.add(x)
        assert d.size < 65_536
    digit, many = d.counts()
    want = np.unique(np.concatenate(parts), return_counts=True)
    assert digit.tolist() == want[0].tolist() and many.tolist() == want[1].tolist()
