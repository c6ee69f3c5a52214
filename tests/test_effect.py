"""Effect learner on simulated events with a planted effect."""

import numpy as np
import pandas as pd
import pytest

from cohortflow.plans.effect import EffectConfig, t_learner


def test_planted_effect_recovered(spark):
    rng = np.random.default_rng(5)
    rows = []
    tau = 1.5
    for i in range(160):
        u = rng.normal()
        for c in range(int(rng.integers(2, 7))):
            x1, x2 = rng.normal() + 0.5 * u, rng.normal()
            a = int(rng.random() < 1 / (1 + np.exp(-(0.8 * x1))))          # confounded by x1
            y = 2 * x1 - x2 + tau * a + 0.3 * rng.normal()
            rows.append((i, 10 * c + 1, a, float(y), float(x1), float(x2)))
    pdf = pd.DataFrame(rows, columns=["id", "centre_day", "A_star", "Y_star", "x1", "x2"])
    ev = spark.createDataFrame(pdf)
    out, summary, samples, losses = t_learner(ev, EffectConfig(model="ridge", n_boot=50))
    s = summary.first()
    assert s["ATE"] == pytest.approx(tau, abs=0.3)
    assert s["ATE_DR"] == pytest.approx(tau, abs=0.4)
    assert s["ATE_ci_low"] <= s["ATE"] <= s["ATE_ci_high"]
    assert samples.count() == 50 and losses.count() == 3
    assert out.where("e_hat < 0.001 or e_hat > 0.999").count() == 0


def test_converged_models_leave_the_passes(spark, monkeypatch):
    from cohortflow.operators import logistic as lg
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    a = (rng.random(300) < 1 / (1 + np.exp(-x))).astype(float)
    rows = [(i % 3, float(a[i]), float(x[i]), float(a[i] * 2 - 1)) for i in range(300)]       # x1 separates the arms
    df = spark.createDataFrame(rows, "fold int, a double, x0 double, x1 double").coalesce(2)
    steps, real = [], lg._prox_step
    monkeypatch.setattr(lg, "_prox_step", lambda *v: steps.append(1) or real(*v))
    models, scales = [("one", None, "l1"), ("none", None, None)], {"one": np.array([1.0, 1e-3]), "none": np.ones(2)}
    beta, loss, done = lg.fit_many(df, ["x0", "x1"], "a", "fold", models, scales, max_iter=25, tol=1e-6)
    alone, _, _ = lg.fit_many(df, ["x0", "x1"], "a", "fold", [models[0]], scales, max_iter=25, tol=1e-6)
    used = len(steps)
    assert done["one"] and set(loss) == {"one", "none"} and beta["one"] == pytest.approx(alone["one"], abs=1e-9)
    assert used < 2 * 25 and used % 2 == 0                    # as many steps beside the other model as alone
