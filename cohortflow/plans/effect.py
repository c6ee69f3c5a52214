"""Entry C: event study -> propensity -> T-learner -> cross-fit -> DR learner.

Outcome models are linear learners fitted from per-(fold, arm) statistics (one
pass for all folds and both arms); the propensity models (3 penalties x folds)
are fitted together by IRLS passes (``operators.logistic``).  Predictions stay on the executors;
only coefficients and small summaries reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.scalar import clamp
from cohortflow.operators import linear as lin
from cohortflow.operators import metrics as mt
from cohortflow.operators import resample as rs
from cohortflow.plans.features import effect_feature_columns

# --- fixed values: propensity penalty settings compared by grouped-fold log loss -------
PENALTIES = (("unpenalized", None), ("l1", "l1"), ("l2", "l2"))
EPS = 1e-3


@dataclass(frozen=True)
class EffectConfig:
    model: str = "lasso"
    test_size: float = 0.2
    n_folds: int = 5
    n_boot: int = 300
    seed: int = 42
    compat: bool = False


def propensity(train: DataFrame, test: DataFrame, feats: list[str], med: dict, n_folds: int):
    """Penalty chosen by mean grouped-fold log loss; out-of-fold scores on train, refit for
    test; clamped to [0.001, 0.999] (M13, A16).  All 3 x (folds + 1) models are fitted
    together by IRLS passes over the training rows."""
    from cohortflow.operators import logistic as lg
    imp = lin.imputed(feats, med)
    tr = train.select("_row", "fold", F.col("A_star").cast("double").alias("_a"), *imp)
    # population sd of every training set, from per-fold statistics (one pass)
    st = lin.gram_stats(tr, feats, "_a", "fold")
    total = None
    for g in st.values():
        total = g if total is None else total + g

    def sd_of(gr):
        _, _, sd, _, _, _ = lin._standardised(gr)
        return sd
    models, scales = [], {}
    for name, pen in PENALTIES:
        for k in list(range(n_folds)) + [None]:
            key = f"{name}:{k}"
            models.append((key, k, pen))
            scales[key] = sd_of(total - st[str(k)]) if k is not None and str(k) in st else sd_of(total)
    betas, loss, converged = lg.fit_many(tr, feats, "_a", "fold", models, scales)
    rows = []
    for name, _ in PENALTIES:
        fl = [loss[f"{name}:{k}"] for k in range(n_folds) if loss.get(f"{name}:{k}", (0, 0))[1] > 0]
        ok = all(converged[f"{name}:{k}"] for k in [*range(n_folds), None])
        rows.append((name, float(np.mean([a / n for a, n in fl])) if fl else float("inf"), ok))
    # an unconverged penalty is chosen only if none converged; the table says so
    best = min(rows, key=lambda t: (not t[2], t[1]))[0]
    oof_p = None
    for k in range(n_folds):
        oof_p = F.when(F.col("fold") == k, lg.prob_col(betas[f"{best}:{k}"], feats)) if oof_p is None else \
            oof_p.when(F.col("fold") == k, lg.prob_col(betas[f"{best}:{k}"], feats))
    oof = tr.select("_row", clamp(oof_p, EPS, 1 - EPS).alias("e_hat"))
    te = test.select("_row", *imp)
    te_p = te.select("_row", clamp(lg.prob_col(betas[f"{best}:None"], feats), EPS, 1 - EPS).alias("e_hat"))
    spark = train.sparkSession
    loss_table = spark.createDataFrame(rows, "name string, mean_log_loss double, converged boolean")
    return oof, te_p, loss_table


def t_learner(events: DataFrame, cfg: EffectConfig = EffectConfig()):
    """Returns (per-event predictions of the test ids, one-row summary, bootstrap samples)."""
    spark = events.sparkSession
    # deterministic event key: a treated centre is a treated day and a control centre an
    # untreated one, so (id, centre_day) is unique in the event table; a recomputed
    # partition (executor loss) produces the same keys
    from cohortflow.session import written
    # many passes follow (tuning, cross-fit, IRLS, bootstrap): cut the lineage into the
    # shared checkpoint folder so a lost executor recomputes from here, not from raw events
    ev = written(events.select("*", F.struct("id", "centre_day").alias("_row")), "effect-events")
    feats = effect_feature_columns(ev, compat=cfg.compat)
    splits = rs.split_ids(ev, "id", cfg.test_size, None, cfg.seed)
    ev = ev.join(splits, "id")
    train = ev.where(F.col("split") == "train")
    test = ev.where(F.col("split") == "test")
    folds = rs.grouped_folds(train, cfg.n_folds, "id", cfg.seed)
    train = train.join(folds, "id").cache()
    med = lin.medians(train, feats)
    imp = lin.imputed(feats, med)
    grid = lin.linear_grid(cfg.model)
    # arm models tuned by grouped CV on each arm
    fits = {}
    for arm in (1, 0):
        part = train.where(F.col("A_star") == arm)
        cv, st = lin.cv_linear(part, feats, "Y_star", "fold", cfg.model, grid)
        best = lin.best_setting(mt.cv_summary(cv, ("param_id",)), grid, "r2")
        fits[arm] = (best, lin.fit_linear(st["total"], feats, st["medians"], cfg.model, **best))
    mu1, mu0 = fits[1][1].predict_col(), fits[0][1].predict_col()
    # cross-fitted outcomes: statistics per (fold, arm) in one pass
    keyed = train.select(F.concat_ws(":", F.col("fold").cast("string"), F.col("A_star").cast("string")).alias("_g"),
                         F.col("Y_star").cast("double").alias("y"), *imp)
    stats = lin.gram_stats(keyed, feats, "y", "_g")
    rows = []
    for k in range(cfg.n_folds):
        for arm in (1, 0):
            tot = None
            for key, g in stats.items():
                f, a = key.split(":")
                if int(f) != k and int(a) == arm:
                    tot = g if tot is None else tot + g
            if tot is None:
                continue
            fit = lin.fit_linear(tot, feats, med, cfg.model, **fits[arm][0])
            rows.append((k, arm, float(fit.raw_intercept), [float(c) for c in fit.raw_coef]))
    cf = spark.createDataFrame(rows, "fold int, arm int, b double, w array<double>")
    x = F.array(*[F.col(f"`{c}`") for c in feats])
    lin_pred = F.col("b") + F.aggregate(F.zip_with("w", x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    tr_imp = train.select("_row", "id", "fold", "A_star", "Y_star", *imp)
    cross = (tr_imp.join(F.broadcast(cf), "fold").select("_row", "arm", lin_pred.alias("mu"))
             .groupBy("_row").agg(F.max(F.when(F.col("arm") == 1, F.col("mu"))).alias("mu1_cf"),
                                  F.max(F.when(F.col("arm") == 0, F.col("mu"))).alias("mu0_cf")))
    e_oof, e_test, losses = propensity(train, test, feats, med, cfg.n_folds)
    dr = (tr_imp.join(cross, "_row").join(e_oof, "_row")
          .where(F.col("mu1_cf").isNotNull() & F.col("mu0_cf").isNotNull()))      # Q16: rows without both arms dropped
    a, y = F.col("A_star").cast("double"), F.col("Y_star")
    dr = dr.select("*", mt.dr_pseudo_outcome(a, y, F.col("e_hat"), F.col("mu1_cf"), F.col("mu0_cf")).alias("psi"))
    # effect regression: OLS of the pseudo-outcome on the features
    st_dr = lin.gram_stats(dr.select(F.col("psi").alias("y"), *[F.col(f"`{c}`") for c in feats]), feats, "y")
    te_fit = lin.fit_linear(st_dr["all"], feats, med, "ols")
    out = (test.join(e_test, "_row")
           .select(*[F.col(f"`{c}`") for c in test.columns if c not in ("_row", "split")], "e_hat",
                   mu1.alias("Yhat_treated"), mu0.alias("Yhat_control"), te_fit.predict_col().alias("tau_hat_dr")))
    out = out.select("*", (F.col("Yhat_treated") - F.col("Yhat_control")).alias("tau_hat"),
                     mt.observed_arm(F.col("A_star").cast("double"), F.col("Yhat_treated"), F.col("Yhat_control")).alias("Yhat_obs")).cache()
    ate = mt.average_effect(out, "tau_hat").first()
    ate_dr = mt.average_effect(out, "tau_hat_dr").first()
    fit_q = mt.regression_metrics(out, "Y_star", "Yhat_obs").first()
    samples = mt.cluster_bootstrap_mean(out, ("tau_hat", "tau_hat_dr"), "id", cfg.n_boot, cfg.seed).cache()
    ci = samples.agg(F.percentile("tau_hat_bs", F.array(F.lit(0.025), F.lit(0.975))).alias("a"),
                     F.percentile("tau_hat_dr_bs", F.array(F.lit(0.025), F.lit(0.975))).alias("d")).first()
    summary = spark.createDataFrame([(cfg.model, ate["ATE"], ate["ATE_weighted"], ci["a"][0], ci["a"][1],
                                      ate_dr["ATE"], ate_dr["ATE_weighted"], ci["d"][0], ci["d"][1], fit_q["R2"])],
                                    "model string, ATE double, ATE_weighted double, ATE_ci_low double, ATE_ci_high double, "
                                    "ATE_DR double, ATE_DR_weighted double, ATE_DR_ci_low double, ATE_DR_ci_high double, "
                                    "fit_overall_R2 double")
    return out, summary, samples.select(F.col("tau_hat_bs").alias("ATE_bs"), F.col("tau_hat_dr_bs").alias("ATE_DR_bs")), losses
