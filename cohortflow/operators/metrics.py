"""Evaluation aggregates.

All metrics are expressed as sufficient statistics (counts, sums, stable
variances) so Spark computes them with partial aggregation; bootstrap
replicates are formed from per-id statistics, never from copies of rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.scalar import clamp, normal_quantile
from cohortflow.operators.quantiles import exact_quantiles
from cohortflow.operators.resample import bootstrap_weights, bootstrap_weights_by, draw_lists, draw_matrix, replicate_rows, summed_replicates


def _valid(y: str, p: str) -> Column:
    return (F.col(y).isNotNull() & ~F.isnan(y) & F.col(p).isNotNull() & ~F.isnan(p))


def metric_aggs(y: str = "y_true", p: str = "y_pred", prefix: str = "") -> list[Column]:
    """MAE, RMSE, R2 (missing when fewer than 2 rows or no variance) and n (A2, Q9)."""
    ok = _valid(y, p)
    yy = F.when(ok, F.col(y))
    e = F.when(ok, F.col(y) - F.col(p))
    n = F.count(e)
    sst = F.var_pop(yy) * n
    r2 = F.when((n >= 2) & (sst > 0), F.lit(1.0) - F.sum(e * e) / sst)
    return [F.avg(F.abs(e)).alias(f"{prefix}MAE"), F.sqrt(F.avg(e * e)).alias(f"{prefix}RMSE"),
            r2.alias(f"{prefix}R2"), n.alias(f"{prefix}n")]


def regression_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    g = df.groupBy(*by) if by else df
    return g.agg(*metric_aggs(y, p))


def grouped_summary(pred: DataFrame, id_col: str = "id", day_col: str = "day") -> DataFrame:
    """Per patient and per day summaries in one pass with GROUPING SETS (A3, O3).

    Columns: by ('patient'/'day'), key, n, y_true_mean, y_pred_mean, mae, r2,
    y_pred_ci_low_mean, y_pred_ci_high_mean.
    """
    ok = _valid("y_true_abs", "y_pred_abs")
    e = F.when(ok, F.col("y_true_abs") - F.col("y_pred_abs"))
    yy = F.when(ok, F.col("y_true_abs"))
    n_ok = F.count(e)
    sst = F.var_pop(yy) * n_ok
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg("y_true_abs").alias("y_true_mean"), F.avg("y_pred_abs").alias("y_pred_mean"),
        F.avg(F.abs(e)).alias("mae"),
        F.when((n_ok >= 2) & (sst > 0), F.lit(1.0) - F.sum(e * e) / sst).alias("r2"),
        F.avg("y_pred_abs_ci_low").alias("y_pred_ci_low_mean"), F.avg("y_pred_abs_ci_high").alias("y_pred_ci_high_mean"),
        F.grouping_id().alias("_gid"),
    ]
    g = pred.groupingSets([[id_col], [day_col]], id_col, day_col).agg(*aggs)
    out = g.select(
        F.when(F.col("_gid") == 1, F.lit("patient")).otherwise(F.lit("day")).alias("by"),
        F.when(F.col("_gid") == 1, F.col(id_col)).otherwise(F.col(day_col)).cast("bigint").alias("key"),
        *[c for c in ("n", "y_true_mean", "y_pred_mean", "mae", "r2", "y_pred_ci_low_mean", "y_pred_ci_high_mean")],
    )
    return out.orderBy("by", F.desc("n"), "key")


def calibration_edges(pred: DataFrame, p: str = "y_pred", y: str = "y_true", n_bins: int = 10) -> list[float]:
    """Unique quantile edges of the predictions; equal width when fewer than 3 (A5, U4)."""
    d = pred.where(_valid(y, p))
    qs = exact_quantiles(d, p, list(np.linspace(0, 1, n_bins + 1)))
    if qs[0] is None:
        return []
    edges = list(np.unique(np.array(qs, dtype=float)))
    if len(edges) < 3:
        st = d.agg(F.min(p), F.max(p), F.count(F.lit(1))).first()
        k = min(n_bins, max(2, st[2] // 5))
        edges = list(np.linspace(st[0], st[1], k + 1))
    return edges


def calibration_bins(pred: DataFrame, p: str = "y_pred", y: str = "y_true", n_bins: int = 10,
                     edges: list[float] | None = None) -> DataFrame:
    """Per bin: count, mean/std of prediction and truth, min/max prediction (A5).

    bin = number of inner edges <= prediction (``numpy.digitize``, right=False).
    """
    from pyspark import StorageLevel
    d = pred.select(F.col(p).cast("double").alias(p), F.col(y).cast("double").alias(y)).where(_valid(y, p))
    d = d.persist(StorageLevel.MEMORY_AND_DISK)      # read by the edge pass and the bin pass
    edges = calibration_edges(d, p, y, n_bins) if edges is None else edges
    inner = edges[1:-1]
    b = sum(((F.col(p) >= F.lit(float(e))).cast("int") for e in inner), F.lit(0)) if inner else F.lit(0)
    out = (d.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("y_pred_mean"), F.avg(y).alias("y_true_mean"),
        F.stddev_samp(p).alias("y_pred_std"), F.stddev_samp(y).alias("y_true_std"),
        F.min(p).alias("y_pred_min"), F.max(p).alias("y_pred_max")).orderBy("bin"))
    out = d.sparkSession.createDataFrame(out.collect(), out.schema)    # at most n_bins rows
    d.unpersist()
    return out


def calibration_line(pred: DataFrame, p: str = "y_pred", y: str = "y_true") -> DataFrame:
    """n, intercept, slope (least squares of truth on prediction), MAE, RMSE, corr."""
    d = pred.where(_valid(y, p))
    e = F.col(y) - F.col(p)
    return d.agg(F.count(F.lit(1)).alias("n"), F.regr_intercept(y, p).alias("intercept"), F.regr_slope(y, p).alias("slope"),
                 F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"), F.corr(p, y).alias("corr"))


def normal_interval(mean: Column, sd: Column, n: Column, level: float = 0.95, prefix: str = "") -> list[Column]:
    """``mean +- z*sd/sqrt(n)``, missing when n <= 1 (A7; z = 1.96 at 0.95)."""
    z = F.lit(normal_quantile(level))
    half = F.when((n > 1) & sd.isNotNull() & ~F.isnan(sd), z * sd / F.sqrt(n.cast("double")))
    return [(mean - half).alias(f"{prefix}ci_low"), (mean + half).alias(f"{prefix}ci_high"), half.alias(f"{prefix}ci_half_width")]


def per_id_stats(pred: DataFrame, id_col: str = "id", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Sufficient statistics of one id: n, sum y, sum y^2, sum e^2, sum |e| (valid rows)."""
    ok = _valid(y, p)
    e = F.when(ok, F.col(y) - F.col(p))
    yy = F.when(ok, F.col(y))
    return pred.groupBy(id_col).agg(
        F.count(e).alias("n"), F.coalesce(F.sum(yy), F.lit(0.0)).alias("sy"),
        F.coalesce(F.sum(yy * yy), F.lit(0.0)).alias("syy"), F.coalesce(F.sum(e * e), F.lit(0.0)).alias("see"),
        F.coalesce(F.sum(F.abs(e)), F.lit(0.0)).alias("sae"))


def bootstrap_metric_ci(pred: DataFrame, id_col: str = "id", y: str = "y_true", p: str = "y_pred",
                        n_boot: int = 200, seed: int = 42, alpha: float = 0.05, mode: str = "membership") -> DataFrame:
    """Percentile interval of R2 and MAE over id resamples.

    Cost is B x ids (per-id statistics times draw weights), not B x rows.  The
    default ``membership`` mode counts each drawn id once, as the reference does.
    """
    from pyspark import StorageLevel
    st = per_id_stats(pred, id_col, y, p).persist(StorageLevel.MEMORY_AND_DISK)   # one row per id
    w = bootstrap_weights(st, n_boot, id_col, seed, mode=mode)
    j = w.join(st, id_col)
    agg = j.groupBy("b").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("n", "sy", "syy", "see", "sae")])
    n = F.col("n").cast("double")
    sst = F.col("syy") - F.col("sy") * F.col("sy") / n
    per_b = agg.select("b", F.when((n >= 2) & (sst > 0), F.lit(1.0) - F.col("see") / sst).alias("r2"),
                       F.when(n > 0, F.col("sae") / n).alias("mae"))
    a = alpha / 2.0
    qs = F.array(F.lit(a), F.lit(1.0 - a))
    out = per_b.agg(F.percentile("r2", qs).alias("r2q"), F.percentile("mae", qs).alias("maeq"))
    out = out.sparkSession.createDataFrame(out.collect(), out.schema)   # one row
    st.unpersist()
    return out.select(F.col("r2q")[0].alias("Y_R2_ci_low"), F.col("r2q")[1].alias("Y_R2_ci_high"),
                      F.col("maeq")[0].alias("Y_MAE_ci_low"), F.col("maeq")[1].alias("Y_MAE_ci_high"),
                      F.lit(int(n_boot)).alias("n_boot"))


def bootstrap_metric_ci_grouped(pred: DataFrame, group_cols, id_col: str = "id", y: str = "y_true", p: str = "y_pred",
                                n_boot: int = 200, seed: int = 42, alpha: float = 0.05, mode: str = "membership") -> DataFrame:
    """A8 for many prediction sets at once, e.g. per (target, model, h).

    One draw table over the ids of the whole table is shared by every group.  The statistics of all
    groups of an id meet its draws in one row, and a task adds them up for all replicates and groups by
    matrix products: the work is B x groups x ids, the rows are only ids.
    """
    from pyspark import StorageLevel
    ok = _valid(y, p)
    e = F.when(ok, F.col(y) - F.col(p))
    yy = F.when(ok, F.col(y))
    sums = ("n", "sy", "syy", "see", "sae")
    st = pred.groupBy(*group_cols, id_col).agg(
        F.count(e).cast("double").alias("n"), F.coalesce(F.sum(yy), F.lit(0.0)).alias("sy"),
        F.coalesce(F.sum(yy * yy), F.lit(0.0)).alias("syy"), F.coalesce(F.sum(e * e), F.lit(0.0)).alias("see"),
        F.coalesce(F.sum(F.abs(e)), F.lit(0.0)).alias("sae")).persist(StorageLevel.MEMORY_AND_DISK)
    spark, names = st.sparkSession, st.select(*group_cols).distinct()
    names = [(*r, i) for i, r in enumerate(names.collect())]                          # one row per group, as in the result
    groups = F.broadcast(spark.createDataFrame(names, ", ".join([f"`_k{i}` {st.schema[c].dataType.simpleString()}" for i, c in enumerate(group_cols)] + ["_g int"])))
    keyed = st.join(groups, functools.reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group_cols)], F.lit(True)))
    per_id = keyed.groupBy(id_col).agg(F.collect_list(F.struct("_g", *sums)).alias("_stats"))        # at most one entry per group
    w = bootstrap_weights(st.select(id_col).distinct(), n_boot, id_col, seed, mode=mode)
    both = per_id.join(draw_lists(w, id_col), id_col).select("_stats", "_draws")
    B, width = int(n_boot), len(names) * len(sums)
    block = max(1, min(512, 2_000_000 // max(B, width, 1)))

    def fold(batches):
        acc = np.zeros((B, width))
        for batch in batches:
            lists = batch.column("_stats")
            for at in range(0, batch.num_rows, block):
                rows = np.arange(at, min(at + block, batch.num_rows))
                part = lists.slice(at, len(rows))
                row = np.repeat(np.arange(len(rows)), part.value_lengths().to_numpy(zero_copy_only=False))
                got = part.flatten()
                s = np.zeros((len(rows), len(names), len(sums)))
                g = got.field("_g").to_numpy()
                for i, c in enumerate(sums):
                    s[row, g, i] = got.field(c).to_numpy()
                acc += draw_matrix(batch.column("_draws"), rows, B).T @ s.reshape(len(rows), width)
        yield replicate_rows(acc)

    def opened(batches):
        for batch in batches:
            b = batch.column("b").to_numpy()
            v = np.frombuffer(b"".join(batch.column("v").to_pylist())).reshape(-1, len(sums))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b, len(names))), pa.array(np.tile(np.arange(len(names), dtype=np.int32), len(b))),
                                              *[pa.array(np.ascontiguousarray(v[:, i])) for i in range(len(sums))]], ["b", "_g", *sums])

    agg = summed_replicates(both.mapInArrow(fold, "b int, v binary")).mapInArrow(opened, "b int, _g int, " + ", ".join(f"{c} double" for c in sums))
    agg = agg.join(groups, "_g").select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(group_cols)], "b", *sums)
    n = F.col("n")
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.nullif(n, F.lit(0.0))
    per_b = agg.select(*group_cols, "b", F.when((n >= 2) & (sst > 0), F.lit(1.0) - F.col("see") / sst).alias("r2"),
                       F.when(n > 0, F.col("sae") / n).alias("mae"))
    a = alpha / 2.0
    qs = F.array(F.lit(a), F.lit(1.0 - a))
    out = per_b.groupBy(*group_cols).agg(F.percentile("r2", qs).alias("r2q"), F.percentile("mae", qs).alias("maeq"))
    out = out.select(*group_cols, F.col("r2q")[0].alias("R2_ci_low"), F.col("r2q")[1].alias("R2_ci_high"),
                     F.col("maeq")[0].alias("MAE_ci_low"), F.col("maeq")[1].alias("MAE_ci_high"),
                     F.lit(int(n_boot)).alias("n_boot"))
    out = spark.createDataFrame(out.collect(), out.schema)     # one row per group
    st.unpersist()
    return out


def cluster_bootstrap_mean(df: DataFrame, cols=("tau_hat", "tau_hat_dr"), id_col: str = "id", n_boot: int = 300,
                           seed: int = 42) -> DataFrame:
    """Replicate means of effect columns over id resamples with multiplicity.

    Returns the sample table (b, <col>_bs ...); per id only (n, sums) meet the draws.
    """
    sums = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols]).cache()
    w = bootstrap_weights(sums, n_boot, id_col, seed, mode="weighted")
    j = w.join(sums, id_col).groupBy("b").agg(
        F.sum(F.col("weight") * F.col("n")).alias("n"),
        *[F.sum(F.col("weight") * F.col(f"s_{c}")).alias(f"s_{c}") for c in cols])
    return j.select("b", *[(F.col(f"s_{c}") / F.col("n").cast("double")).alias(f"{c}_bs") for c in cols])


def cluster_bootstrap_effect_width(events: DataFrame, by: str, y: str = "Y_star", arm: str = "A_star", id_col: str = "id",
                                   n_boot: int = 300, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(by, width): width of the bootstrap interval of the difference of arm means, for every group.

    Ids are drawn within each group; per id only counts and sums of either arm meet the draws.
    """
    t = F.col(arm) == 1
    st = events.groupBy(by, id_col).agg(F.count(F.when(t, 1)).alias("n1"), F.coalesce(F.sum(F.when(t, F.col(y))), F.lit(0.0)).alias("s1"),
                                        F.count(F.when(~t, 1)).alias("n0"), F.coalesce(F.sum(F.when(~t, F.col(y))), F.lit(0.0)).alias("s0"))
    st = st.persist()                                   # one row per (group, id)
    sums = bootstrap_weights_by(st, by, n_boot, id_col, seed).join(st, [by, id_col]).groupBy(by, "b").agg(
        *[F.sum(F.col("weight") * F.col(c)).cast("double").alias(c) for c in ("n1", "s1", "n0", "s0")])
    effect = F.col("s1") / F.nullif(F.col("n1"), F.lit(0.0)) - F.col("s0") / F.nullif(F.col("n0"), F.lit(0.0))
    q = sums.groupBy(by).agg(F.percentile(effect, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    out = q.select(by, (F.col("q")[1] - F.col("q")[0]).alias("width"))
    out = out.sparkSession.createDataFrame(out.collect(), out.schema)                  # one row per group
    st.unpersist()
    return out


def effect_report(pred: DataFrame, effects: dict[str, str], id_col: str = "id", n_boot: int = 300, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """One row per effect column of stored predictions (M25): mean and id-weighted mean (A10), interval of
    the id-cluster bootstrap (A9), numbers of events and ids.  ``effects``: name -> column."""
    cols = list(effects.values())
    per_id = pred.groupBy(id_col).agg(F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(f"s_{c}") for c in cols])
    whole = per_id.agg(F.sum("k").alias("n_events"), F.count(F.lit(1)).alias("n_ids"),
                       *[(F.sum(f"s_{c}") / F.sum("k")).alias(f"m_{c}") for c in cols],
                       *[(F.sum(F.col(f"s_{c}") / F.col("k")) / F.count(F.lit(1))).alias(f"w_{c}") for c in cols]).first()
    probs = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    draws = cluster_bootstrap_mean(pred, tuple(cols), id_col, n_boot, seed).agg(*[F.percentile(f"{c}_bs", probs).alias(c) for c in cols]).first()
    rows = [(name, whole[f"m_{c}"], whole[f"w_{c}"], *(draws[c] or (None, None)), whole["n_events"], whole["n_ids"]) for name, c in effects.items()]
    return pred.sparkSession.createDataFrame(rows, "effect string, ATE double, ATE_weighted double, ATE_ci_low double, ATE_ci_high double, n_events long, n_ids long")


def effect_summary_by_id(df: DataFrame, id_col: str = "id", y: str = "Y_star", yhat: str = "Yhat_obs",
                         tau: str = "tau_hat", tau_dr: str = "tau_hat_dr") -> DataFrame:
    """Per id: n, MAE, RMSE, R2 of the observed-arm fit, mean tau and mean DR tau (A4)."""
    e = F.col(y) - F.col(yhat)
    n = F.count(F.lit(1))
    sst = F.var_pop(y) * n
    return df.groupBy(id_col).agg(n.alias("n"), F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"),
                                  F.when((n >= 2) & (sst > 0), F.lit(1.0) - F.sum(e * e) / sst).alias("R2"),
                                  F.avg(tau).alias("tau_mean"), F.avg(tau_dr).alias("tau_dr_mean"))


def sample_interval(samples: DataFrame, col: str, alpha: float = 0.05) -> DataFrame:
    """ci_low, ci_high, width = q(1-a/2) - q(a/2) of a bootstrap sample column."""
    a = alpha / 2.0
    q = samples.agg(F.percentile(F.col(col), F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    return q.select(F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), (F.col("q")[1] - F.col("q")[0]).alias("width"))


def average_effect(df: DataFrame, tau: str = "tau_hat", id_col: str = "id") -> DataFrame:
    """Plain mean and id-weighted mean (w = 1/events of the id) of an effect column (A10)."""
    per_id = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("k"), F.sum(tau).alias("s"))
    # sum(tau*w)/sum(w) with w = 1/k per row equals sum_i(s_i/k_i) / (number of ids)
    return per_id.agg((F.sum("s") / F.sum("k")).alias("ATE"),
                      (F.sum(F.col("s") / F.col("k")) / F.count(F.lit(1))).alias("ATE_weighted"))


def log_loss(df: DataFrame, a: str = "A_star", p: str = "e_hat", eps: float = 1e-3) -> DataFrame:
    """Binary log loss after clamping the probability."""
    pc = clamp(F.col(p), eps, 1 - eps)
    return df.agg((-F.avg(F.col(a) * F.log(pc) + (F.lit(1) - F.col(a)) * F.log(F.lit(1.0) - pc))).alias("log_loss"))


def dr_pseudo_outcome(a: Column, y: Column, e: Column, mu1: Column, mu0: Column) -> Column:
    """``a/e (y-mu1) - (1-a)/(1-e) (y-mu0) + mu1 - mu0``."""
    return a / e * (y - mu1) - (F.lit(1) - a) / (F.lit(1) - e) * (y - mu0) + mu1 - mu0


def observed_arm(a: Column, mu1: Column, mu0: Column) -> Column:
    """``a*mu1 + (1-a)*mu0``."""
    return a * mu1 + (F.lit(1) - a) * mu0


def cv_summary(cv: DataFrame, setting_cols=("param_id",)) -> DataFrame:
    """Per setting: mean/sd (population, as the CV library) of fold MAE and R2, and
    ranks (1 = best: lowest MAE, highest R2) (A28, W22).  The table has a row per
    (setting, fold): ranking it in one partition is bounded by the grid size."""
    g = cv.groupBy(*setting_cols).agg(
        F.avg("mae").alias("mean_test_mae"), F.stddev_pop("mae").alias("std_test_mae"),
        F.avg("r2").alias("mean_test_r2"), F.stddev_pop("r2").alias("std_test_r2"), F.count(F.lit(1)).alias("n_folds"))
    return g.select("*",
                    F.rank().over(Window.orderBy(F.asc("mean_test_mae"))).alias("rank_test_mae"),
                    F.rank().over(Window.orderBy(F.desc("mean_test_r2"))).alias("rank_test_r2"))


def horizon_confidence(support: DataFrame, widths: DataFrame, min_g: int = 10, min_g_eff: float = 8.0,
                       width_factor: float = 2.0) -> DataFrame:
    """Low confidence when G < 10, G_eff < 8, or width > 2 x width at the first horizon.

    ``support`` (h, G, G_eff) and ``widths`` (h, width) have one row per horizon.
    """
    j = support.join(widths, "h", "left")
    first = j.agg(F.min_by(F.struct("width"), "h").alias("first")).first()["first"]        # one scalar: the width at the first horizon
    ref = F.lit(first["width"] if first is not None else None).cast("double")
    low = ((F.col("G") < min_g) | (F.col("G_eff") < min_g_eff)
           | (F.col("width").isNotNull() & ref.isNotNull() & (F.col("width") > F.lit(width_factor) * ref)))
    return j.select("*", ref.alias("width_ref"), low.alias("low_confidence")).orderBy("h")
