"""Entry B: horizon sweep of a linear forecaster (M11) with id-disjoint evaluation.

Every horizon has its own usable rows (label and base present), its own split of the ids usable
there and its own medians; tuning happens at the first horizon and the setting is reused (Q14).
Rows stay wide: which horizons a row trains or tests is a bit mask, so the medians of all
horizons share the counting passes, one pass accumulates the statistics of all training sets,
and one pass scores the test rows of all horizons.  Only test predictions are in long form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.scalar import clamp, scrub_nonfinite
from cohortflow.operators import linear as lin
from cohortflow.operators import metrics as mt
from cohortflow.operators import resample as rs
from cohortflow.operators.quantiles import RowSet, column_quantiles
from cohortflow.plans.features import feature_columns


@dataclass(frozen=True)
class SweepConfig:
    target: str = "U"           # U, W or S
    model: str = "ridge"        # ridge, lasso, elasticnet, ols
    horizons: int = 14          # at most 60: a row's horizons are bits of a BIGINT
    use_delta: bool = True
    min_rows: int = 200
    seed: int = 42
    test_size: float = 0.15
    val_size: float = 0.15
    n_folds: int = 5
    features: tuple[str, ...] | None = None     # default: all numeric columns without leaks
    params: tuple[tuple[str, float], ...] | None = None     # a fixed setting instead of tuning


def _bits(flags) -> "F.Column":
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(flags)), F.lit(0).cast("bigint"))


def _wide(features: DataFrame, cfg: SweepConfig, feats: list[str]) -> DataFrame:
    """id, day, base, label arrays, features, and the bit masks ``usable``, ``test`` and ``learn`` over horizons."""
    p, hs = cfg.target, range(1, cfg.horizons + 1)
    y = [F.col(f"{'d' if cfg.use_delta else ''}{p}_next_h{h}").cast("double") for h in hs]
    base = F.col(f"{p}_t").cast("double")
    d = features.select("id", "day", base.alias("_base"), F.array(*y).alias("_y"), F.array(*[F.col(f"{p}_next_h{h}").cast("double") for h in hs]).alias("_abs"),
                        _bits([c.isNotNull() & base.isNotNull() for c in y]).alias("usable"),
                        *[scrub_nonfinite(F.col(f"`{c}`").cast("double")).alias(c) for c in feats])
    per_id = d.groupBy("id").agg(F.bit_or("usable").alias("bits"))
    long = per_id.select("id", F.explode(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << (h - 1))) != 0, F.lit(h)) for h in hs])).alias("h")).where(F.col("h").isNotNull())
    split = rs.split_ids_by(long, "h", "id", cfg.test_size, cfg.val_size, cfg.seed)
    one = F.expr("shiftleft(CAST(1 AS BIGINT), h - 1)")
    tests = split.groupBy("id").agg(F.bit_or(F.when(F.col("split") == "test", one).otherwise(F.lit(0).cast("bigint"))).alias("id_test"))
    d = d.join(tests, "id")
    return d.select("*", F.col("usable").bitwiseAND(F.col("id_test")).alias("test"), F.col("usable").bitwiseAND(F.bitwise_not("id_test")).alias("learn")).drop("id_test")


def horizon_sweep(features: DataFrame, cfg: SweepConfig = SweepConfig()):
    """Returns (summary per h, predictions of the test ids, CV table at h=1)."""
    spark = features.sparkSession
    hs = list(range(1, cfg.horizons + 1))
    feats = list(cfg.features) if cfg.features else feature_columns(features, f"{'d' if cfg.use_delta else ''}{cfg.target}_next_h1")
    data = _wide(features, cfg, feats).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = data.agg(*[F.sum(F.expr(f"CAST((usable >> {h - 1}) & 1 AS BIGINT)")).alias(f"n{h}") for h in hs]).first()
        hs = [h for h in hs if (n[f"n{h}"] or 0) >= cfg.min_rows]                     # P15
        best, cvs = dict(cfg.params or ()), None
        if cfg.params is None and hs:
            first = data.where(F.expr("(learn & 1) = 1")).select("id", F.col("_y")[0].alias("y"), *[F.col(f"`{c}`") for c in feats])
            first = first.join(rs.grouped_folds(first, cfg.n_folds, "id", cfg.seed), "id")
            cvs = mt.cv_summary(lin.cv_linear(first, feats, "y", "fold", cfg.model)[0], ("param_id",))
            best = lin.best_setting(cvs, lin.linear_grid(cfg.model), "r2")
        sets = tuple(RowSet(bit=h - 1) for h in hs)
        got = column_quantiles(data, feats, [0.5], "learn", sets) if hs else {}
        med = {h: {f: float(got[(s, f)][0] or 0.0) for f in feats} for h, s in zip(hs, sets)}
        grams = _grams(data, feats, med)
        fits = {h: lin.fit_linear(grams[h], feats, med[h], cfg.model, **best) for h in hs if h in grams}
        predictions = _predictions(data, feats, fits, cfg)
        summary = predictions.groupBy("target", "model", "h").agg(*mt.metric_aggs("y_true_abs", "y_pred_abs"), *mt.metric_aggs("y_true_abs", "y_naive_abs", prefix="Naive_"))
        summary = spark.createDataFrame(summary.collect(), summary.schema)            # one row per horizon
    finally:
        data.unpersist()
    return summary.select("*", F.lit(str(best)).alias("params")), predictions, cvs


def _grams(data: DataFrame, feats: list[str], med: dict) -> dict:
    """Gram statistics of every horizon's training rows, imputed with its medians, in one pass."""
    hs, m = list(med), len(feats) + 1
    fill = {h: np.array([med[h][f] for f in feats]) for h in hs}

    def fold(batches):
        acc = np.zeros((len(hs), m * m + m + 1))
        for pdf in batches:
            if pdf.empty:
                continue
            x, y, learn = pdf[feats].to_numpy(dtype=float), np.stack(pdf["_y"].to_numpy()).astype(float), pdf["learn"].to_numpy()
            for i, h in enumerate(hs):
                use = (learn >> (h - 1)) & 1 == 1
                z = np.ones((int(use.sum()), m))
                z[:, :-1] = np.where(np.isnan(x[use]), fill[h], x[use])
                t = y[use, h - 1]
                acc[i] += np.concatenate([(z.T @ z).ravel(), z.T @ t, [t @ t]])
        yield pd.DataFrame({"i": np.repeat(np.arange(len(hs), dtype=np.int32), acc.shape[1]), "pos": np.tile(np.arange(acc.shape[1], dtype=np.int32), len(hs)), "v": acc.ravel()})

    if not hs:
        return {}
    parts = data.select("learn", "_y", *feats).mapInPandas(fold, "i int, pos int, v double").groupBy("i", "pos").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for i, part in parts.groupby("i"):
        vec = np.zeros(m * m + m + 1)
        vec[part["pos"].to_numpy()] = part["v"].to_numpy()
        out[hs[int(i)]] = lin.Gram(vec[:m * m].reshape(m, m), vec[m * m:m * m + m], float(vec[-1]))
    return out


def _predictions(data: DataFrame, feats: list[str], fits: dict, cfg: SweepConfig) -> DataFrame:
    """Long test predictions of all horizons: every wide row is scored once, by one matrix product per horizon."""
    coef = {h: (f.raw_coef, f.raw_intercept, np.array([f.medians[c] for c in feats])) for h, f in fits.items()}
    cols = ["h", "id", "day", "y_true_abs", "yhat", "base_t"]
    kinds = {f.name: f.dataType.simpleString() for f in data.schema}

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x, y, test = pdf[feats].to_numpy(dtype=float), np.stack(pdf["_abs"].to_numpy()).astype(float), pdf["test"].to_numpy()
            for h, (w, b, fill) in coef.items():
                use = (test >> (h - 1)) & 1 == 1
                if use.any():
                    yield pd.DataFrame({"h": np.int32(h), "id": pdf["id"][use], "day": pdf["day"][use], "y_true_abs": y[use, h - 1],
                                        "yhat": np.where(np.isnan(x[use]), fill, x[use]) @ w + b, "base_t": pdf["_base"][use]})[cols]

    long = data.where("test != 0").select("id", "day", "_base", "_abs", "test", *feats).mapInPandas(
        run, f"h int, id {kinds['id']}, day {kinds['day']}, y_true_abs double, yhat double, base_t double")
    y_abs = clamp(F.col("base_t") + F.col("yhat")) if cfg.use_delta else clamp(F.col("yhat"))   # P17
    return long.select(F.lit(cfg.target).alias("target"), F.lit(cfg.model).alias("model"), "h", "id", "day", "y_true_abs", y_abs.alias("y_pred_abs"),
                       clamp(F.col("base_t")).alias("y_naive_abs"), "base_t")
