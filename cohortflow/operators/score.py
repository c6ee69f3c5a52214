"""Composite scores of a diary.

``S_t`` is the mean of the symptom items that are present and non-zero,
``W_t`` the clamped wellbeing, and ``U_t = 10 * w^alpha * q^beta`` with
``w = W_t/10`` and ``q = 1 - S_t/10``.  One projection, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.scalar import clamp, row_mean, to_num, zero_as_null

SCORE_COLUMNS = ("W_t", "S_t", "U_t", "w_t", "q_t", "wq", "w_t2", "q_t2")


def symptom_mean(items: list[str]):
    """Mean of the non-zero, non-null items (P3 + P4)."""
    if not items:
        raise ValueError("no symptom items present and the precomputed score is not used")
    return row_mean([zero_as_null(to_num(F.col(f"`{c}`"))) for c in items])   # NaN -> NULL first


def score(df: DataFrame, items: list[str] | None = None, alpha: float = 1.0, beta: float = 1.0,
          use_precomputed_s: bool = False, wellbeing_col: str = "overall_wellbeing") -> DataFrame:
    """Append W_t, S_t, U_t, w_t, q_t, wq, w_t2, q_t2 to a canonical diary."""
    if use_precomputed_s and "mean_symptom_score_active" in df.columns:
        s_raw = to_num(F.col("mean_symptom_score_active"))
    else:
        if items is None:
            from cohortflow.sources.resolve import SYMPTOM_ITEMS
            items = [c for c in SYMPTOM_ITEMS if c in df.columns]
        s_raw = symptom_mean(items)
    W = clamp(to_num(F.col(wellbeing_col)), 0.0, 10.0)
    S = clamp(s_raw, 0.0, 10.0)
    base = df.select("*", W.alias("W_t"), S.alias("S_t"))
    w = F.col("W_t") / F.lit(10.0)
    q = F.lit(1.0) - F.col("S_t") / F.lit(10.0)
    U = F.lit(10.0) * F.pow(w, F.lit(float(alpha))) * F.pow(q, F.lit(float(beta)))
    return base.select(
        "*",
        F.when(~F.isnan(U), U).alias("U_t"),
        w.alias("w_t"),
        q.alias("q_t"),
        (w * q).alias("wq"),
        F.pow(w, F.lit(2.0)).alias("w_t2"),
        F.pow(q, F.lit(2.0)).alias("q_t2"),
    )
