"""Model fitting and scoring on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.scalar import clamp


def shrinkage_cv(pred: DataFrame, folds: DataFrame, lambdas, id_col: str = "id") -> DataFrame:
    """Fold metrics of a one-parameter family ``lam*base + (1-lam)*pred`` (a grid search
    whose settings are a small config): one pass, settings exploded per row."""
    grid = F.explode(F.array(*[F.lit(float(x)) for x in lambdas])).alias("lam")
    sc = pred.join(folds, id_col).select("fold", "y_true_abs", "base_t", "y_pred_abs", grid)
    yh = clamp(F.col("lam") * F.col("base_t") + (F.lit(1.0) - F.col("lam")) * F.col("y_pred_abs"))
    sc = sc.select("lam", "fold", F.col("y_true_abs").alias("y"), yh.alias("yh"))
    e = F.col("y") - F.col("yh")
    n = F.count(F.lit(1))
    sst = F.var_pop("y") * n
    return sc.groupBy("lam", "fold").agg(F.avg(F.abs(e)).alias("mae"),
                                         F.when((n >= 2) & (sst > 0), F.lit(1.0) - F.sum(e * e) / sst).alias("r2"))
