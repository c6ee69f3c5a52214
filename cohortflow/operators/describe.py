"""Descriptive tables behind the reference's plots.

Charts are not drawn; each function returns the table a chart would show.
Global scalars (min, max, sd, counts) come from one small aggregate each and are
inlined as literals, so no table is cross joined with a one-row statistics table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.scalar import scrub_nonfinite
from cohortflow.operators.quantiles import RowSet, column_quantiles


def mean_of_id_means_by_day(df: DataFrame, day_col: str = "days_since_start", id_col: str = "id",
                            cols=("S_t", "W_t", "U_t")) -> DataFrame:
    """Mean per (day, id) first, then mean over ids per day (A17): two partial aggregations."""
    g = df.groupBy(day_col, id_col).agg(*[F.avg(c).alias(c) for c in cols])
    return g.groupBy(day_col).agg(*[F.avg(c).alias(c) for c in cols]).orderBy(day_col)


def within_person_sd(df: DataFrame, col: str = "U_t", id_col: str = "id") -> DataFrame:
    """Sample sd of ``col`` per id, ids without a value dropped."""
    return df.groupBy(id_col).agg(F.stddev_samp(col).alias("sd")).where(F.col("sd").isNotNull())


def histogram(df: DataFrame, col: str, bins: int = 25) -> DataFrame:
    """Equal-width histogram between min and max, last bin closed.

    Returns (bin, bin_lo, bin_hi, count) for bins that hold values.
    """
    st = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if st["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, count long")
    lo, hi = float(st["lo"]), float(st["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    x = F.col(col).cast("double")
    idx = F.least(F.lit(bins - 1), F.floor((x - F.lit(lo)) * F.lit(bins / (hi - lo) if hi > lo else 0.0)).cast("int"))
    out = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "count").orderBy("bin")


def distinct_days_per_id(df: DataFrame, id_col: str = "id", day_col: str = "day") -> DataFrame:
    """Number of distinct days per id, most first."""
    return (df.where(F.col(id_col).isNotNull() & F.col(day_col).isNotNull())
            .groupBy(id_col).agg(F.countDistinct(day_col).alias("n_days"))
            .orderBy(F.desc("n_days"), id_col))


def presence_pivot(df: DataFrame, id_col: str = "id", day_col: str = "day") -> DataFrame:
    """id x day 0/1 matrix (A21).  The day list is read first (bounded by the calendar
    span) and passed to ``pivot`` so Spark does not run a separate discovery job."""
    days = [r[0] for r in df.where(F.col(day_col).isNotNull()).select(F.col(day_col).cast("int")).distinct().orderBy(day_col).collect()]
    base = df.where(F.col(id_col).isNotNull() & F.col(day_col).isNotNull()).select(id_col, F.col(day_col).cast("int").alias(day_col))
    wide = base.groupBy(id_col).pivot(day_col, days).agg(F.max(F.lit(1)))
    return wide.na.fill(0, subset=[str(d) for d in days])


def abs_correlation(df: DataFrame, cols: list[str], flag_lo: float = 0.95) -> DataFrame:
    """Pairwise-complete absolute Pearson correlation in long form.

    One aggregate computes every pair (``corr`` skips rows with a NULL on either
    side); undefined correlations become 0; pairs with 0.95 < r < 1 are flagged.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    agg = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', c{k}" for k, (a, b) in enumerate(pairs))
    long = agg.selectExpr(f"stack({len(pairs)}, {stack}) as (col_a, col_b, r)")
    ar = F.coalesce(F.abs(F.col("r")), F.lit(0.0))
    return long.select("col_a", "col_b", ar.alias("abs_corr"), ((ar > flag_lo) & (ar < 1.0)).alias("near_duplicate"))


def correlation_block(df: DataFrame, cols: list[str], flag_lo: float = 0.95) -> DataFrame:
    """Pairwise-complete absolute correlations of many columns in one pass.

    Every task sums, over the rows in which both columns of a pair have a value, the products
    of the columns, their values and their squares as four matrix products a batch, and sends one
    row a pair; Spark adds them up.  Values are taken from the column's mean first, so no sum cancels.
    A row without any value adds to nothing; infinite values and NaN count as missing; a pair with
    fewer than two common rows or a column without spread in them gets 0; flags as in ``abs_correlation``.
    """
    clean = df.select(*[scrub_nonfinite(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    k = len(cols)
    upper, lower = np.triu_indices(k, 1)
    means = clean.agg(*[F.avg(f"c{i}") for i in range(k)]).first()
    centre = np.array([0.0 if m is None else m for m in means])

    def sums(frames):
        n, total, square, product = (np.zeros((k, k)) for _ in range(4))
        for pdf in frames:
            x = pdf.to_numpy(dtype=np.float64, na_value=np.nan)
            there = ~np.isnan(x)
            x, seen = np.where(there, x - centre, 0.0), there.astype(np.float64)
            n += seen.T @ seen
            total += x.T @ seen
            square += (x * x).T @ seen
            product += x.T @ x
        if n.any():
            yield pd.DataFrame({"a": upper, "b": lower, "n": n[upper, lower], "sx": total[upper, lower], "sy": total[lower, upper],
                                "sxx": square[upper, lower], "syy": square[lower, upper], "sxy": product[upper, lower]})

    parts = clean.mapInPandas(sums, "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double")
    every = df.sparkSession.createDataFrame([(int(a), int(b), cols[a], cols[b]) for a, b in zip(upper, lower)], "a int, b int, col_a string, col_b string")
    whole = every.join(parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]), ["a", "b"], "left")
    vx, vy = (F.col(q) - F.col(s) * F.col(s) / F.col("n") for q, s in (("sxx", "sx"), ("syy", "sy")))
    spread = (F.col("n") >= 2) & (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy"))
    r = F.when(spread, F.abs(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)).otherwise(0.0)
    long = whole.select("col_a", "col_b", F.round(F.least(r, F.lit(1.0)), 12).alias("abs_corr"))
    return long.select("*", ((F.col("abs_corr") > flag_lo) & (F.col("abs_corr") < 1.0)).alias("near_duplicate"))


def kde_grid(df: DataFrame, col: str, n_grid: int = 200, min_count: int = 10) -> DataFrame:
    """Gaussian kernel density on ``linspace(min, max, n_grid)`` with Scott's bandwidth
    ``h = sd * n^(-1/5)`` (A23).  Every value emits its contribution to every grid point and
    the sums are combined map-side: what is shuffled is ``n_grid`` rows a task.  Exact; no join."""
    x = F.col(col).cast("double")
    st = df.where(x.isNotNull() & ~F.isnan(x)).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("sd"),
                                                    F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    spark = df.sparkSession
    if st["n"] < min_count or not st["sd"]:
        return spark.createDataFrame([], "g int, x double, density double")
    n, lo, hi = int(st["n"]), float(st["lo"]), float(st["hi"])
    h = float(st["sd"]) * n ** (-0.2)
    step = (hi - lo) / (n_grid - 1)
    vals = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("v"), F.lit(1).alias("m"))       # no shuffle: the grid sum combines map-side
    g = F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("g")
    e = vals.select("v", "m", g)
    gx = F.when(F.col("g") == n_grid - 1, F.lit(hi)).otherwise(F.lit(lo) + F.col("g") * F.lit(step))
    z = (gx - F.col("v")) / F.lit(h)
    dens = e.groupBy("g").agg(F.sum(F.col("m") * F.exp(F.lit(-0.5) * z * z)).alias("s"))
    gx2 = F.when(F.col("g") == n_grid - 1, F.lit(hi)).otherwise(F.lit(lo) + F.col("g") * F.lit(step))
    return dens.select(F.col("g").cast("int").alias("g"), gx2.alias("x"),
                       (F.col("s") / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density")).orderBy("g")


def grouped_exact_quantiles(df: DataFrame, group_col: str, col: str, probs) -> DataFrame:
    """Exact per-group quantiles (numpy linear) for a small number of large groups.

    Returns (group, q, value); the groups with a value are read first, then all of them share
    the counting passes of ``quantiles.column_quantiles``.
    """
    groups = [r[0] for r in df.where(F.col(group_col).isNotNull() & F.col(col).isNotNull()).select(group_col).distinct().orderBy(group_col).collect()]
    got = column_quantiles(df, [col], list(probs), group_col, tuple(RowSet(g) for g in groups)) if groups else {}
    rows = [(g, float(q), v) for g in groups for q, v in zip(probs, got[(RowSet(g), col)]) if v is not None]
    gtype = df.schema[group_col].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"{group_col} {gtype}, q double, value double")


def box_stats(df: DataFrame, group_col: str = "dow", col: str = "U_t") -> DataFrame:
    """Quartiles, min and max per category."""
    q = grouped_exact_quantiles(df, group_col, col, [0.25, 0.5, 0.75])
    wide = q.groupBy(group_col).pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value"))
    wide = wide.select(group_col, F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("median"), F.col("`0.75`").alias("q3"))
    mm = df.groupBy(group_col).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("n"))
    return wide.join(mm, group_col).orderBy(group_col)


def regression_line(df: DataFrame, x: str = "S_t", y: str = "W_t") -> DataFrame:
    """Least-squares line of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def leaderboard(summary: DataFrame, metric: str = "MAE", model_col: str = "model") -> DataFrame:
    """Mean metric per model over horizons, ranked (A26).  One row per model."""
    g = summary.groupBy(model_col).agg(F.avg(metric).alias(f"mean_{metric}"), F.count(F.lit(1)).alias("n_h"))
    return g.select("*", F.rank().over(Window.orderBy(F.asc(f"mean_{metric}"))).alias("rank"))


def best_epoch(log: DataFrame, epoch: str = "epoch", loss: str = "train_loss") -> DataFrame:
    """Arg-min of the training loss."""
    return log.agg(F.min_by(epoch, loss).alias("best_epoch"), F.min(loss).alias("best_loss"))


def minmax_scale(df: DataFrame, col: str, out: str | None = None, eps: float = 1e-8) -> DataFrame:
    """``(x - min) / (max - min + 1e-8)`` with min/max read once."""
    st = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    if lo is None:
        return df.select("*", F.lit(None).cast("double").alias(out or f"{col}_scaled"))
    return df.select("*", ((F.col(col) - F.lit(float(lo))) / F.lit(float(hi) - float(lo) + eps)).alias(out or f"{col}_scaled"))


def usable_rows_per_h(features: DataFrame, label_prefix: str = "dU_next_h", horizons: int = 14,
                      min_rows: int = 200) -> DataFrame:
    """Rows with a label per horizon, horizons below ``min_rows`` dropped (P15). One aggregate."""
    agg = features.agg(*[F.count(f"{label_prefix}{h}").alias(f"h{h}") for h in range(1, horizons + 1)])
    stack = ", ".join(f"{h}, h{h}" for h in range(1, horizons + 1))
    return agg.selectExpr(f"stack({horizons}, {stack}) as (h, n_rows)").where(F.col("n_rows") >= min_rows)
