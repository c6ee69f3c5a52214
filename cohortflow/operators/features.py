"""Per-entity ordered features: treatment history, lags, rolling, EWM, labels.

Everything is window expressions partitioned by ``id`` and ordered by (day, date).  The plan
holds several Window operators (one for each spec and step), but they share one exchange on
``id``.

Scale note: a window partition holds the rows of one entity.  Panels built by
``diary_from_events`` have one row per (id, day), so a partition is bounded by
the entity's calendar span (at most a few thousand days) no matter how large the
table is or how many raw events one entity produced.
Row-offset frames (``rowsBetween``) implement lags/rolling; calendar frames
(``rangeBetween`` on the integer day) are used by the event windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.config import PanelConfig
from cohortflow.functions.scalar import day_of_week, dow_cos, dow_sin, safe_div, treatment_flag

SCORES = ("W_t", "S_t", "U_t")
BIG_GAP = 1e9  # rows-since-last-treatment before the first treatment (reference sentinel)


def order_spec(cfg: PanelConfig):
    return Window.partitionBy(cfg.id_col).orderBy(*[F.col(c).asc_nulls_first() for c in cfg.order_cols])


def _rows(cfg, lo, hi):
    return order_spec(cfg).rowsBetween(lo, hi)


def gated(agg: Column, x: Column, frame, min_periods: int) -> Column:
    """``agg`` over ``frame`` when the frame holds at least ``min_periods`` values."""
    return F.when(F.count(x).over(frame) >= F.lit(min_periods), agg.over(frame))


def ewm_lookback(alpha: float, tol_bits: int = 56) -> int:
    """Values after which older ones weigh less than 2^-tol_bits (below double precision)."""
    return int(math.ceil(tol_bits * math.log(2.0) / -math.log(1.0 - alpha)))


#: smoothing factors of the feature block and their column tags
EWM = (("a03", 0.30), ("a10", 0.10))
#: longest decay (natural logarithm) of one step and of one block; e^-60 is far below double precision
EWM_STEP, EWM_BLOCK = 60.0, 300.0


def ewm_at(df: DataFrame, c: str, factors, cfg: PanelConfig, row: str) -> DataFrame:
    """Adds ``_ewm_{c}_{tag}``: recursive EWM (``adjust=False``) at the rows where ``c`` has a value, NULL elsewhere.

    A value g rows after the one before gives m = p*m + (1-p)*x with p = w/(w+a), w = (1-a)^g.  So m is
    a sum of x*(1-p) with decays that are differences of L, the running sum of -ln p.  The sum runs
    forward inside blocks of L, where exp(L) keeps its size; of earlier blocks only the last one
    weighs more than e^-EWM_BLOCK.  Every step is a running aggregate: work and state per row do not depend
    on the gaps or on the length of a series.
    """
    group = [F.col(cfg.id_col), F.col(c).isNull()]
    values = Window.partitionBy(*group).orderBy(row)
    upto = values.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(c).cast("double")
    out = df.select("*", (F.col(row) - F.lag(row).over(values)).cast("double").alias("_gap"),
                    (F.min(c).over(upto) == F.max(c).over(upto)).alias("_same"))
    for tag, alpha in factors:
        a, rate = F.lit(float(alpha)), -math.log1p(-float(alpha))
        w = F.exp(F.col("_gap") * F.lit(-rate))
        step = F.coalesce(F.least(F.lit(EWM_STEP), F.col("_gap") * F.lit(rate) + F.log(w + a)), F.lit(0.0))
        share = F.coalesce(a / (w + a), F.lit(1.0))                       # 1 - p; the first value counts whole
        out = out.select("*", F.sum(step).over(upto).alias("_decay"))
        out = out.select("*", F.floor(F.col("_decay") / F.lit(EWM_BLOCK)).alias("_block"))
        block = Window.partitionBy(*group, "_block").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
        inside = F.col("_decay") - F.col("_block") * F.lit(EWM_BLOCK)
        out = out.select("*", (F.exp(-inside) * F.sum(share * x * F.exp(inside)).over(block)).alias("_part"))
        before = Window.partitionBy(*group).orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
        out = out.select("*", F.last(F.struct("_decay", "_part")).over(before).alias("_last"))
        m = F.col("_part") + F.coalesce(F.exp(F.col("_last._decay") - F.col("_decay")) * F.col("_last._part"), F.lit(0.0))
        out = out.select("*", F.when(F.col(c).isNotNull(), F.when(F.col("_same"), x).otherwise(m)).alias(f"_ewm_{c}_{tag}"))
        out = out.drop("_decay", "_block", "_part", "_last")
    return out.drop("_gap", "_same")


def ewm_past(df: DataFrame, cfg: PanelConfig, cols, factors=EWM) -> DataFrame:
    """Adds ``{c}_ewm_{tag}``: the EWM of the rows before.

    A missing row leaves the mean as it was, so the EWM of the past is the EWM at the last
    row with a value, however many rows ago.  All steps share the partitioning on the id.
    """
    pairs = [(c, tag, a) for c in cols for tag, a in factors]
    at = df.select("*", F.row_number().over(order_spec(cfg)).alias("_ewm_row"))
    for c in cols:
        at = ewm_at(at, c, factors, cfg, "_ewm_row")
    past = Window.partitionBy(cfg.id_col).orderBy("_ewm_row").rowsBetween(Window.unboundedPreceding, -1)
    out = at.select("*", *[F.last(f"_ewm_{c}_{tag}", ignorenulls=True).over(past).alias(f"{c}_ewm_{tag}") for c, tag, _ in pairs])
    return out.drop("_ewm_row", *[f"_ewm_{c}_{tag}" for c, tag, _ in pairs])


def treatment_columns(df: DataFrame, cfg: PanelConfig) -> DataFrame:
    """is_treated, days_since_treatment_start, treated_today/yday, treated_last3_any,
    days_since_last_treat (P12, W12, W13, W14).  Adds helper ``_rn`` (row number)."""
    w = order_spec(cfg)
    whole = Window.partitionBy(cfg.id_col)
    day = F.col(cfg.day_col)
    if cfg.treatment_col and cfg.treatment_col in df.columns:
        flag = treatment_flag(cfg.treatment_col)
    else:
        flag = F.lit(0)
    base = df.select("*", flag.alias("is_treated"), F.row_number().over(w).alias("_rn"))
    t0 = F.min(F.when(F.col("is_treated") == 1, day)).over(whole)
    last_tx = F.max(F.when(F.col("is_treated") == 1, F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return base.select(
        "*",
        F.when(t0.isNull(), F.lit(0.0)).otherwise(
            F.when(day.isNotNull(), F.greatest(F.lit(0.0), (day - t0).cast("double")))).alias("days_since_treatment_start"),
        F.col("is_treated").alias("treated_today"),
        F.coalesce(F.lag("is_treated", 1).over(w), F.lit(0)).alias("treated_yday"),
        F.max("is_treated").over(w.rowsBetween(-2, 0)).alias("treated_last3_any"),
        F.coalesce((F.col("_rn") - last_tx).cast("double"), F.lit(BIG_GAP)).alias("days_since_last_treat"),
    )


def lag_roll_columns(cfg: PanelConfig, cols=SCORES, include_current: bool | None = None) -> list[Column]:
    """Lags 1/2/7, trailing mean/sd (3, 7, 14 rows), first differences."""
    inc = cfg.include_current if include_current is None else include_current
    w = order_spec(cfg)
    out = []
    for c in cols:
        x = F.col(c)
        for k in (1, 2, 7):
            out.append(F.lag(x, k).over(w).alias(f"{c}_lag{k}"))
        for k, m, stat in ((3, 1, "mean"), (7, 1, "mean"), (7, 2, "std"), (14, 3, "mean"), (14, 3, "std")):
            frame = _rows(cfg, -(k - 1), 0) if inc else _rows(cfg, -k, -1)
            agg = F.avg(x) if stat == "mean" else F.stddev_samp(x)
            out.append(gated(agg, x, frame, m).alias(f"{c}_roll{k}_{stat}"))
    for c in cols:
        out.append((F.col(c) - F.lag(F.col(c), 1).over(w)).alias(f"d{c}"))
    return out


def running_columns(cfg: PanelConfig, base: str, win: int = 14, name_prefix: str | None = None,
                    whole_record_mean: bool = False) -> list[Column]:
    """Running mean/sd of the past ``win`` rows (min 3), expanding z and deviation."""
    p = name_prefix or base
    x = F.col(base)
    past = _rows(cfg, -win, -1)
    expanding = _rows(cfg, Window.unboundedPreceding, -1)
    exp_mean = F.avg(x).over(expanding)
    exp_sd = F.stddev_samp(x).over(expanding)
    out = [
        gated(F.avg(x), x, past, 3).alias(f"{p}_runmean_{win}"),
        gated(F.stddev_samp(x), x, past, 3).alias(f"{p}_runstd_{win}"),
        safe_div(x - exp_mean, F.nullif(exp_sd, F.lit(0.0))).alias(f"{p}_within_z"),
    ]
    if whole_record_mean:
        out.append((x - F.avg(x).over(Window.partitionBy(cfg.id_col))).alias(f"{p}_minus_person_mean"))
    else:
        out.append((x - exp_mean).alias(f"{p}_minus_person_mean"))
    return out


def calendar_columns(cfg: PanelConfig) -> list[Column]:
    """dow, dow_sin, dow_cos (P13) and days_since_start."""
    dow = day_of_week(cfg.date_col, cfg.day_col)
    return [
        dow.alias("dow"), dow_sin(dow).alias("dow_sin"), dow_cos(dow).alias("dow_cos"),
        (F.col(cfg.day_col) - F.min(cfg.day_col).over(Window.partitionBy(cfg.id_col))).alias("days_since_start"),
    ]


def label_columns(cfg: PanelConfig, horizons: int, targets=(("U", "U_t"), ("W", "W_t"), ("S", "S_t")),
                  with_star: bool = True) -> list[Column]:
    """Row-offset horizon labels ``{P}_next_h{h}`` and deltas ``d{P}_next_h{h}``."""
    w = order_spec(cfg)
    out = []
    for h in range(1, horizons + 1):
        for p, base in targets:
            nxt = F.lead(F.col(base), h).over(w)
            out.append(nxt.alias(f"{p}_next_h{h}"))
            out.append((nxt - F.col(base)).alias(f"d{p}_next_h{h}"))
    if with_star:
        for p, base in targets:
            nxt = F.lead(F.col(base), 1).over(w)
            out.append(nxt.alias(f"{p}star_next_day"))
            out.append((nxt - F.col(base)).alias(f"d{p}_next"))
    return out


def infer_hmax(df: DataFrame, cfg: PanelConfig, cap: int | None = None) -> DataFrame:
    """Largest calendar span over ids, at least 1, optionally capped (A1). One row."""
    span = (df.groupBy(cfg.id_col)
            .agg((F.max(cfg.day_col) - F.min(cfg.day_col)).alias("span")))
    h = F.greatest(F.lit(1), F.coalesce(F.max("span"), F.lit(1)))
    if cap is not None:
        h = F.least(F.lit(int(cap)), h)
    return span.agg(h.cast("int").alias("h_max"))


def forecasting_features(df: DataFrame, cfg: PanelConfig, horizons: int | None = None) -> DataFrame:
    """Whole forecasting block on a scored panel: one shuffle on id, one sort."""
    H = cfg.horizons if horizons is None else horizons
    tx = ewm_past(treatment_columns(df, cfg), cfg, SCORES)
    cols = (lag_roll_columns(cfg) + calendar_columns(cfg)
            + running_columns(cfg, "U_t") + running_columns(cfg, "W_t") + running_columns(cfg, "S_t")
            + label_columns(cfg, H))
    return tx.select("*", *cols).drop("_rn")


def effect_features(df: DataFrame, cfg: PanelConfig, horizons: int = 14) -> DataFrame:
    """Effect-study block: rolling windows include the current row, labels ``Y_``/``dY_``
    on U_t, and the deviation from the whole-record mean (W5, W10)."""
    tx = ewm_past(treatment_columns(df, cfg), cfg, SCORES)
    run = running_columns(cfg, "U_t", name_prefix="U", whole_record_mean=True)
    cols = (lag_roll_columns(cfg, include_current=True) + calendar_columns(cfg) + run
            + label_columns(cfg, horizons, targets=(("Y", "U_t"),), with_star=False))
    w = order_spec(cfg)
    star = [F.lead("U_t", 1).over(w).alias("Ystar_next_day"), (F.lead("U_t", 1).over(w) - F.col("U_t")).alias("dY_next")]
    return tx.select("*", *cols, *star).drop("_rn")
