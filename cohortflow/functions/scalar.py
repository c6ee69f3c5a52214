"""Scalar column expressions (JVM-side, codegen friendly).

All helpers return ``Column`` objects; nothing here touches rows in Python.
ANSI mode is on by default in Spark 4, so every lossy conversion uses the
``try_*`` family and every clamp keeps NULL as NULL.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_num(c, dtype: str = "double") -> Column:
    """Lossy numeric cast: text that is not a number becomes NULL, NaN becomes NULL."""
    v = F.expr(f"try_cast(`{c}` as {dtype})") if isinstance(c, str) else c.try_cast(dtype)
    if dtype in ("double", "float"):
        v = F.when(~F.isnan(v), v)
    return v


def parse_dayfirst_date(c) -> Column:
    """Day-first date text (``31/12/2024``) or ISO text to DATE; bad text gives NULL."""
    s = _c(c).cast("string")
    return F.coalesce(
        F.to_date(F.try_to_timestamp(s, F.lit("d/M/yyyy"))),
        F.to_date(F.try_to_timestamp(s, F.lit("d-M-yyyy"))),
        F.to_date(F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))),
    )


def zero_as_null(c) -> Column:
    """``replace(0, NaN)`` on a symptom item."""
    return F.nullif(_c(c), F.lit(0.0))


def row_count(cols) -> Column:
    """Number of non-null values across columns."""
    return sum((_c(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_sum(cols) -> Column:
    """Sum of the non-null values; NULL when all are NULL."""
    total = sum((F.coalesce(_c(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(row_count(cols) > 0, total)


def row_mean(cols) -> Column:
    """Row-wise mean ignoring NULLs; NULL when every value is NULL."""
    return F.try_divide(row_sum(cols), F.nullif(row_count(cols), F.lit(0)).cast("double"))


def row_max(cols) -> Column:
    """Row-wise max ignoring NULLs (``greatest`` already skips NULLs)."""
    return F.greatest(*[_c(c) for c in cols]) if len(cols) > 1 else _c(cols[0])


def row_sd_samp(cols) -> Column:
    """Row-wise sample sd of the non-null values (two-pass form); NULL below two values."""
    m = row_mean(cols)
    ss = sum((F.when(_c(c).isNotNull(), (_c(c) - m) * (_c(c) - m)).otherwise(F.lit(0.0)) for c in cols), F.lit(0.0))
    n = row_count(cols)
    return F.when(n >= 2, F.sqrt(ss / (n - 1).cast("double")))


def clamp(c, lo: float = 0.0, hi: float = 10.0) -> Column:
    """``clip(lo, hi)`` that keeps NULL as NULL (bare greatest/least would invent a value) (P5)."""
    x = _c(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def safe_div(a, b) -> Column:
    """Division whose infinite or undefined results become NULL."""
    return F.try_divide(_c(a), F.nullif(_c(b), F.lit(0)))


def scrub_nonfinite(c) -> Column:
    """+-inf and NaN to NULL."""
    x = _c(c)
    return F.when(~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), x)


def treatment_flag(c) -> Column:
    """``is_treated``: 1 when the value equals 1, otherwise 0 (missing included)."""
    return F.coalesce((to_num(c) == F.lit(1.0)).cast("int"), F.lit(0))


def day_of_week(date_col: str | None, day_col: str) -> Column:
    """Monday-0 weekday of the date, else ``day % 7``."""
    if date_col:
        return F.weekday(F.col(date_col)).cast("int")
    return F.pmod(F.col(day_col), F.lit(7)).cast("int")


def dow_sin(dow: Column) -> Column:
    return F.sin(F.lit(2.0 * math.pi) * F.coalesce(dow.cast("double"), F.lit(0.0)) / F.lit(7.0))


def dow_cos(dow: Column) -> Column:
    return F.cos(F.lit(2.0 * math.pi) * F.coalesce(dow.cast("double"), F.lit(0.0)) / F.lit(7.0))


def logspace(start: float, stop: float, num: int) -> Column:
    """Array column equal to ``numpy.logspace(start, stop, num)``."""
    step = (stop - start) / (num - 1) if num > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)),
                       lambda i: F.pow(F.lit(10.0), F.lit(float(start)) + i.cast("double") * F.lit(step)))


def normal_quantile(level: float) -> float:
    """Two-sided normal critical value for a confidence level (1.96 at 0.95)."""
    return NormalDist().inv_cdf(0.5 + level / 2.0)
