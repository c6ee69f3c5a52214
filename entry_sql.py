"""DuckDB text of the oracle queries (the same definitions written in SQL).

Only used by ``__spark_entry__.oracle_sql``; the library never runs SQL text.
"""

from __future__ import annotations

# Doubles are snapped to a binary grid of 2^-30 on both sides: x * 2^30 is exact in
# IEEE arithmetic, so both engines give the same double for the same input, and
# values that differ in the last bits (summation order) land on the same grid
# point.  Decimal rounding would not do: the data has 2-3 decimals, so means sit
# exactly on decimal halves, and the two engines round those differently.
GRID = float(2 ** 30)

ITEMS = ["item_click", "item_view", "item_error", "item_purchase"]


def sql_row_count(cols):
    return "(" + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols) + ")"


def sql_row_sum(cols):
    return f"CASE WHEN {sql_row_count(cols)} > 0 THEN (" + " + ".join(f"coalesce({c}, 0.0)" for c in cols) + ") END"


def sql_row_mean(cols):
    return f"({sql_row_sum(cols)}) / nullif({sql_row_count(cols)}, 0)"


def sql_row_sd(cols):
    m = sql_row_mean(cols)
    ss = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN ({c} - ({m})) * ({c} - ({m})) ELSE 0.0 END" for c in cols)
    return f"CASE WHEN {sql_row_count(cols)} >= 2 THEN sqrt(({ss}) / ({sql_row_count(cols)} - 1)) END"


def clamp(x, lo=0.0, hi=10.0):
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({lo}, least({hi}, ({x}))) END"


def diary_cte():
    items = []
    for it in ITEMS:
        t = it.split("_", 1)[1]
        a = f"avg(value) FILTER (WHERE event_type = '{t}')"
        items.append(f"CASE WHEN {a} IS NULL THEN NULL ELSE least(10.0, {a} / 10.0) END AS {it}")
    raw = f"""
raw_diary AS (
  SELECT CAST(user_id AS BIGINT) AS id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS day,
         CAST(ts AS DATE) AS start_date,
         {", ".join(items)},
         greatest(0.0, 10.0 - avg(value) / 10.0) AS overall_wellbeing,
         CAST(max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS INTEGER) AS treatment,
         CAST(max(CASE WHEN event_type = 'signup' THEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) END) % 3 AS INTEGER) AS treatment_type
  FROM events
  GROUP BY 1, 2, 3
),
diary AS (
  SELECT *,
         CAST({sql_row_count(ITEMS)} AS DOUBLE) AS symptom_count,
         {sql_row_sum(ITEMS)} AS total_symptom_score,
         greatest({", ".join(ITEMS)}) AS max_symptom_score,
         {sql_row_sd(ITEMS)} AS symptom_variability
  FROM raw_diary
)"""
    return raw


def panel_cte():
    """diary + composite scores.  ``w_t``/``q_t`` are named wn/qn here because
    DuckDB identifiers are case-insensitive (W_t and w_t would collide)."""
    nz = [f"nullif({c}, 0.0)" for c in ITEMS]
    return diary_cte() + f""",
panel0 AS (
  SELECT *, {clamp("overall_wellbeing")} AS W_t, {clamp(sql_row_mean(nz))} AS S_t FROM diary
),
panel AS (
  SELECT *, W_t / 10.0 AS wn, 1.0 - S_t / 10.0 AS qn,
         10.0 * pow(W_t / 10.0, 1.0) * pow(1.0 - S_t / 10.0, 1.0) AS U_t
  FROM panel0
)"""


def with_panel(body: str) -> str:
    return "WITH " + panel_cte() + ",\n" + body


def finalize(inner: str, cols: list[tuple[str, str]]) -> str:
    """Typed, rounded projection identical to ``__spark_entry__._final``."""
    sel = []
    for name, kind in cols:
        q = f'"{name}"'
        if kind == "i":
            sel.append(f"CAST({q} AS BIGINT) AS {q}")
        elif kind == "d":
            sel.append(f"CASE WHEN abs(CAST({q} AS DOUBLE)) < 1e15 THEN floor(CAST({q} AS DOUBLE) * CAST({GRID} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({GRID} AS DOUBLE) ELSE CAST({q} AS DOUBLE) END AS {q}")
        elif kind == "s":
            sel.append(f"CAST({q} AS VARCHAR) AS {q}")
        elif kind == "dt":
            sel.append(f"strftime(CAST({q} AS DATE), '%Y-%m-%d') AS {q}")
        else:
            raise ValueError(kind)
    return f"SELECT {', '.join(sel)} FROM ({inner}) q"


def sql_hash(expr: str) -> str:
    """60-bit md5 integer, the same as ``cohortflow.functions.hashing.hash_bigint``."""
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"
