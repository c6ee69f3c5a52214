"""Event study: treatment episodes, treated and control windows.

No joins and no per-entity loops.  Every condition of a window ``[c-L, c+H]`` is
a calendar-range frame (``rangeBetween`` on the integer day) evaluated at the
row where it is needed, and the course of an episode of any length is checked
with running counts (count of rows up to day e minus count before day s).  All
steps share the partitioning on id: the event table is one scan and one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.config import EventConfig

EVENT_COLUMNS = ("A_star", "Y_star", "centre_day", "episode_start", "episode_end", "episode_len")


def _treated_num(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _coded(treat_col: str, type_col: str | None, ev: EventConfig) -> Column:
    one = _treated_num(treat_col) == F.lit(1.0)
    if ev.require_codes and type_col:
        return one & F.coalesce(F.col(type_col).isin(*ev.inj_codes), F.lit(False))
    return one


def treatment_episodes(df: DataFrame, ev: EventConfig = EventConfig(), id_col: str = "id", day_col: str = "day",
                       treat_col: str = "is_treated", type_col: str | None = "treatment_type",
                       keep: list[str] | None = None) -> DataFrame:
    """Gaps and islands over coded treated rows.

    Consecutive integer days merge; a repeated day opens a new episode.  Returns
    (id, episode_start, episode_end[, kept columns of the first row]).
    """
    w = Window.partitionBy(id_col).orderBy(day_col)
    tx = df.filter(_coded(treat_col, type_col, ev) & F.col(day_col).isNotNull())
    prev = F.lag(day_col, 1).over(w)
    flagged = tx.select("*", F.when(prev.isNull() | (F.col(day_col) != prev + 1), 1).otherwise(0).alias("_new"))
    grouped = flagged.select("*", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_ep"))
    aggs = [F.min(day_col).alias("episode_start"), F.max(day_col).alias("episode_end")]
    if keep:
        aggs.append(F.min_by(F.struct(*keep), F.col(day_col)).alias("_first"))
    out = grouped.groupBy(id_col, "_ep").agg(*aggs)
    return out.drop("_ep")


def _stats(df: DataFrame, ev: EventConfig, id_col: str, day_col: str, treat_col: str, type_col: str | None) -> DataFrame:
    """Per-row range-frame statistics used by both event kinds (one Window node)."""
    L, H = ev.L, ev.H
    y = F.col(ev.outcome_col)
    w = Window.partitionBy(id_col).orderBy(F.col(day_col))
    whole = Window.partitionBy(id_col)
    pre = w.rangeBetween(-L, -1)
    post = w.rangeBetween(1, H)
    around = w.rangeBetween(-L, H)
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    before = w.rangeBetween(Window.unboundedPreceding, -1)
    coded = _coded(treat_col, type_col, ev)
    tnum = _treated_num(treat_col)
    bad = (~coded) | y.isNull()
    one = F.lit(1)
    # a day counts where it is first seen, so distinct days of a calendar frame are a sum
    fresh = F.lag(day_col, 1).over(w)
    df = df.select("*", F.when(fresh.isNull() | (F.col(day_col) != fresh), 1).otherwise(0).alias("_fresh"))

    def _distinct(frame):
        return F.coalesce(F.sum("_fresh").over(frame), F.lit(0))

    return df.select(
        "*",
        coded.alias("_coded"),
        F.min(day_col).over(whole).alias("_dmin"), F.max(day_col).over(whole).alias("_dmax"),
        F.count(one).over(pre).alias("_pre_n"), _distinct(pre).alias("_pre_days"),
        F.sum(tnum).over(pre).alias("_pre_t"), F.count(y).over(pre).alias("_pre_ok"),
        F.max_by(y, F.col(day_col)).over(pre).alias("_pre_last"),
        F.count(one).over(post).alias("_post_n"), _distinct(post).alias("_post_days"),
        F.sum(coded.cast("int")).over(post).alias("_post_coded"), F.count(y).over(post).alias("_post_ok"),
        F.avg(y).over(post).alias("_post_mean"),
        F.count(one).over(around).alias("_win_n"), _distinct(around).alias("_win_days"),
        F.sum(tnum).over(around).alias("_win_t"), F.count(y).over(around).alias("_win_ok"),
        F.count(one).over(upto).alias("_c_le"), F.coalesce(F.count(one).over(before), F.lit(0)).alias("_c_lt"),
        F.sum(bad.cast("int")).over(upto).alias("_b_le"),
        F.coalesce(F.sum(bad.cast("int")).over(before), F.lit(0)).alias("_b_lt"),
        F.sum(y).over(upto).alias("_y_le"), F.coalesce(F.sum(y).over(before), F.lit(0.0)).alias("_y_lt"),
    )


_STAT_COLS = ("_coded", "_dmin", "_dmax", "_pre_n", "_pre_days", "_pre_t", "_pre_ok", "_pre_last", "_post_n",
              "_post_days", "_post_coded", "_post_ok", "_post_mean", "_win_n", "_win_days", "_win_t", "_win_ok",
              "_c_le", "_c_lt", "_b_le", "_b_lt", "_y_le", "_y_lt")


def _episode_ends(st: DataFrame, cols: list[str], id_col: str, day_col: str) -> DataFrame:
    """Adds ``_a``, the fields of the first row of the episode a coded row belongs to, and ``_last``,
    whether the row ends its episode.  Same partitioning and order as the statistics, no grouping."""
    w = Window.partitionBy(id_col).orderBy(day_col)
    day = F.col(day_col)
    coded = F.col("_coded") & day.isNotNull()
    prev = F.last(F.when(coded, day), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    st = st.select("*", (coded & (prev.isNull() | (day != prev + 1))).alias("_new"))
    first = F.struct(*[F.col(f"`{c}`") for c in cols], F.col(day_col).alias("_s"), "_dmin", "_dmax", "_pre_n", "_pre_days", "_pre_t", "_pre_ok", "_pre_last", "_c_lt", "_b_lt", "_y_lt")
    after = F.first(F.when(coded, F.col("_new")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return st.select("*", F.last(F.when(F.col("_new"), first), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_a"),
                     (coded & F.coalesce(after, F.lit(True))).alias("_last"))


def _treated_condition(ev: EventConfig, day_col: str) -> Column:
    L, H = ev.L, ev.H
    a, e = F.col("_a"), F.col(day_col)
    s = a["_s"]
    cond = (F.col("_last") & (s - L >= a["_dmin"]) & (e + H <= a["_dmax"])
            & (a["_pre_n"] == L) & (a["_pre_days"] == L)
            & (F.col("_c_le") - a["_c_lt"] == e - s + 1)
            & (F.col("_post_n") == H) & (F.col("_post_days") == H)
            & (a["_pre_t"] == 0)
            & (F.col("_b_le") - a["_b_lt"] == 0)
            & (a["_pre_ok"] == L) & (F.col("_post_ok") == H))
    return cond & (F.col("_post_coded") == 0) if ev.block_retreatment else cond


def _control_condition(ev: EventConfig, day_col: str, treat_col: str) -> Column:
    c, n = F.col(day_col), ev.L + ev.H + 1
    return ((_treated_num(treat_col) == 0) & c.isNotNull()
            & (c - ev.L >= F.col("_dmin")) & (c + ev.H <= F.col("_dmax"))
            & (F.col("_win_n") == n) & (F.col("_win_days") == n)
            & (F.col("_win_t") == 0) & (F.col("_win_ok") == n))


def _event_fields(ev: EventConfig, cols: list[str], day_col: str, treated: Column, control_ev: EventConfig | None = None) -> list[Column]:
    """Output columns of event rows: of the episode where ``treated``, of the day itself elsewhere."""
    cev = control_ev or ev
    a, day = F.col("_a"), F.col(day_col)
    length = day - a["_s"] + 1
    before = (F.col("_y_le") - a["_y_lt"]) / length.cast("double") if ev.baseline == "course_mean" else a["_pre_last"]
    own = F.col(cev.outcome_col) if cev.baseline in ("centre", "course_mean") else F.col("_pre_last")
    pick = lambda t, c: F.when(treated, t).otherwise(c)
    return [*[pick(a[c], F.col(f"`{c}`")).alias(c) for c in cols], treated.cast("int").alias("A_star"),
            (F.col("_post_mean") - pick(before, own)).cast("double").alias("Y_star"),
            pick(a["_s"], day).cast("int").alias("centre_day"), pick(a["_s"], day).cast("int").alias("episode_start"),
            day.cast("int").alias("episode_end"), pick(length, F.lit(1)).cast("int").alias("episode_len")]


def _first_controls(events: DataFrame, most: int | None, id_col: str) -> DataFrame:
    if most is None:
        return events
    w = Window.partitionBy(id_col, "A_star").orderBy("centre_day")
    return events.select("*", F.row_number().over(w).alias("_k")).filter((F.col("A_star") == 1) | (F.col("_k") <= most)).drop("_k")


def treated_events(df: DataFrame, ev: EventConfig = EventConfig(), id_col: str = "id", day_col: str = "day",
                   treat_col: str = "is_treated", type_col: str | None = "treatment_type") -> DataFrame:
    """Treated event windows around each episode (W17, W19 options).

    Kept when pre ``[s-L, s-1]``, course ``[s, e]`` and post ``[e+1, e+H]`` are
    row-complete inside the id's span, the pre window is untreated, the course is
    all coded treatment, (by default) the post window has no coded treatment, and
    the outcome is present everywhere.  ``Y* = mean(post) - baseline``.
    """
    cols = df.columns
    st = _episode_ends(_stats(df, ev, id_col, day_col, treat_col, type_col), cols, id_col, day_col)
    return st.filter(_treated_condition(ev, day_col)).select(*_event_fields(ev, cols, day_col, F.lit(True)))


def control_events(df: DataFrame, ev: EventConfig = EventConfig(), id_col: str = "id", day_col: str = "day",
                   treat_col: str = "is_treated", type_col: str | None = "treatment_type") -> DataFrame:
    """Control windows: every untreated day c whose ``[c-L, c+H]`` is row-complete,
    untreated and outcome-complete (W18).  Overlapping windows are allowed;
    ``max_controls_per_id`` keeps the earliest days (W20)."""
    cols = df.columns
    st = _stats(df, ev, id_col, day_col, treat_col, type_col)
    own = F.col(ev.outcome_col) if ev.baseline in ("centre", "course_mean") else F.col("_pre_last")
    c = F.col(day_col).cast("int")
    out = st.filter(_control_condition(ev, day_col, treat_col)).select(
        *cols, F.lit(0).alias("A_star"), (F.col("_post_mean") - own).cast("double").alias("Y_star"),
        c.alias("centre_day"), c.alias("episode_start"), c.alias("episode_end"), F.lit(1).alias("episode_len"))
    return _first_controls(out, ev.max_controls_per_id, id_col)


def event_table(df: DataFrame, ev: EventConfig = EventConfig(), id_col: str = "id", day_col: str = "day",
                treat_col: str = "is_treated", type_col: str | None = "treatment_type",
                control_ev: EventConfig | None = None) -> DataFrame:
    """Union of treated and control events, rows without Y* dropped.

    With one window size for both kinds a row is at most one event, so both come from one pass:
    one scan, one exchange on the id, and a filter.
    """
    cev = control_ev or ev
    cols = df.columns
    if (cev.L, cev.H, cev.outcome_col) != (ev.L, ev.H, ev.outcome_col):
        t = treated_events(df, ev, id_col, day_col, treat_col, type_col)
        both = t.unionByName(control_events(df, cev, id_col, day_col, treat_col, type_col))
        return both.filter(F.col("Y_star").isNotNull())
    st = _episode_ends(_stats(df, ev, id_col, day_col, treat_col, type_col), cols, id_col, day_col)
    st = st.select("*", F.coalesce(_treated_condition(ev, day_col), F.lit(False)).alias("_is_treated_event"))
    out = st.filter(F.col("_is_treated_event") | _control_condition(cev, day_col, treat_col)).select(
        *_event_fields(ev, cols, day_col, F.col("_is_treated_event"), cev))
    return _first_controls(out.filter(F.col("Y_star").isNotNull()), cev.max_controls_per_id, id_col)


def with_event_weight(events: DataFrame, id_col: str = "id") -> DataFrame:
    """``w = 1 / events of the id``."""
    return events.select("*", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(id_col))).alias("w_event"))


def cluster_support(events: DataFrame, id_col: str = "id", treat_col: str = "A_star") -> DataFrame:
    """G = treated ids, G_eff = 1 / sum(p^2) with p the share of treated events per id.

    Two small aggregates: per id, then one row.  (0, 0.0) when there is no treated event.
    """
    per_id = events.filter(F.col(treat_col) == 1).groupBy(id_col).agg(F.count(F.lit(1)).alias("c"))
    tot = per_id.agg(F.count(F.lit(1)).alias("G"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    return tot.select(
        F.col("G").cast("bigint").alias("G"),
        F.coalesce(F.col("n").cast("double") * F.col("n").cast("double") / F.col("ss").cast("double"), F.lit(0.0)).alias("G_eff"),
    )


def cluster_support_by(events: DataFrame, by: str, id_col: str = "id", treat_col: str = "A_star") -> DataFrame:
    """A11 for every value of ``by`` that has treated events: (by, G, G_eff)."""
    per_id = events.filter(F.col(treat_col) == 1).groupBy(by, id_col).agg(F.count(F.lit(1)).cast("double").alias("c"))
    return per_id.groupBy(by).agg(F.count(F.lit(1)).alias("G"), (F.sum("c") * F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("G_eff"))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that are NULL on every row (P11): one aggregate, then a select."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


def column_presence(df: DataFrame) -> DataFrame:
    """Long table (column, n_nonnull) of the columns that hold a value (P11 as data)."""
    cnt = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    pairs = ", ".join(f"'{c}', c{i}" for i, c in enumerate(df.columns))
    return (cnt.selectExpr(f"stack({len(df.columns)}, {pairs}) as (column_name, n_nonnull)")
            .filter(F.col("n_nonnull") > 0))
