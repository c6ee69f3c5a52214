"""Feature block on hand-made micro-panels (SURVEY sec. 5: unsorted rows, gaps, repeats,
missing values) and against pandas on the reference's own definitions."""

import numpy as np
import pandas as pd
import pytest

from cohortflow.config import PanelConfig
from cohortflow.operators.features import ewm_lookback, forecasting_features, treatment_columns
from cohortflow.operators.score import score

CFG = PanelConfig(date_col=None, items=("a", "b"))


def _panel(spark, rows):
    rows = [(int(r[0]), int(r[1]), *(None if v is None else float(v) for v in r[2:6]), None if r[6] is None else int(r[6]))
            for r in rows]
    df = spark.createDataFrame(rows, "id long, day int, overall_wellbeing double, a double, b double, treatment double, "
                                     "treatment_type int")
    return score(df, ["a", "b"])


def test_score_zero_items_and_clamp(spark):
    p = _panel(spark, [(1, 1, 12.0, 0.0, 0.0, 0, None), (1, 2, 5.0, 4.0, 0.0, 0, None), (1, 3, -1.0, None, None, 1, 1)])
    got = {r["day"]: r for r in p.collect()}
    assert got[1]["W_t"] == 10.0 and got[1]["S_t"] is None        # all items zero -> missing S
    assert got[2]["S_t"] == 4.0                                       # zero item ignored
    assert got[3]["W_t"] == 0.0 and got[3]["U_t"] is None
    assert got[2]["U_t"] == pytest.approx(10 * 0.5 * 0.6)


def test_unsorted_input_and_lags_rolls_match_pandas(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in (1, 2):
        for d in rng.permutation(np.r_[1:9, 11:20]):               # unsorted, with a day gap
            rows.append((i, int(d), float(rng.uniform(0, 10)), float(rng.choice([0, 3, 7])), float(rng.uniform(1, 9)), 0, None))
    p = _panel(spark, rows)
    f = forecasting_features(p, CFG, horizons=2).toPandas().sort_values(["id", "day"])
    ref = p.toPandas().sort_values(["id", "day"])
    g = ref.groupby("id")["U_t"]
    exp = pd.DataFrame({
        "lag2": g.shift(2),
        "roll7": g.transform(lambda s: s.shift(1).rolling(7, min_periods=1).mean()),
        "std14": g.transform(lambda s: s.shift(1).rolling(14, min_periods=3).std()),
        "ewm": g.transform(lambda s: s.shift(1).ewm(alpha=0.3, adjust=False).mean()),
        "z": (ref["U_t"] - g.transform(lambda s: s.shift(1).expanding().mean()))
        / g.transform(lambda s: s.shift(1).expanding().std()).replace(0, np.nan),
        "lead2": g.shift(-2),
    })
    np.testing.assert_allclose(f["U_t_lag2"].to_numpy(float), exp["lag2"].to_numpy(float), equal_nan=True)
    np.testing.assert_allclose(f["U_t_roll7_mean"].to_numpy(float), exp["roll7"].to_numpy(float), equal_nan=True)
    np.testing.assert_allclose(f["U_t_roll14_std"].to_numpy(float), exp["std14"].to_numpy(float), equal_nan=True)
    np.testing.assert_allclose(f["U_t_ewm_a03"].to_numpy(float), exp["ewm"].to_numpy(float), equal_nan=True, rtol=1e-12)
    np.testing.assert_allclose(f["U_t_within_z"].to_numpy(float), exp["z"].to_numpy(float), equal_nan=True, rtol=1e-9)
    np.testing.assert_allclose(f["U_next_h2"].to_numpy(float), exp["lead2"].to_numpy(float), equal_nan=True)


def test_ewm_with_missing_rows_matches_pandas(spark):
    vals = [1.0, None, None, 4.0, 2.0, None, 8.0, 3.0]
    rows = [(1, d + 1, 5.0, v if v is not None else 0.0, 1.0, 0, None) for d, v in enumerate(vals)]
    p = _panel(spark, rows)
    # force S_t missing where the value is None (item a = 0 and b = 0 -> missing)
    p = p.selectExpr("*").drop("S_t").withColumn("S_t", __import__("pyspark.sql.functions", fromlist=["x"]).expr(
        "CASE WHEN a = 0 THEN NULL ELSE a END"))
    f = forecasting_features(p, CFG, horizons=1).toPandas().sort_values("day")
    exp = pd.Series(vals, dtype=float).shift(1).ewm(alpha=0.1, adjust=False).mean()
    np.testing.assert_allclose(f["S_t_ewm_a10"].to_numpy(float), exp.to_numpy(float), equal_nan=True, rtol=1e-12)
    assert ewm_lookback(0.3) == 109 and ewm_lookback(0.1) == 369


def test_ewm_after_long_and_many_gaps_matches_pandas(spark):
    from cohortflow.operators.features import ewm_past
    rng = np.random.default_rng(8)
    series = {1: [5.0] + [None] * 400 + [2.0] + [None] * 110 + [9.0, None],                       # gaps beyond either look-back
              2: [float(rng.uniform()) if rng.random() < 0.08 else None for _ in range(900)],     # sparse all the way
              3: [None] * 30, 4: [float(rng.uniform()) for _ in range(500)]}
    rows = [(i, d, v) for i, vs in series.items() for d, v in enumerate(vs)]
    cfg = CFG.__class__(id_col="id", day_col="day", date_col=None)
    got = ewm_past(spark.createDataFrame(rows, "id long, day int, x double"), cfg, ["x"]).toPandas()
    for i, vs in series.items():
        own = got[got.id == i].sort_values("day")
        for tag, a in (("a03", 0.3), ("a10", 0.1)):
            exp = pd.Series(vs, dtype=float).ewm(alpha=a, adjust=False).mean().shift(1)
            np.testing.assert_allclose(own[f"x_ewm_{tag}"].to_numpy(float), exp.to_numpy(float), equal_nan=True, rtol=1e-11)


def test_ewm_runs_forward_and_collects_nothing(spark):
    """Series of many decay blocks, and gaps that end a block, from running aggregates alone: no list per row."""
    from cohortflow.operators.features import ewm_past
    rng = np.random.default_rng(3)
    series = {1: rng.normal(size=2500).tolist(), 2: [float(rng.uniform()) if d % 850 < 3 else None for d in range(3000)], 3: [4.7] * 1200}
    cfg = CFG.__class__(id_col="id", day_col="day", date_col=None)
    got = ewm_past(spark.createDataFrame([(i, d, v) for i, vs in series.items() for d, v in enumerate(vs)], "id long, day int, x double"), cfg, ["x"])
    assert "collect_list" not in got._jdf.queryExecution().toString()
    got = got.toPandas()
    for i, vs in series.items():
        own = got[got.id == i].sort_values("day")
        for tag, a in (("a03", 0.3), ("a10", 0.1)):
            exp = pd.Series(vs, dtype=float).ewm(alpha=a, adjust=False).mean().shift(1)
            np.testing.assert_allclose(own[f"x_ewm_{tag}"].to_numpy(float), exp.to_numpy(float), equal_nan=True, rtol=1e-11, atol=1e-13)
    assert set(got[(got.id == 3) & (got.day > 0)]["x_ewm_a03"]) == {4.7}


def test_treatment_history_and_no_treatment_column(spark):
    rows = [(7, d, 5.0, 1.0, 1.0, t, 1) for d, t in zip(range(1, 9), [1, 0, 0, 1, 0, 0, 0, 0])]
    p = _panel(spark, rows)
    t = treatment_columns(p, CFG).toPandas().sort_values("day")
    assert t["days_since_last_treat"].tolist() == [0, 1, 2, 0, 1, 2, 3, 4]
    assert t["treated_yday"].tolist() == [0, 1, 0, 0, 1, 0, 0, 0]
    assert t["treated_last3_any"].tolist() == [1, 1, 1, 1, 1, 1, 0, 0]
    assert t["days_since_treatment_start"].tolist() == [0, 1, 2, 3, 4, 5, 6, 7]
    never = treatment_columns(p.drop("treatment"), CFG).toPandas()
    assert set(never["is_treated"]) == {0} and set(never["days_since_last_treat"]) == {1e9}


def test_no_lookahead(spark):
    """Changing the future must not change any feature at t (labels and W10 excluded)."""
    rng = np.random.default_rng(3)
    base = [(1, d, float(rng.uniform(0, 10)), float(rng.uniform(1, 9)), 2.0, 0, None) for d in range(1, 16)]
    changed = [r if r[1] <= 8 else (r[0], r[1], 0.5, 9.0, 9.0, 1, 1) for r in base]
    f1 = forecasting_features(_panel(spark, base), CFG, 1).where("day <= 8").toPandas().sort_values("day")
    f2 = forecasting_features(_panel(spark, changed), CFG, 1).where("day <= 8").toPandas().sort_values("day")
    cols = [c for c in f1.columns if "next" not in c and c not in ("days_since_treatment_start",)]
    pd.testing.assert_frame_equal(f1[cols].reset_index(drop=True), f2[cols].reset_index(drop=True))


def test_row_count_preserved_on_test_table(spark):
    from cohortflow.plans.prepare import events_features, events_panel
    from tests.conftest import SF_SMALL
    assert events_features(spark, SF_SMALL, 3).count() == events_panel(spark, SF_SMALL).count()


def test_feature_selection_leak_rules(spark):
    from cohortflow.plans.features import effect_feature_columns, feature_columns
    from cohortflow.plans.prepare import events_features
    from tests.conftest import SF_SMALL
    f = events_features(spark, SF_SMALL, 3)
    feats = feature_columns(f, "dU_next_h1")
    assert "id" not in feats and "day" not in feats and "dU_next_h1" not in feats
    assert not any(c.startswith(("U_next_h", "dU_next_h", "W_next_h", "S_next_h")) for c in feats)
    assert not any(c in ("Ustar_next_day", "dU_next") for c in feats)
    assert "U_t_lag1" in feats and "is_treated" in feats and "start_date" not in feats
    ev = f.select("*", __import__("pyspark.sql.functions", fromlist=["x"]).lit(1).alias("A_star"),
                  __import__("pyspark.sql.functions", fromlist=["x"]).lit(0.0).alias("Y_star"),
                  __import__("pyspark.sql.functions", fromlist=["x"]).col("day").alias("centre_day"))
    ef = effect_feature_columns(ev)
    assert "is_treated" not in ef and "A_star" not in ef and "Y_star" not in ef and "U_t_minus_person_mean" in ef
    assert "is_treated" in effect_feature_columns(ev, compat=True)
