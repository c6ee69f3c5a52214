"""Event windows against a brute-force implementation of the same rules (loops over ids)."""

import numpy as np
import pandas as pd

from cohortflow.config import EventConfig
from cohortflow.operators import events as evo


def brute_treated(pdf, L, H, codes=(1, 2)):
    out = []
    for pid, g in pdf.groupby("id"):
        g = g.sort_values("day")
        coded = g[(g.is_treated == 1) & g.treatment_type.isin(codes)]["day"].tolist()
        eps, start, prev = [], None, None
        for d in coded:
            if start is None:
                start = prev = d
            elif d == prev + 1:
                prev = d
            else:
                eps.append((start, prev))
                start = prev = d
        if start is not None:
            eps.append((start, prev))
        for s, e in eps:
            pre, course, post = range(s - L, s), range(s, e + 1), range(e + 1, e + H + 1)
            if s - L < g.day.min() or e + H > g.day.max():
                continue
            wp, wc, wo = g[g.day.isin(pre)], g[g.day.isin(course)], g[g.day.isin(post)]
            if len(wp) != L or len(wc) != len(course) or len(wo) != H:
                continue
            if wp.is_treated.sum() != 0 or ((wc.is_treated != 1) | ~wc.treatment_type.isin(codes)).any():
                continue
            if ((wo.is_treated == 1) & wo.treatment_type.isin(codes)).any():
                continue
            if wp.U_t.isna().any() or wc.U_t.isna().any() or wo.U_t.isna().any():
                continue
            out.append((pid, s, e, float(wo.U_t.mean() - wp.U_t.iloc[-1])))
    return sorted(out)


def brute_control(pdf, L, H):
    out = []
    for pid, g in pdf.groupby("id"):
        g = g.sort_values("day")
        for c in g.day:
            if g[g.day == c].is_treated.iloc[0] != 0 or c - L < g.day.min() or c + H > g.day.max():
                continue
            w = g[g.day.between(c - L, c + H)]
            if len(w) != L + H + 1 or w.is_treated.sum() != 0 or w.U_t.isna().any():
                continue
            out.append((pid, c, float(w[w.day > c].U_t.mean() - w[w.day < c].U_t.iloc[-1])))
    return sorted(out)


def _micro(spark, seed=0, n_ids=12, days=25):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_ids):
        for d in range(1, days + 1):
            if rng.random() < 0.1:
                continue                                       # day gaps
            t = int(rng.random() < 0.3)
            rows.append((i, d, t, int(rng.choice([0, 1, 2])) if t else None,
                         None if rng.random() < 0.05 else float(rng.uniform(0, 10))))
    rows.append((99, 1, 1, 1, 5.0))                            # treated on the first row
    rows += [(99, d, 0, None, 4.0) for d in range(2, 6)]
    pdf = pd.DataFrame(rows, columns=["id", "day", "is_treated", "treatment_type", "U_t"])
    return pdf, spark.createDataFrame(rows, "id long, day int, is_treated int, treatment_type int, U_t double")


def test_treated_and_control_equal_brute_force(spark):
    pdf, df = _micro(spark)
    for L, H in ((1, 1), (2, 3), (3, 2)):
        got = sorted((r.id, r.episode_start, r.episode_end, r.Y_star) for r in evo.treated_events(df, EventConfig(L=L, H=H)).collect())
        exp = brute_treated(pdf, L, H)
        assert [g[:3] for g in got] == [e[:3] for e in exp]
        np.testing.assert_allclose([g[3] for g in got], [e[3] for e in exp])
        got_c = sorted((r.id, r.centre_day, r.Y_star) for r in evo.control_events(df, EventConfig(L=L, H=H)).collect())
        exp_c = brute_control(pdf, L, H)
        assert [g[:2] for g in got_c] == [e[:2] for e in exp_c]
        np.testing.assert_allclose([g[2] for g in got_c], [e[2] for e in exp_c])


def test_episodes_codes_and_max_controls(spark):
    rows = [(1, d, t, c, 1.0) for d, t, c in [(1, 0, None), (2, 1, 1), (3, 1, 2), (4, 1, 0), (5, 1, 1), (6, 0, None), (8, 1, 2)]]
    df = spark.createDataFrame(rows, "id long, day int, is_treated int, treatment_type int, U_t double")
    eps = sorted((r.episode_start, r.episode_end) for r in evo.treatment_episodes(df).collect())
    assert eps == [(2, 3), (5, 5), (8, 8)]                    # code 0 breaks the course
    pdf, d2 = _micro(spark, seed=4)
    c = evo.control_events(d2, EventConfig(L=1, H=1, max_controls_per_id=2)).toPandas()
    assert c.groupby("id").size().max() <= 2
    full = evo.control_events(d2, EventConfig(L=1, H=1)).toPandas().sort_values(["id", "centre_day"])
    first2 = full.groupby("id").head(2)
    assert sorted(zip(c.id, c.centre_day)) == sorted(zip(first2.id, first2.centre_day))


def test_support_and_weights(spark):
    pdf, df = _micro(spark, seed=2)
    ev = evo.event_table(df, EventConfig(L=1, H=1))
    w = evo.with_event_weight(ev).toPandas()
    assert np.allclose(w.groupby("id")["w_event"].sum(), 1.0)
    sup = evo.cluster_support(ev).first()
    t = ev.toPandas()
    counts = t[t.A_star == 1].groupby("id").size().to_numpy()
    assert sup.G == len(counts)
    assert np.isclose(sup.G_eff, 1.0 / np.sum((counts / counts.sum()) ** 2))
    assert sup.G_eff <= sup.G + 1e-9


def test_event_table_is_one_scan_and_one_exchange(spark):
    from cohortflow.config import EventConfig
    from cohortflow.operators import events as evo
    rows = [(i, d, int(d in (6, 7)), 1, float(d % 5)) for i in range(6) for d in range(1, 16)]
    df = spark.createDataFrame(rows, "id long, day int, is_treated int, treatment_type int, U_t double").repartition(3)
    plan = evo.event_table(df, EventConfig(L=2, H=2))._jdf.queryExecution().sparkPlan().toString()
    out = evo.event_table(df, EventConfig(L=2, H=2))
    whole = out._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange hashpartitioning(id") == 1 and "Aggregate" not in whole and plan.count("Scan") == 1
    t, c = evo.treated_events(df, EventConfig(L=2, H=2)), evo.control_events(df, EventConfig(L=2, H=2))
    key = lambda d: sorted(tuple(r) for r in d.select("id", "centre_day", "A_star", "Y_star", "episode_len").collect())
    assert key(out) == key(t.unionByName(c))
