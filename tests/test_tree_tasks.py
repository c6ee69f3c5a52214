import datetime as dt

import numpy as np
import pytest

import __spark_entry__ as E
from cohortflow.operators import hist_trees as H
from cohortflow.operators import tree_tasks as T


def settings_of(monkeypatch, query):
    class Seen(Exception):
        pass

    def cv_hist(df, features, label, fold, keys, settings, seed=42):
        raise Seen(settings)

    monkeypatch.setattr(E, "_tree_rows", lambda spark, sf: None)
    monkeypatch.setattr(E.ht, "cv_hist", cv_hist)
    with pytest.raises(Seen) as got:
        query(None, None)
    return got.value.args[0]


def test_forest_grid_is_the_published_one(monkeypatch):
    got = settings_of(monkeypatch, E.q_m10_forest)
    assert len(got) == len({str(s) for s in got}) == 243
    assert {s.trees for s in got} == {250, 500, 1000} and {s.max_depth for s in got} == {None, 10, 18}


def test_boosting_draw_is_from_the_published_grid(monkeypatch):
    got = settings_of(monkeypatch, E.q_f06_boosting)
    assert len(got) == len({str(s) for s in got}) == 80 and all(s.boosted for s in got)
    assert {s.trees for s in got} == {250, 500, 1000} and {s.max_depth for s in got} == {3, 7, 11}


def blocks(folder, x, y, w=None, size=1000):
    b = T.Blocks(str(folder))
    for i in range(0, len(y), size):
        j = slice(i, i + size)
        b.add(x=x[j], y=y[j], w=(np.ones(len(y), dtype=np.uint8) if w is None else w)[j], t=y[j])
    return b


def test_trees_without_a_depth_grow_until_nothing_can_be_cut(tmp_path):
    rng = np.random.default_rng(1)
    x = np.array(np.meshgrid(*[np.arange(6)] * 3), dtype=np.uint8).reshape(3, -1).T.copy()
    y = rng.normal(size=len(x))
    b = blocks(tmp_path, x, y)
    f, _, _, _, value, _ = T.grow(b, H.Setting(1, None, bootstrap=False), 3, 6, 1, 0, H.HELD)
    assert np.allclose(value[b.get(0, "node")[0]], y) and (f < 0).sum() == len(x)


def test_files_groups_of_nodes_and_blocks_change_nothing(tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    x, y, w = rng.integers(0, 9, (700, 5)).astype(np.uint8), rng.integers(-9, 9, 700) / 4, rng.integers(0, 3, 700).astype(np.uint8)
    for s in (H.Setting(1, None, subset="sqrt"), H.Setting(1, 6, min_leaf=3, min_split=9, subset=0.7), H.Setting(1, 5, boosted=True, l1=0.5, l2=1.0, per_tree=0.6)):
        use = (w > 0).astype(np.uint8) if s.boosted else w
        want = T.grow(blocks(tmp_path, x, y, use), s, 5, 9, 3, 4, H.HELD)
        monkeypatch.setattr(T, "KEPT_BYTES", 0)
        monkeypatch.setattr(T, "CUT_NODES", 3)
        (tmp_path / f"files{s.max_depth}").mkdir()
        b = blocks(tmp_path / f"files{s.max_depth}", x, y, use, 64)
        assert b.size == 0 and len(b) == 11
        got = T.grow(b, s, 5, 9, 3, 4, 600)
        monkeypatch.undo()
        assert all(np.allclose(a, c) for a, c in zip(want, got))


def test_cuts_of_many_nodes_equal_those_of_one():
    rng = np.random.default_rng(3)
    for s in (H.Setting(min_leaf=2, min_split=5), H.Setting(boosted=True, l1=0.5, l2=2.0)):
        w = rng.integers(0, 3, (40, 4, 7)).astype(float)
        w[:, 1:] = w[:, :1]
        t = w * rng.normal(size=(40, 1, 7))
        total = np.stack([w[:, 0].sum(axis=1), t[:, 0].sum(axis=1), np.full(40, 100.0)])
        got = T.best_cuts(w, t, total, s)
        for i in range(40):
            want = H.best_cut(np.stack([w[i], t[i], np.full((4, 7), 100 / 7)]), s, np.ones(4, dtype=bool))
            assert got[0][i] == want[0] and got[3][i] == pytest.approx(want[3])
            if want[0] >= 0:
                assert (got[1][i], got[2][i], got[4][i], got[5][i]) == pytest.approx((want[1], want[2], want[4], want[5]))


def forest_rows(spark, n=900):
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 5, n).astype(float), rng.normal(size=n), rng.normal(size=n)
    y = 2 * (a > 2) + 3 * (b > 0.3) + rng.normal(size=n) * 0.2
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y)], "a double, b double, c double, y double").repartition(3)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).select("features", "y")


def test_forest_is_a_spark_model_that_learns_and_persists_no_rows(spark, tmp_path):
    from cohortflow.operators import trees as tr
    df, before = forest_rows(spark), set(spark.sparkContext._jsc.getPersistentRDDs())
    model = tr.fit_forest(df, "y", 40, 6, 3, "sqrt")
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before
    assert model.getNumTrees == 40 and model.numFeatures == 3 and model.getOrDefault("minInstancesPerNode") == 3
    imp = model.featureImportances.toArray()
    assert imp.sum() == pytest.approx(1) and imp[2] < 0.1 < imp[0] < imp[1]
    got = model.transform(df).selectExpr("avg(pow(y - prediction, 2)) AS e", "var_pop(y) AS v").first()
    assert got["e"] < 0.1 * got["v"]
    model.write().overwrite().save(f"{tmp_path}/m")
    again = type(model).load(f"{tmp_path}/m")
    assert again.transform(df).exceptAll(model.transform(df)).count() == 0


def test_one_whole_tree_equals_spark_ml(spark):
    from cohortflow.operators import trees as tr
    from pyspark.ml.regression import DecisionTreeRegressor
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(6)
    rows = [tuple(map(float, (*rng.integers(0, 7, 3), rng.integers(-50, 50) / 8))) for _ in range(300)]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, c double, y double"))
    want = DecisionTreeRegressor(labelCol="y", maxDepth=4, minInstancesPerNode=4).fit(df)
    got = tr.fit_forest(df, "y", 1, 4, 4, "all")
    p, q = (np.array([r[0] for r in m.transform(df).select("prediction").collect()]) for m in (want, got))
    assert np.allclose(p, q) and np.allclose(want.featureImportances.toArray(), got.featureImportances.toArray())


def test_features_of_a_node_follow_spark_ml():
    from cohortflow.operators import trees as tr
    assert [tr._looked_at(s, 74, 5) for s in ("auto", "all", "onethird", "sqrt", "log2", "0.7", "5", "1.0")] == [25, 74, 25, 9, 7, 52, 5, 74]
    assert tr._looked_at("auto", 74, 1) == 74


def small_events(spark, path):
    start = dt.datetime(2024, 1, 1)
    kinds = ["view", "click", "purchase", "error", "signup"]
    rows = [(u * 100 + d, start + dt.timedelta(days=d, minutes=u), u, kinds[(u + d) % 5], float((u * 7 + d * 13) % 100), '{"k": 3}') for u in range(20) for d in range(8)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path), lambda: set(spark.sparkContext._jsc.getPersistentRDDs())


def test_importance_keeps_no_rows_in_executors(spark, tmp_path):
    sf, kept = small_events(spark, tmp_path)
    before = kept()
    got = E.q_m05(spark, sf).collect()
    assert 0 < len(got) <= 20 and all(r["importance"] >= 0 for r in got) and kept() == before


def test_interval_keeps_no_rows_in_executors(spark, tmp_path):
    sf, kept = small_events(spark, tmp_path)
    before = kept()
    got = E.q_m06(spark, sf).collect()
    assert got and kept() == before
    assert all(r["y_pred_abs_ci_low"] <= r["y_pred_abs"] <= r["y_pred_abs_ci_high"] for r in got)


def test_saved_forest_predicts_the_same_and_keeps_no_rows(spark, tmp_path):
    sf, kept = small_events(spark, tmp_path)
    before = kept()
    got = E.q_s9(spark, sf).collect()
    assert got and kept() == before and all(r["p_saved"] == r["p_loaded"] for r in got)


def test_explained_rows_of_one_file_are_dealt_to_all_cores(spark):
    from pyspark import TaskContext
    from pyspark.sql import functions as F
    from cohortflow.operators.explain import permutation_shapley
    rows = spark.range(400).select(F.col("id").alias("_rid"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).coalesce(1)

    def own(x, background, perm):
        return np.full(x.shape, float(TaskContext.get().partitionId()))

    got = permutation_shapley(None, rows, ["a", "b"], [0.0, 0.0], n_perm=2, per_row=True, contributions=own).collect()
    assert len(got) == 800 and len({r["phi"] for r in got}) >= spark.sparkContext.defaultParallelism


def test_contributions_of_many_permutations_and_features(monkeypatch):
    from cohortflow.operators import trees as tr
    from cohortflow.operators.explain import permutations, shapley_rows
    from tests.test_contributions import forest
    monkeypatch.setattr(tr, "SLICE", 7)
    for k, p, depth in ((6, 20, 6), (130, 9, 5), (3, 1, 8)):
        rng = np.random.default_rng(k)
        trees, perm = forest(rng, 5, k, depth), permutations(k, p, 1)
        x, bg = rng.normal(size=(16, k)), rng.normal(size=k) * 0.2
        assert trees.contributions(x, bg, perm) == pytest.approx(shapley_rows(trees.mean, x, bg, perm), abs=1e-12)


def test_boosting_leaves_no_rows_cached(spark, tmp_path):
    sf, kept = small_events(spark, tmp_path)
    before = kept()
    got = E.q_m07(spark, sf).collect()
    assert len(got) == 1 and got[0]["n"] > 0 and 1 <= got[0]["iterations"] <= 300 and kept() == before
