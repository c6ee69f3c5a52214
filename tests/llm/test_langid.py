import numpy as np
from pyspark.sql import functions as F

from cohortflow.llm import langid as L
from cohortflow.llm.queries import QUERIES
from tests.llm.helpers import SF, docs_frame, odd_rows


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    h, langs, steps, width = 3, 2, 5, 4
    p = {"xf": rng.normal(size=(3 * h, 256)), "xb": rng.normal(size=(3 * h, 256)), "uf": rng.normal(size=(3 * h, h)), "ub": rng.normal(size=(3 * h, h)),
         "w": rng.normal(size=(langs, 2 * h)), "b": np.zeros((langs, 1))}
    byte = rng.integers(97, 100, (steps, width)).astype(np.uint8)
    on = np.ones((steps, width))
    on[3:, 1] = 0
    label = np.array([0, 1, 1, 0])

    def loss():
        q = L._softmax(L._logits({k: v.astype(np.float64) for k, v in p.items()}, byte, on)[1])
        return -(np.log(q[:, label, np.arange(width)]) * on).sum() / on.sum()

    kf, kb = [], []
    _, logits = L._logits(p, byte, on, kf, kb)
    d = L._softmax(logits)
    d[:, label, np.arange(width)] -= 1
    d *= (on / on.sum())[:, None, :]
    back = np.matmul(p["w"].T, d)
    got = dict(zip(("xf", "uf"), L._layer_back(p["uf"], byte, on, kf, back[:, :h]))) | dict(zip(("xb", "ub"), L._layer_back(p["ub"], byte, on, kb, back[:, h:])))
    for name, at in (("xf", (0, 97)), ("xf", (4, 98)), ("xb", (7, 99)), ("uf", (2, 1)), ("uf", (8, 0)), ("ub", (5, 2))):
        eps, keep = 1e-2, p[name][at]
        p[name][at] = keep + eps
        up = loss()
        p[name][at] = keep - eps
        down = loss()
        p[name][at] = keep
        assert abs((up - down) / (2 * eps) - got[name][at]) < 2e-3


def test_probabilities_use_every_byte_of_every_window():
    windows = [(("abc " * 16).encode(), "x"), (("xyz " * 16).encode(), "y")] * 20
    m = L.fit(windows, hidden=4, steps=60, batch=16)
    texts = ["abc " * 500, "xyz " * 3, "abc " * 100 + "xyz " * 300, "", "a"]
    p = L.probabilities(m, texts)
    assert p[0, 0] > 0.9 and p[1, 1] > 0.9 and 0.6 < p[2, 1] < 0.9 and (p[3] == 0).all()
    assert np.allclose(p[[0, 1, 2, 4]].sum(axis=1), 1, atol=1e-5)
    assert np.allclose(L.probabilities(m, texts[:1])[0], p[0], atol=1e-5)


def test_held_out_accuracy(spark):
    out = QUERIES["op1_language"](spark, SF.replace("0.001", "0.01")).join(spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").toPandas()
    assert len(held) > 150 and (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert held["score"].between(0, 1).all()


def test_odd_rows_and_clashing_columns(spark):
    df = docs_frame(spark, odd_rows() + [(30, "12 34 !!")])
    for c in ("lang_pred", "score", "letters", "parts"):
        df = df.withColumn(c, F.lit("clash"))
    m = L.train(df.withColumn("lang", F.when(F.col("doc_id") == 8, "aa").when(F.col("doc_id") != 5, "bb")), steps=5)
    assert m.langs == ["aa", "bb"]
    out = {(r["doc_id"]): r for r in L.predict(df, m).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3, 30))
    assert all(out[i]["lang_pred"] in ("aa", "bb") for i in (4, 5, 8, None))


def test_without_labels_and_without_rows(spark):
    df = docs_frame(spark, [(1, "some text")])
    none = L.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert [r["lang_pred"] for r in L.predict(df, none).collect()] == ["und"]
    one = L.train(df)
    assert [r["lang_pred"] for r in L.predict(df, one).collect()] == ["en"]
    empty = docs_frame(spark, [])
    assert L.predict(empty, L.train(empty)).count() == 0
