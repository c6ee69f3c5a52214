import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import neardup as N

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine=0.9):
    ok = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, dtype=np.float32).astype(np.float64)
            ok[i] = x / np.linalg.norm(x)
    links = {i: 0 for i, _ in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(ok)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            if len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i in links}


def vectors(seed=1, n=300, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    near = [x[rng.integers(n)] + rng.normal(size=dim) * 0.12 * rng.random() for _ in range(60)]
    hot = [x[0] + rng.normal(size=dim) * 0.22 * rng.random() for _ in range(150)]
    edge = []
    for _ in range(60):                                            # cosines close to the threshold, on either side
        a = rng.normal(size=dim)
        a /= np.linalg.norm(a)
        b = rng.normal(size=dim)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9 + rng.normal() * 0.02
        edge += [a * 3, (c * a + np.sqrt(1 - c * c) * b) * 0.5]
    out = np.concatenate([x, near, hot, edge, x[:5]]).astype(np.float32)
    ids = rng.permutation(5000)[:len(out)]
    return [(int(i), [float(c) for c in v]) for i, v in zip(ids, out)]


def got(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in N.near_duplicates(df).collect()}


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    rows = vectors()
    want, have = brute(rows), got(spark, rows)
    total, found = sum(v[0] for v in want.values()), sum(v[0] for v in have.values())
    assert have.keys() == want.keys() and all(have[i][0] <= want[i][0] for i in want)      # no link below the threshold
    assert found >= 0.995 * total
    assert sum(have[i] == want[i] for i in want) >= 0.98 * len(want)


def test_calibration_keeps_its_promise():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1200, 64))
    a[:300] = a[0] + rng.normal(size=(300, 64)) * 0.1                # a dense region moves the medians
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    p, tables = N.calibrate(a, 8, 0.9)
    lines = N._lines(64, tables * 9)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    medians = {64: np.median(a @ lines, axis=0)}
    ca, va = N._cells(a, 64, tables * 9, medians, tables, 8)
    cb, vb = N._cells(b, 64, tables * 9, medians, tables, 8)
    hits = ((ca == cb) & (np.abs(va - vb) <= N.WINDOW)).sum(axis=1)
    assert (hits >= N.COUNT).mean() > 0.99
    assert hits.mean() == pytest.approx(p.mean() * tables, rel=0.1)


def test_odd_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [1.0, 2.0, 0.0]),
            (11, [-1.0, -2.0]), (12, [1e30, 2e30]), (13, [1e-30, 2e-30])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows] + [(7, [1.0, 2.0], 1), (None, [5.0, -1.0], 0)], SCHEMA)
    for c in ("key", "unit", "dim", "obj", "grp", "n_links", "component_id", "cell"):
        df = df.withColumn(c, F.lit("clash"))
    out = N.near_duplicates(df).collect()
    assert len(out) == 15
    want = brute(rows)
    for r in out:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == want[r["vec_id"]], r


def test_no_rows(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
