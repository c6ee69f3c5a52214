import hashlib

import numpy as np
import pytest

from cohortflow.llm import clustering as C

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and None not in v and np.isfinite(v).all()]
    name = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cen = [list(v) for _, v in sorted(kept, key=name)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cen))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cen)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cen[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [near(v) for _, v in kept]
    per = {j: sum(d for d, c in found if c == j) for j in range(len(cen))}
    return sorted(((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, cen[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, found)), key=str)


def got(spark, rows, **kw):
    out = C.cluster(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3), **kw)
    return sorted((tuple(r)[:6] for r in out.collect()), key=str)


def clustered(n=300, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    places = rng.normal(size=(7, dims)) * 4
    return [(int(i), [float(x) for x in (places[i % 7] + rng.normal(size=dims) * 0.2)]) for i in range(n)]


@pytest.mark.parametrize("rounds", [0, 3])
def test_equals_brute_force(spark, rounds):
    rows = clustered()
    rows += rows[:20] + [(10_000 + i, rows[0][1]) for i in range(150)]              # repeated rows, a hot group of copies
    assert got(spark, rows, k=9, rounds=rounds, dims=6, n_pivots=4) == brute(rows, 9, rounds, 6)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(12)]                               # two places, five centroids
    out = got(spark, rows, k=5, rounds=4, dims=2)
    assert out == brute(rows, 5, 4, 2)
    assert len({r[1] for r in out}) == 2


def test_odd_vectors_are_left_out(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [0.5, 0.5]), (7, [-0.001, 3.0]), (7, [2.0, 2.0])]
    out = got(spark, rows, k=4, rounds=2, dims=2)
    assert out == brute(rows, 4, 2, 2)
    assert {r[0] for r in out} == {None, 7}


def test_huge_components_count_as_the_largest(spark):
    out = got(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 0.0])], k=1, rounds=1, dims=2)
    assert [r[2] for r in out] == [(C.LARGEST) ** 2, C.LARGEST ** 2, 0]


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, [], k=3, dims=2) == []
    df = spark.createDataFrame([(1, [0.0, 1.0], 9, "x")], "vec_id bigint, embedding array<float>, cluster int, distance string")
    assert [tuple(r)[:3] for r in C.cluster(df, k=3, dims=2).collect()] == [(1, 0, 0)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    places = rng.integers(-2000, 2000, (30, 16))
    v = (places[rng.integers(0, 30, 4000)] + rng.integers(-20, 20, (4000, 16))).astype(np.int64)
    pivots = C.far_apart(places, 8)
    p = C.Pruner(places, pivots)
    x = C.pivot_distances(v, pivots)
    true = ((v[:, None, :] - places[None]) ** 2).sum(axis=2)
    assert (p.lower(x) ** 2 <= true).all()
    cluster, distance, compared = p.assign(v, x)
    assert (cluster == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
    assert compared < 10 * len(v)                                                     # of 30 centroids a vector


def test_one_pivot_place_falls_back_to_the_triangle():
    p = C.Pruner(np.array([[0, 0], [5, 0]]), C.far_apart(np.zeros((3, 2), dtype=np.int64), 4))
    cluster, distance, _ = p.assign(np.array([[1, 0], [4, 1]]), C.pivot_distances(np.array([[1, 0], [4, 1]]), p.pivots))
    assert cluster.tolist() == [0, 1] and distance.tolist() == [1, 2]
