import random

import numpy as np

from cohortflow.llm.common import Words, combine, slices
from cohortflow.llm.graph import components
from tests.llm.helpers import vocabulary, words


def test_words_equal_the_split_of_python():
    rng, vocab = random.Random(4), vocabulary(50) + ["É", "ÀB", "x y", "A.b"]
    texts = ["", " ", "\x0b\x0c", "A", " lead", "trail ", *[rng.choice([" ", "\n", " \t "]).join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(200)]]
    w = Words(texts)
    expect = [words(t) for t in texts]
    assert w.count.tolist() == [len(e) for e in expect]
    flat = [x for e in expect for x in e]
    assert [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end)] == flat
    by_hash = {}
    for h, x in zip(w.hash.tolist(), flat):
        assert by_hash.setdefault(x, h) == h
    assert len(set(by_hash.values())) == len(by_hash)
    alone = Words([texts[-1]])                         # a word's hash does not depend on its place
    assert alone.hash.tolist() == w.hash[-len(alone.hash):].tolist()


def test_combine_depends_on_order_and_length():
    x = np.array([1, 2, 2, 1, 1, 2, 3], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = combine(x, np.array([0, 2, 4]))
    assert len(set(h.tolist())) == 3
    assert combine(x[:2], np.array([0]))[0] == h[0]


def test_slices_cover_everything_once():
    texts = ["a" * n for n in (5, 0, 7, 30, 1, 1)]
    assert list(slices(texts, 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(slices([], 10)) == []


def test_components_of_stars_chains_and_random_edges(spark):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(60)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(70)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent if x != 500}


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
