import numpy as np
import pytest

from cohortflow.operators import trees as tr
from cohortflow.operators.explain import permutations, shapley_rows


def forest(rng, n_trees=7, k=6, depth=5):
    """Random trees as flat arrays, a feature more than once on a path."""
    f, t, left, right, v, roots = [], [], [], [], [], []

    def grow(d):
        at = len(f)
        for c, x in zip((f, t, left, right, v), (-1, np.nan, -1, -1, rng.normal())):
            c.append(x)
        if d and rng.random() < 0.9:
            f[at], t[at] = int(rng.integers(k)), rng.normal() * 0.7
            left[at] = grow(d - 1)
            right[at] = grow(d - 1)
        return at

    for _ in range(n_trees):
        roots.append(grow(depth))
    return tr.FlatTrees(*(np.array(c) for c in (f, t, left, right, v, roots)))


def test_contributions_equal_those_of_hybrid_vectors(monkeypatch):
    monkeypatch.setattr(tr, "RANGES", 300)                          # several slices
    rng = np.random.default_rng(3)
    trees, perm = forest(rng), permutations(6, 5, 42)
    x, bg = rng.normal(size=(40, 6)), rng.normal(size=6) * 0.2
    x[0], x[1, 2], x[2, :] = bg, np.nan, 9.0
    got = trees.contributions(x, bg, perm)
    assert got == pytest.approx(shapley_rows(trees.mean, x, bg, perm), abs=1e-12)
    assert not got[0].any()
    assert got.sum(axis=1) == pytest.approx(trees.mean(x) - trees.mean(bg[None])[0], abs=1e-12)
    assert trees.contributions(x[:0], bg, perm).shape == (0, 6)
