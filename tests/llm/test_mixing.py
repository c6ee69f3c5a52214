import re

import pytest

from cohortflow.llm import mixing
from cohortflow.llm.queries import ORACLE
from tests.llm.helpers import docs_frame, odd_rows


def target_of(sizes, weights=(1, 2, 3)):
    """Sources in code point order, null last; excess over three times a source reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def run(df):
    return mixing.mix(df).collect()


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", ["b", "a", None, "big", "tiny", "zero"][i % 6 if i % 3 else 3]) for i in range(600)]
    rows += [(1000, "w", "en", "tiny"), (1001, "", "en", "none"), (1002, None, "en", "none")]
    out = run(docs_frame(spark, rows))
    sizes, taken, largest = {}, {}, {}
    for (i, text, _, source), in zip(rows):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
    goal = target_of(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    assert len(out) == len(rows)
    for s, t in goal.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6


def test_reruns_and_row_order_agree(spark):
    rows = [(i, "word " * (i % 17), "en", f"s{i % 5}") for i in range(300)]
    a = sorted((r["doc_id"], r["taken"]) for r in run(docs_frame(spark, rows)))
    b = sorted((r["doc_id"], r["taken"]) for r in run(docs_frame(spark, rows[::-1]).repartition(5)))
    assert a == b


def test_odd_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = docs_frame(spark, odd_rows())
    for c in ("size", "hash", "target", "w", "copies", "bound", "s_source", "prefix", "rest"):
        df = df.withColumn(c, F.lit("clash"))
    out = run(df)
    assert len(out) == len(odd_rows())
    assert all(r["size"] == 0 and r["taken"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert len({r["taken"] for r in out if r["doc_id"] == 4}) == 1
    assert mixing.sample(df).columns == df.columns


def test_empty_table_and_all_empty_texts(spark):
    assert run(docs_frame(spark, [])) == []
    out = run(docs_frame(spark, [(1, None), (2, "")]))
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0)] * 2


def test_sample_repeats_rows_as_the_mix_says(spark):
    rows = [(i, "w " * (1 + i % 9), "en", ["small", "large"][i % 10 > 0]) for i in range(200)]
    df = docs_frame(spark, rows)
    wanted = {r["doc_id"]: r["copies"] for r in run(df) if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in mixing.sample(df).groupBy("doc_id").count().collect()}
    assert got == wanted


def test_main_path_has_no_python(spark):
    plan = mixing.mix(docs_frame(spark, [(1, "a b", "en", "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "op7_mixing" in ORACLE
