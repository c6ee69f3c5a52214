import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import language_model as M
from cohortflow.llm.queries import QUERIES
from tests.llm.helpers import SF, docs_frame, odd_rows, text_of, vocabulary, words

END = object()


def base(rows, held):
    tokens = [[*words(t), END] for _, t in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return n, [(len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws in tokens]


def run(df, held=None, **kw):
    return M.score(df, held if held is not None else F.col("doc_id") % 5 == 0, **kw)


def test_base_score_equals_brute_force_with_a_rare_tail(spark, monkeypatch):
    monkeypatch.setattr(M, "HEAD_SHARE", 0.004)                     # most tokens meet their counts in the join
    rng, vocab = random.Random(1), vocabulary(400)
    rows = [(i, text_of(rng, vocab, rng.randint(0, 9))) for i in range(120)]
    n, want = base(rows, [i % 5 == 0 for i, _ in rows])
    out = {r["doc_id"]: r for r in run(docs_frame(spark, rows).repartition(5)).collect()}
    for (i, _), (tokens, known, score) in zip(rows, want):
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, i % 5 == 0)
        assert r["base_score"] == pytest.approx(score)
        assert r["score"] < 0


def test_model_beats_the_base_on_held_out_text(spark):
    out = QUERIES["op9_language_model"](spark, SF.replace("0.001", "0.01")).toPandas()
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum() and (held.n_tokens.sum() > 10_000)
    assert np.isfinite(out.score).all() and (out.score < 0).all()


def test_class_probabilities_sum_to_one_and_tokens_to_at_most_one():
    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(M.BUCKETS, M.CLASSES)).astype(np.float32), rng.normal(size=M.CLASSES).astype(np.float32)
    s = M.Stream(["a few words here", "", "more"])
    rows = [r[:1] for r in s.features()]
    total = sum(math.exp(M.log_softmax_at(w, b, rows, np.array([k]))[0]) for k in range(M.CLASSES))
    assert total == pytest.approx(1, abs=1e-4)


def test_gradient_of_the_softmax():
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(M.BUCKETS, M.CLASSES)).astype(np.float32), np.zeros(M.CLASSES, dtype=np.float32)
    rows, label = [rng.integers(0, M.BUCKETS, 6) for _ in range(M.FEATURES)], np.array([0, 5, 5, 9, 63, 1])
    _, d = M.log_softmax_at(w, b, rows, label, True)
    eps = 1e-2
    for place, k in ((0, 0), (1, 7), (4, 63)):
        up, down = w.copy(), w.copy()
        up[rows[0][place], k] += eps
        down[rows[0][place], k] -= eps
        slope = (M.log_softmax_at(up, b, rows, label).sum() - M.log_softmax_at(down, b, rows, label).sum()) / (2 * eps)
        assert -slope == pytest.approx(d[place, k], abs=5e-3)


def random_softmax(rng):
    return M.Softmax(*(rng.normal(size=n).astype(np.float32) for n in ((M.BUCKETS, M.GROUPS), (M.BUCKETS * M.GROUPS, M.LEAVES), M.GROUPS, (M.GROUPS, M.LEAVES))))


def test_two_levels_equal_a_dense_loop_and_sum_to_one():
    m = random_softmax(np.random.default_rng(4))
    rows = M.Stream(["some words in a row", "", "x"]).features()
    for i in range(len(rows[0])):
        upper = m.upper_bias + sum(m.upper[r[i]] for r in rows).astype(float)
        total = 0.0
        for g in range(M.GROUPS):
            lower = m.lower_bias[g] + sum(m.lower[r[i] * M.GROUPS + g] for r in rows).astype(float)
            for k in range(M.LEAVES):
                want = math.exp(upper[g]) / np.exp(upper).sum() * math.exp(lower[k]) / np.exp(lower).sum()
                got = math.exp(m.log_probability([r[i:i + 1] for r in rows], np.array([g * M.LEAVES + k]))[0])
                assert got == pytest.approx(want, rel=1e-3)
                total += got
        assert total == pytest.approx(1, abs=1e-3)


def test_an_untrained_softmax_is_its_prior():
    prior = np.random.default_rng(5).uniform(1, 9, M.CLASSES)
    m = M.Softmax.of_prior(prior)
    p = [math.exp(m.log_probability([np.array([3])], np.array([k]))[0]) for k in range(M.CLASSES)]
    assert np.allclose(p, prior / prior.sum(), rtol=1e-4)


def test_weights_of_many_shards_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 2)
    monkeypatch.setattr(M, "PARTS", 4)
    monkeypatch.setattr(M, "BUCKETS", 8)
    rng = np.random.default_rng(6)
    rows = [(s, p, rng.normal(size=(2, M.GROUPS + M.CLASSES)).astype(np.float32), rng.integers(0, 9, (2, 1 + M.GROUPS)).astype(float)) for s in range(5) for p in range(4)]
    found = spark.createDataFrame([(s, p, bytearray(x.tobytes()), bytearray(n.tobytes())) for s, p, x, n in rows], "shard int, part int, weighted binary, seen binary")
    out = {r["part"]: r for r in M.merged_parts(found.repartition(3), 5).collect()}
    assert sorted(out) == [0, 1, 2, 3]
    for p, r in out.items():
        assert np.allclose(np.frombuffer(r["weighted"], dtype=np.float32), sum(x for _, q, x, _ in rows if q == p).ravel(), atol=1e-4)
        assert np.array_equal(np.frombuffer(r["seen"]), sum(n for _, q, _, n in rows if q == p).ravel())


def test_stream_ends_and_history():
    s = M.Stream(["A b", "", "b A b"])
    assert [int((s.doc == k).sum()) for k in range(3)] == [3, 1, 4]
    assert (s.token[[2, 3, 7]] == np.uint64(M.END)).all() and s.token[0] == s.token[5]
    rows = np.array(s.features())
    assert (rows[:, 0] == rows[:, 3]).all() and (rows[:, 0] == rows[:, 4]).all()        # every text begins alike


def test_a_repeated_training_text_scores_better(spark):
    rng, vocab = random.Random(3), vocabulary(200)
    common = text_of(rng, vocab, 6)
    rows = [(5 * i + 1, common if i % 2 else text_of(rng, vocab, 6)) for i in range(60)] + [(1000, common), (1005, text_of(rng, vocab, 6))]
    out = {r["doc_id"]: r["score"] / r["n_tokens"] for r in run(docs_frame(spark, rows)).collect()}
    assert out[1000] > out[1005]


def test_odd_rows_and_clashing_columns(spark):
    df = docs_frame(spark, odd_rows())
    for c in ("held_out", "token", "prefix", "c", "rid", "tail", "logs", "n_tokens"):
        df = df.withColumn(c, F.lit("clash"))
    out = run(df, F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))).collect()
    assert len(out) == len(odd_rows())
    assert {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert len({(r["score"], r["n_known"]) for r in out if r["doc_id"] == 4}) == 1
    assert next(r for r in out if r["doc_id"] == 8)["n_tokens"] == 60_001


def test_no_training_rows_and_no_rows(spark):
    (r,) = run(docs_frame(spark, [(5, "a b")]), F.lit(True)).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] <= 0
    assert run(docs_frame(spark, [])).count() == 0


def test_every_training_document_is_fitted_in_shards_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_TOKENS", 5_000)
    fit, seen = M.fit, {}

    def spy(train, *args, **kw):
        seen.update(rows=train.count(), shards=kw["shards"] if "shards" in kw else M.SHARDS)
        return fit(train, *args, **kw)

    monkeypatch.setattr(M, "fit", spy)
    rows = [(i, f"w{i % 7} w{i % 11} x") for i in range(20_000)]
    out = run(docs_frame(spark, rows)).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert seen == {"rows": 16_000, "shards": 13} and out["s"] > out["b"]      # 64,000 tokens


def test_row_sums_equal_a_loop():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.integers(0, 40, 300), rng.integers(40, M.BUCKETS, 300), np.full(50, M.BUCKETS - 1)])
    delta = rng.normal(size=(len(rows), M.CLASSES)).astype(np.float32)
    row, many, total = M.row_sums(rows, delta)
    assert row.tolist() == sorted(set(rows.tolist())) and many.sum() == len(rows)
    for r, n, t in zip(row, many, total):
        assert n == (rows == r).sum() and np.allclose(t, delta[rows == r].sum(axis=0), atol=1e-4)


def test_classes_by_table_and_by_search_equal_a_loop():
    rng = np.random.default_rng(9)
    prefix_class = rng.integers(0, M.CLASSES, M.END_PREFIX)
    for shift in (0, 40):                                           # shifted tokens share all their last bits
        token = np.unique(rng.integers(1, 1 << 23, 40).astype(np.uint64)) << np.uint64(shift)
        classes = M.Classes(token, np.arange(len(token)), prefix_class)
        assert (classes.slot is None) == (shift == 40)
        some = np.concatenate([token, token ^ np.uint64(1 << 63), rng.integers(0, 1 << 62, 200).astype(np.uint64)])
        prefix = rng.integers(0, M.END_PREFIX + 1, len(some))
        own = {int(t): k for k, t in enumerate(token)}
        assert classes(some, prefix).tolist() == [own.get(int(t), int(prefix_class[min(p, M.END_PREFIX - 1)])) for t, p in zip(some, prefix)]
    assert M.Classes(token[:0], np.arange(0), prefix_class)(some, prefix).tolist() == prefix_class[np.minimum(prefix, M.END_PREFIX - 1)].tolist()


def test_row_sums_of_repeated_deltas_in_wide_rows_equal_a_loop():
    rng = np.random.default_rng(10)
    delta = rng.normal(size=(300, 4)).astype(np.float32)
    for apart in (1, 1 << 40):                                      # packed in 32 bits, and in 64
        rows = np.minimum(rng.zipf(1.5, 900), 50) * apart
        row, many, total = M.row_sums(rows, delta)
        place = np.arange(900) % 300
        assert row.tolist() == sorted(set(rows.tolist()))
        for r, n, t in zip(row, many, total):
            assert n == (rows == r).sum() and np.allclose(t, delta[place[rows == r]].sum(axis=0), atol=1e-4)


def test_frequent_rows_are_summed_and_put_whole():
    rng = np.random.default_rng(11)
    delta = rng.normal(size=(200, 3)).astype(np.float32)
    rows = np.minimum(rng.zipf(1.4, 1000), 300)
    row, many, total = M.row_sums(rows, delta)
    assert many.min() == 1 and many.max() > 16
    for r, n, t in zip(row, many, total):
        hit = (np.arange(1000) % 200)[rows == r]
        assert n == len(hit) and np.allclose(t, delta[hit].sum(axis=0), atol=1e-4)
    table = np.zeros((400, 3), dtype=np.float32)
    M.put_rows(table, row, total)
    assert np.array_equal(table[row], total) and not np.delete(table, row, axis=0).any()


def test_softmax_of_large_logits_equals_double_precision():
    rng = np.random.default_rng(12)
    for size in (1, 60, 500):
        w = np.zeros((4, 16), dtype=np.float32)
        b = (size * rng.choice([-1, 1], 16) * np.append(1, rng.random(15))).astype(np.float32)
        label = np.arange(16)
        got, delta = M.log_softmax_at(w, b, [label % 4], label, True)
        want = b.astype(float) - (b.max() + np.log(np.exp(b.astype(float) - b.max()).sum()))
        assert np.allclose(got, want, rtol=1e-4, atol=1e-3) and np.allclose(delta, np.exp(want) - np.eye(16), atol=1e-4)


def test_seen_rows_of_a_trainer_equal_a_loop():
    rng = np.random.default_rng(13)
    m = random_softmax(rng)
    trainer = M.Trainer(m, 0.05)
    rows, label = [rng.integers(0, 30, 400) for _ in range(M.FEATURES)], rng.integers(0, M.CLASSES, 400)
    for _ in range(2):
        trainer.update(rows, label)
    want = np.zeros((M.BUCKETS, M.GROUPS))
    for r in rows:
        for bucket, leaf in zip(r, label):
            want[bucket, leaf // M.LEAVES] += 2
    assert np.array_equal(trainer.seen.reshape(want.shape), want)
    moved = np.flatnonzero((trainer.model.lower != m.lower).any(axis=1))
    assert set(moved) <= set(np.flatnonzero(want.ravel())) and len(moved) > 100
