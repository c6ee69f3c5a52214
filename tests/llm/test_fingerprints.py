import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from cohortflow.llm import fingerprints as fp
from tests.llm.helpers import docs_frame, odd_rows, text_of, vocabulary


def corpus(n=80, seed=3):
    rng, vocab = random.Random(seed), vocabulary(500)
    return [text_of(rng, vocab, rng.randint(8, 30)) for _ in range(n)]


def test_interior_names_do_not_depend_on_the_offset():
    body = corpus(1)[0].encode()
    levels = [fp.signature_names([pre + body + post]) for pre, post in ((b"", b""), (b"x yz ", b" tail"), (b"quite another head. ", b""))]
    for k in (1, 2, 3):
        names = [set(lv[k][0].tolist()) for lv in levels]
        assert len(names[0] & names[1] & names[2]) >= 0.6 * len(names[0])


def test_phrases_shrink_every_level_and_runs_collapse():
    for raw in ([b"a"], [b"aaaa" * 50], [b"abab" * 100, b"z"], [bytes(range(256)) * 4], [b"x" * 100_000]):
        levels = fp.signature_names(raw)
        sizes = [len(name) for name, _ in levels]
        assert sizes[-1] == len(raw) and len(levels) < 40
        assert all(b <= a for a, b in zip(sizes, sizes[1:]))


def test_a_text_is_parsed_alike_alone_and_among_others():
    texts = corpus(20) + ["", "a", "short text"]
    together = fp.sketches(texts)
    assert all((fp.sketches([t])[0] == together[i]).all() for i, t in enumerate(texts))


def test_likeness_follows_the_shared_share():
    texts = corpus(60)
    near, far = [], []
    for i, t in enumerate(texts):
        other = texts[(i + 1) % len(texts)]
        row = fp.sketches([t, t[: len(t) * 9 // 10] + other[: len(t) // 10], t[: len(t) // 2] + other[: len(t) // 2], other])
        a = np.repeat(row[:1], 3, axis=0)
        s = fp.likeness(a, row[1:])
        near.append(s)
    near = np.array(near).mean(axis=0)
    assert near[0] > 0.65 and 0.2 < near[1] < 0.5 and near[2] < 0.05


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[d] = (t, t[:len(t) - half] + nxt[:half], nxt)
    return out


def test_with_edits_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i * 3, t) for i, t in enumerate(corpus(60) + ["", None, "é中\U0001f600ü", "a", "same", "same"])]
    rng.shuffle(rows)
    want = brute(rows)
    for cell in (500, 7):
        d = docs_frame(spark, rows).repartition(6)
        old = fp.in_cells.__defaults__
        fp.in_cells.__defaults__ = (cell, 20_000)
        try:
            out = fp.with_edits(d).collect()
        finally:
            fp.in_cells.__defaults__ = old
        assert len(out) == len(rows)
        for r in out:
            text, edited, nxt = want[r["doc_id"]]
            a, b, c = fp.sketches([text, edited, nxt])
            assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert [r["fingerprint"], r["edited_fingerprint"]] == fp.to_hex(np.stack([a, b]))
            assert r["near_edited"] == fp.likeness(a[None], b[None])[0] and r["near_next"] == fp.likeness(a[None], c[None])[0]


def test_odd_rows_and_clashing_columns(spark):
    df = docs_frame(spark, odd_rows())
    for c in ("cell", "tie", "extra", "x", "up", "head", "to_cell"):
        df = df.withColumn(c, F.lit("clash"))
    out = fp.with_edits(df).collect()
    assert len(out) == len(odd_rows())
    same = {}
    for r in fp.fingerprint(df).collect():
        same.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(same[0]) == 1


def test_one_row_and_no_rows(spark):
    (r,) = fp.with_edits(docs_frame(spark, [(5, "abcdef")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1.0
    assert fp.with_edits(docs_frame(spark, [])).count() == 0
