import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import packing as P
from tests.llm.helpers import SF, docs_frame, odd_rows


def best_fit(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(size - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 250))]
    intervals, opened = P.plan(Counter(lengths), size)
    assert opened == best_fit(lengths, size)
    held, ranks = {}, {}
    for n, a, b, first, offset in intervals.tolist():
        for r in range(a, b):
            held.setdefault(first + r - a, []).append((offset, n))
            ranks.setdefault(n, []).append(r)
    assert {n: len(r) for n, r in ranks.items()} == Counter(lengths)
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size


def test_plan_does_not_grow_with_the_rows():
    few, _ = P.plan({n: 10 for n in range(1, 2049)})
    many, _ = P.plan({n: 10 ** 7 for n in range(1, 2049)})
    assert len(many) < 20_000 and len(few) < 20_000


def test_cut():
    assert P.cut(0) == [(0, 0)] and P.cut(2048) == [(0, 2048)]
    assert P.cut(2049) == [(0, 1), (1, 2048)]
    assert P.cut(4096) == [(0, 2048), (2048, 2048)]


def test_token_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    paths = P.tokenizer_paths()
    full = Tokenizer.from_file(paths[0])
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a\n\n b\t", "<|endoftext|>", "x<|endoftext|>y", "  z", "it's we'LL 1234567", "١٢ ½ Ⅷ", "é‍\U0001f468‍\U0001f469"]
    for t in texts:
        assert P.token_ids(t, paths) == full.encode(t, add_special_tokens=False).ids


def check(spark, df):
    out = P.pack(df).collect()
    by_seq, by_doc = {}, {}
    for r in out:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and 1 <= n <= P.SIZE
            at += n
        assert at <= P.SIZE
    assert len(by_seq) == best_fit([r["length"] for r in out], P.SIZE)
    return by_doc


def test_pack_round_trip(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    by_doc, paths = check(spark, df), P.tokenizer_paths()
    for r in df.collect():
        ids = np.array([*P.token_ids(r["text"] or "", paths), 0], dtype="<u4")
        at = 0
        pieces = sorted(by_doc.pop(r["doc_id"]), key=lambda x: x["piece"])
        for k, p in enumerate(pieces):
            assert (p["piece"], p["start"]) == (k, at)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            assert k == 0 or p["length"] == P.SIZE
            at += p["length"]
        assert at == len(ids) and (len(pieces) == 1) == (len(ids) <= P.SIZE)
    assert not by_doc


def test_sequences_hold_the_tokens(spark):
    df = docs_frame(spark, [(i, f"some words number {i} " * (i % 7)) for i in range(40)])
    placed = P.pack(df)
    ids = {r["sequence_id"]: r["ids"] for r in P.sequences(df, placed).collect()}
    paths = P.tokenizer_paths()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in placed.collect():
        want = [*P.token_ids(texts[r["doc_id"]], paths), 0][r["start"]:r["start"] + r["length"]]
        assert ids[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == want


def test_odd_rows_and_clashing_columns(spark):
    df = docs_frame(spark, odd_rows())
    for c in ("piece", "length", "rank", "bucket", "buckets", "base", "offset"):
        df = df.withColumn(c, F.lit("clash"))
    by_doc = check(spark, df)
    assert [r["length"] for r in by_doc[1]] == [1] and len(by_doc[4]) == 2 and None in by_doc
    assert sum(r["length"] for r in by_doc[8]) > 60_000


def test_empty_table(spark):
    assert P.pack(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\u00a0"])
def test_long_runs_of_white_space(space):
    paths = P.tokenizer_paths()
    _, full, _ = P._encoder(paths)
    text = "before" + space * 2_000_000 + "after."
    assert P.token_ids(text, paths) == full.encode(text, add_special_tokens=False).ids
    under = "x" + space * 90_000 + "y"                           # the fast form, which must agree
    assert not P.has_long_run(under) and P.token_ids(under, paths) == full.encode(under, add_special_tokens=False).ids


def test_packing_a_long_run_and_an_endless_word(spark):
    df = docs_frame(spark, [(1, " " * 2_000_000), (2, "w" * 1_000_000), (3, "short text")])
    rows = P.pack(df).collect()
    per = {d: sum(r["length"] for r in rows if r["doc_id"] == d) for d in (1, 2, 3)}
    paths = P.tokenizer_paths()
    assert per == {1: len(P.token_ids(" " * 2_000_000, paths)) + 1, 2: len(P.token_ids("w" * 1_000_000, paths)) + 1, 3: len(P.token_ids("short text", paths)) + 1}
