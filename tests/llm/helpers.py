"""Small fixtures and brute-force twins shared by the operator tests."""

from __future__ import annotations

import random
from pathlib import Path

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    """Lower-cased (A-Z) words between ASCII white space, as bytes."""
    return (text or "").encode("utf-8").lower().split()


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def sentence(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."


def text_of(rng, vocab, sentences=6, least=5, most=14):
    lines, line = [], []
    for _ in range(sentences):
        line.append(sentence(rng, vocab, rng.randint(least, most)))
        if rng.random() < 0.3:
            lines.append(" ".join(line))
            line = []
    return "\n".join(lines + ([" ".join(line)] if line else []))


def docs_frame(spark, rows):
    """Rows (doc_id, text[, lang, source]) as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def odd_rows():
    """Nulls, empty, white space only, one word, repeated rows, a clash of ids, a very long text."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "one two three four five six"), (6, "one two three four five six"),
            (7, "other text under id seven"), (7, "one two three four five six"), (None, "no id here at all"), (8, "long " * 60_000), (9, "é中\U0001f600 mixed   signs")]


def tables_dir(tmp_path, spark, **frames):
    for name, df in frames.items():
        df.write.parquet(str(Path(tmp_path) / f"{name}.parquet"))
    return str(tmp_path)
