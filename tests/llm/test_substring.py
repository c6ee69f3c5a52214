import random
import re

from pyspark.sql import functions as F

from cohortflow.llm import substring
from tests.llm.helpers import docs_frame, odd_rows, text_of, vocabulary, words

CUT = re.compile(r"([.!?][\x20\x09-\x0D]+|[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*)")


def parts_of(text):
    """(part with its trailing white space, normalised words) of a text."""
    out, at = [], 0
    for m in CUT.finditer(text):
        out.append(text[at:m.end()])
        at = m.end()
    out.append(text[at:])
    return [(p, tuple(words(p))) for p in out]


def brute(rows, min_words):
    """Kept text of every (id, text): later occurrences go in runs of at least ``min_words`` words."""
    first = {}
    order = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0))
    for d, t in order:
        for i, (_, norm) in enumerate(parts_of(t)):
            if norm:
                first.setdefault(norm, (d, t, i))
    out = {}
    for d, t in order:
        parts = parts_of(t)
        again = [bool(n) and first[n] != (d, t, i) for i, (_, n) in enumerate(parts)]
        kept, i = [], 0
        while i < len(parts):
            j = i
            while j < len(parts) and again[j]:
                j += 1
            if j > i and sum(len(n) for _, n in parts[i:j]) >= min_words:
                i = j
                continue
            kept.append(parts[i][0])
            i += 1
        out[(d, t)] = "".join(kept)
    return out


def planted(seed=5, n=120):
    rng, vocab = random.Random(seed), vocabulary(300)
    passages = [text_of(rng, vocab, 6, 9, 14) for _ in range(5)]
    common = "Read more of this here."
    rows = []
    for i in range(n):
        body = [text_of(rng, vocab, rng.randint(1, 5)) for _ in range(3)]
        if i % 3 == 0:
            body.insert(rng.randint(0, 3), rng.choice(passages))
        if i % 4 == 0:
            body.insert(rng.randint(0, 3), common)
        rows.append((i, rng.choice(["\n", " ", "\n\n"]).join(body)))
    rows += [(n + i, rows[i][1]) for i in range(6)]
    return rows, passages, common


def test_equals_brute_force_and_offsets_point_into_the_original(spark):
    rows, passages, common = planted()
    want = brute(rows, 20)
    out = substring.dedup(docs_frame(spark, rows).repartition(7)).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        text = texts[r["doc_id"]]
        assert r["text"] == want[(r["doc_id"], text)]
        cut = text
        for s, n in sorted(zip(r["starts"], r["lengths"]), reverse=True):
            cut = cut[:s] + cut[s + n:]
        assert cut == r["text"] and r["removed_words"] == len(words(text)) - len(words(r["text"]))
    joined = [r["text"] for r in out]
    for p in passages:
        assert sum(p in t for t in joined) <= 1
    assert sum(common in t for t in joined) > 10                      # a short common line is no passage


def test_clean_documents_stay(spark):
    rng, vocab = random.Random(9), vocabulary(400)
    rows = [(i, text_of(rng, vocab, 8)) for i in range(60)]
    out = {r["doc_id"]: r for r in substring.dedup(docs_frame(spark, rows)).collect()}
    assert all(out[i]["text"] == t and out[i]["n_removed"] == 0 for i, t in rows)


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows() + [(20, "One two three four. " * 12), (21, "ONE  two three\tfour. " * 12)]
    df = docs_frame(spark, rows)
    for c in ("tie", "key", "more", "place", "again", "repeated", "r_id", "starts", "k_lang"):
        df = df.withColumn(c, F.lit("clash"))
    out = substring.dedup(df, keep=("lang",)).collect()
    want = brute(rows, 20)
    assert len(out) == len(rows) and out[0]["lang"] == "en"
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in out), key=str)
    assert got == sorted(((d is None, d, want.get((d, t))) for d, t in rows), key=str)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["text"] is None and by[3]["text"] == " \n\t " and by[21]["text"] == ""


def test_one_line_in_every_document(spark):
    line = " ".join(f"w{i}" for i in range(30)) + "."
    rows = [(i, f"start {i} of its own.\n{line}\nend {i} as well.") for i in range(400)]
    out = {r["doc_id"]: r["text"] for r in substring.dedup(docs_frame(spark, rows).repartition(20)).collect()}
    assert out[0] == rows[0][1] and all(line not in out[i] and out[i].endswith(f"end {i} as well.") for i in range(1, 400))


def test_empty_table(spark):
    assert substring.dedup(docs_frame(spark, [])).count() == 0


def test_whole_lines_go_however_short(spark):
    licence = "Licensed under the usual terms."
    rows = [(i, f"start {i} of its own.\n{licence}\nfirst {i}. Shared words. last {i}.\nLICENSED under  the usual terms.") for i in range(50)]
    rows += [(60, "Read on."), (61, "He said so. Read on. And left."), (62, "read ON."), (None, licence), (None, licence)]
    df = docs_frame(spark, rows).repartition(7)
    out = {r["doc_id"]: r["text"] for r in substring.dedup(df, whole_lines=True).collect()}
    assert out[0] == f"start 0 of its own.\n{licence}\nfirst 0. Shared words. last 0.\n"
    assert all(out[i] == f"start {i} of its own.\nfirst {i}. Shared words. last {i}.\n" for i in range(1, 50))   # sentences inside a line keep the floor
    assert (out[60], out[61], out[62], out[None]) == ("Read on.", "He said so. Read on. And left.", "", "")


def test_whole_lines_equal_brute_force(spark):
    rows, _, common = planted()
    rows += [(500 + i, f"{common}\nown {i} text") for i in range(30)]
    out = {r["doc_id"]: r["text"] for r in substring.dedup(docs_frame(spark, rows).repartition(7), whole_lines=True).collect()}
    seen = set()
    for d, t in rows:                                                 # ids ascend
        left = [tuple(words(x)) for x in out[d].split("\n")]
        for line in filter(None, (tuple(words(x)) for x in t.split("\n"))):
            assert line not in seen or line not in left
            seen.add(line)
