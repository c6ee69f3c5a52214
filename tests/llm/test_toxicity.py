import random

from pyspark.sql import functions as F

from cohortflow.llm import toxicity as T
from cohortflow.llm.queries import QUERIES
from tests.llm.helpers import SF, docs_frame, odd_rows, text_of, vocabulary


def lexicon():
    return T.Lexicon({"idiot": 4.0, "moron": 4.0, "trash": 3.0, "vequ*": 5.0}, ("trash can",), (-4.0, 3.0, 0.5, 0.1))


def found(text):
    auto = lexicon().automaton()
    folded = T.fold(text)
    return sorted(folded[a:e + 1] for a, (e, _) in T.matches(auto_fold(), folded).items()) if auto else []


def auto_fold():
    lex = lexicon()
    return T.Lexicon({T.fold(k.rstrip("*")) + ("*" if k.endswith("*") else ""): w for k, w in lex.weights.items()}, lex.exceptions, lex.curve).automaton()


def test_folding_finds_disguised_words():
    for word in ("idiot", "IDIOT", "1d10t", "ıdıot", "іdіоt", "i\u200bdiot", "ïdiót", "ｉｄｉｏｔ", "id!ot", "𝐢𝐝𝐢𝐨𝐭", "m0r0n", "мoron", "tr@$h", "tr4sh", "vequxyz"):
        assert found(f"you are a {word}, really"), word
    for clean in ("idiotic", "amoron", "entrash", "xvequ", "i d", "moronic", ""):
        assert not found(f"so {clean} it is"), clean


def test_exception_phrases_excuse_only_what_is_inside():
    assert not found("the trash can is full") and not found("The TRASH   can".replace("   ", " "))
    assert len(found("the trash can and trash")) == 1


def planted(n=400, seed=2):
    rng, vocab = random.Random(seed), vocabulary(300)
    bad = ["grumbol", "snarfty", "plonkish", "vexxor"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = text_of(rng, vocab, rng.randint(2, 30)), int(i % 4 == 0)
        words = text.split(" ")
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        elif i % 5 == 1:
            words.insert(0, "a grumbol pie")
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_learned_scores_and_learned_exceptions(spark):
    rows, labels = planted()
    docs, lab = docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    half = F.col("doc_id") % 8 < 6
    lex = T.learn(T.labelled(docs, lab.where(half)))
    assert all(any(T.fold(w).startswith(k.rstrip("*")) for k in lex.weights) for w in ("snarfty", "plonkish", "vexxor"))
    out = {r["doc_id"]: r for r in T.score(docs, lex).collect()}
    toxic = dict(labels)
    missed = [i for i in out if toxic[i] and not out[i]["predicted"] and "grumbol" not in rows[i][1]]
    wrong = [i for i in out if not toxic[i] and out[i]["predicted"]]
    assert not missed and len(wrong) <= 4
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())


def test_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    out = QUERIES["op5_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    hit, miss = out[out.toxic == 1].predicted.mean(), out[out.toxic == 0].predicted.mean()
    assert len(out) > 500 and hit > 0.9 and miss < 0.01        # some toxic rows hold no word at all that others share


def test_length_lowers_a_score():
    lex = lexicon()
    auto = auto_fold()
    short, long = (T.features(auto, T.fold(t)) for t in ("idiot here", "idiot here " + "calm words " * 2000))
    assert T._score(lex.curve, short[0]) > T._score(lex.curve, long[0])


def test_odd_rows_labels_and_clashing_columns(spark):
    df = docs_frame(spark, odd_rows())
    for c in ("toxic", "m", "score", "predicted", "starts", "__id"):
        df = df.withColumn(c, F.lit("clash"))
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, None), (None, 1), (99, 1), (8, 0)], "doc_id bigint, toxic int")
    lex = T.learn(T.labelled(df, labels))
    out = T.score(df, lex).collect()
    assert len(out) == len(odd_rows()) and len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1


def test_without_labels_and_without_rows(spark):
    df, none = docs_frame(spark, [(1, "text")]), spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["predicted"] for r in T.score(df, T.learn(T.labelled(df, none))).collect()] == [0]
    empty = docs_frame(spark, [])
    assert T.score(empty, T.learn(T.labelled(empty, none))).count() == 0
