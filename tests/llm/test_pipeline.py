import re

import corpus_pipeline as P
from cohortflow.llm import langid, mixing
from tests.llm.helpers import DOC_SCHEMA, docs_frame, odd_rows, tables_dir, words
from tests.llm.test_jaccard import brute as groups_of
from tests.llm.test_jaccard import corpus
from tests.llm.test_packing import best_fit
from tests.llm.test_substring import brute as kept_texts
from tests.llm.test_substring import planted


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_and_columns():
    assert [n for n, _ in P.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "source_mixing", "best_fit_packing"]
    assert P.ORACLE_SQL is None


def test_language_stage_drops_texts_without_language_and_keeps_the_rest(spark):
    rows = [(i, t, ["en", "fr"][i % 2]) for i, (_, t) in enumerate(corpus(3)[:60])] + [(900, None), (901, "12 34"), (902, ""), (903, "clean text without a label", None)]
    out = P.language_id(spark, docs_frame(spark, rows), "")
    assert out.schema.simpleString() == docs_frame(spark, []).schema.simpleString()
    kept = {r["doc_id"]: r["lang"] for r in out.collect()}
    assert kept.keys() == {i for i, t, *_ in rows if langid.has_letter(t or "")} and kept[903] in ("en", "fr")


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    rows = corpus(2)
    want = groups_of(rows, 5, 80)
    out = P.near_duplicates(spark, docs_frame(spark, rows + rows[:3]), "")
    texts = dict(rows)
    assert rows_of(out) == sorted(((d, texts[d]) for d in set(want.values())), key=str)


def test_substring_stage_removes_repeats(spark):
    rows, _, _ = planted()
    want = kept_texts(rows, 20)
    out = P.substring_dedup(spark, docs_frame(spark, rows), "")
    expect = [(d, want[(d, t)]) for d, t in rows if words(want[(d, t)])]
    assert rows_of(out) == sorted(expect, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_mixing_stage_repeats_rows(spark):
    df = docs_frame(spark, [(i, "w " * (1 + i % 9), "en", ["a", "b"][i % 7 > 0]) for i in range(100)])
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in P.source_mixing(spark, df, "").groupBy("doc_id").count().collect()}
    assert got == want
    plan = P.source_mixing(spark, df, "")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_run_equals_the_stages_one_by_one(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 4}") for i, t in corpus(5, hot=20)[:120]] + [(20_000, None)]
    sf = tables_dir(tmp_path, spark, documents=docs_frame(spark, rows))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    pick = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    out = P.run(spark, sf)
    assert pick(out) == pick(docs)
    assert out.select("sequence_id").distinct().count() == best_fit([r["length"] for r in out.collect()], 2048)


def test_odd_rows_and_no_rows(spark):
    docs = docs_frame(spark, odd_rows())
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() > 0
    for name, stage in P.STAGES:
        assert stage(spark, spark.createDataFrame([], DOC_SCHEMA), "").count() == 0, name
