"""A corpus pipeline: five stages over the ``documents`` table, each one of the llm operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next
documents, the last one the packed pieces.  ``run`` writes each stage's result into the shared
folder and reads it again, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import jaccard, langid, mixing, packing, substring
from cohortflow.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a missing ``lang`` is filled with the prediction.

    Texts that are null, have no letter, or whose best language is hardly likely go.
    """
    d = docs.select(*COLUMNS)
    labelled = langid.predict(d, langid.train(d), keep=COLUMNS[1:])
    known = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= langid.MIN_SCORE)
    return labelled.where(known).select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles at a similarity of 0.8 or more: the least id.

    Of rows that repeat an id one stays; rows without an id cannot be named by a group and stay.
    """
    d = docs.select(*COLUMNS).withColumn("tie", F.xxhash64(*COLUMNS))
    groups = jaccard.join(d, k=5, percent=80)
    heads = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rows = d.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("tie").alias("tie"), F.count("*").alias("rows"))
    rows = staged(rows.join(heads, "doc_id"), "pipeline-heads")
    few = rows.limit(jaccard.MOST_BROADCAST + 1).count() <= jaccard.MOST_BROADCAST        # 24 bytes a row
    kept = d.join(F.broadcast(rows) if few else rows, ["doc_id", "tie"])
    alone = kept.where(F.col("rows") == 1).unionByName(kept.where(F.col("rows") > 1).dropDuplicates(["doc_id", "tie"]))
    return alone.select(*COLUMNS).unionByName(d.where(F.col("doc_id").isNull()).select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; a text of nothing else goes."""
    out = substring.dedup(docs, keep=("lang", "source"))
    whole = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_units"))
    return out.where(~whole).select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the words takes them."""
    return mixing.sample(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the first stage (a trained network); the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
