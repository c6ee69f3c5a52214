"""URL filtering by mined association rules.

A url becomes a set of tokens (scheme, host labels, path segments, extension, query keys,
fragment).  Urls that a listed (host, path) rule decides are the labelled rows.  Spark's
FP-growth mines token sets that occur together with a verdict; rules are kept by support and
confidence, and a rule is dropped when a rule on fewer of its tokens is as sure of the same
verdict.  Urls without a listed rule are matched through an inverted index: each kept rule is
filed under the rarest of its tokens, so a url meets only the rules filed under tokens it has.

Scale: digits are written ``#``, so urls that differ in numbers share one token set and are
matched once; rules meet token sets in an equi-join on one token.  Nothing is collected: the
rules stay a table.  Support is a share of all urls, so the number of rules follows the variety
of frequent tokens and not the number of urls.

Cases: null urls and urls without ``://`` have an empty host and path and no token but
``no-host``; with no labelled url nothing is mined and every open url gets the
default verdict; repeated rows are judged alike; ties between rules fall to higher confidence,
then support, then block before allow.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import staged


@dataclass(frozen=True)
class ListedRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The listed rules of the query.
LISTED = (
    ListedRule("net", "/", "block"),
    ListedRule("example.net", "/en/", "allow"),
    ListedRule("example.com", "/de/", "block"),
    ListedRule("org", "/fr/", "allow"),
)


#: host up to ``/``, ``?``, ``#`` or the end after the first ``://``; path up to ``?``, ``#`` or the end
_SPLIT = "(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path) of every row; host and path are empty for null or without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER).alias("host"),
                        F.regexp_extract(url, _SPLIT, 2).alias("path"))


def listed_verdict(parsed: DataFrame, rules=LISTED) -> DataFrame:
    """Adds ``rule`` (the longest listed rule that fits) and its verdict ``listed``."""
    rule = listed = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):        # the longest is tried first: it is outermost
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        listed = F.when(fits, F.lit(r.verdict)).otherwise(listed)
    return parsed.withColumn("rule", rule).withColumn("listed", listed)


def _none():
    return F.array().cast("array<string>")


def tokens():
    """The token set of a parsed url, sorted, digits as ``#``."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")

    def named(kind, arr):
        return F.transform(F.filter(arr, lambda x: x != ""), lambda x: F.concat(F.lit(kind + "="), x))

    labels = F.split(host, "\\.")
    segments = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    query = F.transform(F.split(F.regexp_extract(url, "(?s)[?]([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))
    inside = F.concat(scheme, named("label", labels), named("end", F.slice(labels, -1, 1)),
                      F.when(F.size(labels) > 1, named("site", F.array(F.concat_ws(".", F.slice(labels, -2, 2))))).otherwise(_none()),
                      named("segment", segments), named("query", query),
                      F.when(F.locate("#", url) > 0, F.array(F.lit("fragment"))).otherwise(_none()))
    return F.sort_array(F.array_distinct(F.when(host == "", F.array(F.lit("no-host"))).otherwise(inside)))


RULE_SCHEMA = "tokens array<string>, verdict string, confidence double, support double, filed string"


def mine(spark: SparkSession, judged: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """Association rules ``tokens -> verdict`` from urls with a ``tokens`` and a ``listed`` column.

    Urls without a listed verdict are transactions too: they count against a rule's confidence.
    Baskets are whole: FP-growth itself drops the tokens that miss ``min_support`` before it builds trees.
    """
    if judged.where(F.col("listed").isNotNull()).limit(1).count() == 0:
        return spark.createDataFrame([], RULE_SCHEMA)
    label = F.when(F.col("listed").isNotNull(), F.array(F.concat(F.lit("verdict="), F.col("listed")))).otherwise(_none())
    baskets = judged.select(F.concat("tokens", label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = (model.associationRules.where(F.element_at("consequent", 1).startswith("verdict="))
             .where(~F.exists("antecedent", lambda x: x.startswith("verdict=")))
             .select(F.sort_array("antecedent").alias("tokens"), F.substring_index(F.element_at("consequent", 1), "=", -1).alias("verdict"),
                     "confidence", "support"))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    rarest = (rules.select("tokens", "verdict", F.explode("tokens").alias("token")).join(single, "token")
              .groupBy("tokens", "verdict").agg(F.min_by("token", F.struct("freq", "token")).alias("filed")))
    rules = staged(rules.join(rarest, ["tokens", "verdict"]).select("tokens", "verdict", "confidence", "support", "filed"), "url-rules")
    # a rule goes when fewer of its tokens give the same verdict as surely
    less = rules.select(F.col("tokens").alias("l_tokens"), F.col("verdict").alias("l_verdict"), F.col("confidence").alias("l_conf"), F.col("filed").alias("token"))
    covered = (rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token")).join(less, "token")
               .where((F.col("verdict") == F.col("l_verdict")) & (F.size("l_tokens") < F.size("tokens")) & (F.col("l_conf") >= F.col("confidence"))
                      & (F.size(F.array_except("l_tokens", "tokens")) == 0))
               .select("tokens", "verdict").distinct())
    return staged(rules.join(covered, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "support", "filed"), "url-kept")


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule of every token set that has one: (tokens, mined struct), through the inverted index."""
    filed = rules.select(F.col("tokens").alias("needs"), "verdict", "confidence", "support", F.col("filed").alias("token"))
    hits = (token_sets.select("tokens", F.explode("tokens").alias("token")).join(filed, "token")
            .where(F.size(F.array_except("needs", "tokens")) == 0))
    return hits.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "verdict", "needs")).alias("mined"))


def judge(pages: DataFrame, rules=LISTED, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
          min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """One row per input row: page_id, url, host, path, rule, verdict, mined_tokens, confidence."""
    spark = pages.sparkSession
    judged = staged(listed_verdict(parse(pages, id_col, url_col), rules).withColumn("tokens", tokens()), "url-tokens")
    mined = mine(spark, judged, min_support, min_confidence)
    best = match(judged.where(F.col("listed").isNull()).select("tokens").distinct(), mined)
    best = best.select("tokens", F.col("mined.verdict").alias("by_rules"), F.col("mined.needs").alias("mined_tokens"), F.col("mined.confidence").alias("confidence"))
    decided = judged.where(F.col("listed").isNotNull()).select(
        "page_id", "url", "host", "path", "rule", F.col("listed").alias("verdict"),
        F.lit(None).cast("array<string>").alias("mined_tokens"), F.lit(None).cast("double").alias("confidence"))
    # many urls share a token set: the few sets with a rule are the small side, skew is split by AQE
    still_open = judged.where(F.col("listed").isNull()).join(best, "tokens", "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("by_rules", F.lit(default)).alias("verdict"), "mined_tokens", "confidence")
    return decided.unionByName(still_open)
