"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every row has a size in words and a hash of 60 bits.  A source takes each of its rows
``floor(target / source size)`` times and, of the rest, the rows whose hash lies below a
threshold.  The threshold comes from histograms, not from a sort: words are summed by
(source, hash bucket), the bucket in which the budget runs out is the boundary bucket, and
only its rows are summed again by the next hash digits.  Thresholds are nested: a larger
budget takes a superset.

A histogram has at most ``sources x 4096`` rows and is summed map-side, so a source that
holds a third of all rows costs no more shuffle than any other.  After the first level only
the rows of one bucket in 4096 of a source are left.

Cases: null text has size 0 and is taken 0; null source is a source of its own, ranked last;
a source without words has target 0; with equal hashes (repeated rows) rows are taken or left
together; no rows give no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import staged

WORD = "[^\\x20\\x09-\\x0D]+"
#: hash digits (of 4 bits) read by each histogram: 3 + 3 + 3 + 6 = 15 digits
LEVELS = (3, 3, 3, 6)
MOST_COPIES = 3


#: sources whose thresholds are sent to every task; more of them are joined by a shuffle
MOST_BROADCAST = 100_000


def _hash(id_col: str, text_col: str):
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
                   F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return F.substring(F.md5(key.cast("binary")), 1, sum(LEVELS))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size in words, hash digits) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                       _hash(id_col, text_col).alias("hash"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target): weighted shares of all words, at most three times a source.

    Water filling in closed form: sources in the order of ``cap / weight``; a source is at its
    cap while the share that all later ones would get reaches that ratio.  The windows without
    keys run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("bigint"))
    order = Window.orderBy((F.lit(float(MOST_COPIES)) * F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = (per.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum(MOST_COPIES * F.col("source_size")).over(before), F.lit(0)))
           .withColumn("weight_left", F.sum("w").over(after)))
    # in integers: capped while left * w >= 3 * size * weight_left
    capped = F.col("left").cast("decimal(38,0)") * F.col("w") >= MOST_COPIES * F.col("source_size").cast("decimal(38,0)") * F.col("weight_left")
    per = per.withColumn("open_left", F.when(~capped, F.col("left"))).withColumn("open_weight", F.when(~capped, F.col("weight_left")))
    # the first source below its cap has what is left for all sources from there on
    ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("open_left", F.first("open_left", ignorenulls=True).over(ends))
           .withColumn("open_weight", F.first("open_weight", ignorenulls=True).over(ends)))
    share = F.col("open_left").cast("double") * F.col("w") / F.col("open_weight")
    return per.select("source", "source_size", F.when(capped, (MOST_COPIES * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _same_source(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, bound): rows with ``hash < bound`` are taken once more.

    ``bound`` is a string of hash digits; null takes nothing more.
    """
    state = goal.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint").alias("copies"))
    state = state.withColumn("rest", F.col("target") - (F.col("copies") * F.col("source_size")).cast("double"))
    state = state.withColumn("prefix", F.when(F.col("rest") > 0, F.lit("")))
    at = 0
    for n in LEVELS:
        # rows of the boundary bucket; the state has one row per source
        s = state.where(F.col("prefix").isNotNull()).select(F.col("source").alias("s_source"), "prefix", "rest")
        inside = sized.join(s, _same_source("source", "s_source") & (F.substring("hash", 1, at) == F.col("prefix")) if at
                            else _same_source("source", "s_source"))
        hist = inside.groupBy("source", "prefix", "rest", F.substring("hash", 1, at + n).alias("cell")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.sum("words").over(upto))
        over = hist.where(F.col("upto") > F.col("rest"))
        first = over.groupBy("source").agg(F.min_by(F.struct("cell", "words", (F.col("upto") - F.col("words")).alias("lower")), "cell").alias("b"))
        first = first.select(F.col("source").alias("s_source"), F.col("b.cell").alias("cell"), F.col("b.words").alias("words"), F.col("b.lower").alias("lower"))
        state = (state.join(first, _same_source("source", "s_source"), "left")
                 .withColumn("prefix", F.col("cell"))
                 .withColumn("last_words", F.col("words"))
                 .withColumn("rest", F.when(F.col("cell").isNotNull(), F.col("rest") - F.col("lower")).otherwise(F.col("rest")))
                 .select("source", "source_size", "target", "copies", "rest", "prefix", "last_words"))
        state = staged(state, "mix-state")
        at += n
    # the last cell is one hash value: it is taken when that ends nearer to the target
    nearer = F.col("last_words") - F.col("rest") < F.col("rest")
    return state.select("source", "source_size", "target", "copies",
                        F.when(F.col("prefix").isNull(), None).when(nearer, F.concat("prefix", F.lit("~"))).otherwise(F.col("prefix")).alias("bound"))


def _bounds(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    bound = thresholds(sized, targets(sized, weights)).withColumnRenamed("source", "s_source")
    return F.broadcast(bound) if bound.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else bound


def _copies():
    return F.col("copies") + F.when(F.col("hash") < F.col("bound"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (words)."""
    sized = staged(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    return (sized.join(_bounds(sized, weights), _same_source("source", "s_source"), "left")
            .select("doc_id", "source", "size", "source_size", "target", _copies().cast("bigint").alias("copies"),
                    (_copies() * F.col("size")).cast("bigint").alias("taken")))


def sample(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept; the texts are not shuffled."""
    sized = staged(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    bound = _bounds(sized, weights).select(F.col("s_source").alias("__mix_source"), F.col("copies").alias("__mix_whole"), F.col("bound").alias("__mix_bound"))
    copies = F.col("__mix_whole") + F.when(_hash(id_col, text_col) < F.col("__mix_bound"), 1).otherwise(0)
    met = docs.join(bound, _same_source(source_col, "__mix_source"), "left").withColumn("__mix_copies", copies).where(F.col("__mix_copies") > 0)
    return met.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__mix_copies")))).select(*docs.columns)
