"""Id-disjoint splits, grouped folds, bootstrap draws.

Randomness comes from ``md5`` of text keys (see ``functions.hashing``), so a
retried task redraws the same numbers and a SQL engine can reproduce them.

Exact ranks of ids in hash order are computed without a global sort or a
single-partition window: ids are bucketed by the top 16 bits of their hash,
bucket sizes (at most 65,536 rows, a fixed bound) give prefix offsets, and the
rank inside a bucket is a window partitioned by bucket.  Hashes are uniform, so
buckets are balanced whatever the key distribution is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.hashing import HASH_HEX_DIGITS, hash_bigint

BUCKET_BITS = 16
N_BUCKETS = 1 << BUCKET_BITS


def ranked_ids(df: DataFrame, id_col: str = "id", seed: int | str = 42, salt: str | None = None) -> DataFrame:
    """(id, h, rank, n): distinct non-null ids with their 0-based rank in hash order."""
    parts = ([salt] if salt else []) + [seed]
    ids = df.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    hashed = ids.select(id_col, hash_bigint(*parts, F.col(id_col)).alias("h"))
    hashed = hashed.select("*", F.shiftright("h", HASH_HEX_DIGITS * 4 - BUCKET_BITS).alias("_bk"))
    sizes = hashed.groupBy("_bk").agg(F.count(F.lit(1)).alias("_sz"))
    # <= 65,536 rows: the offset table is small by construction, so it is broadcast
    allrows = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "_bk",
        F.coalesce(F.sum("_sz").over(Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_sz").over(allrows).alias("n"),
    )
    within = F.row_number().over(Window.partitionBy("_bk").orderBy("h", id_col)) - 1
    r = hashed.select("*", within.alias("_rk")).join(F.broadcast(offsets), "_bk")
    return r.select(id_col, "h", (F.col("_off") + F.col("_rk")).cast("bigint").alias("rank"), F.col("n").cast("bigint").alias("n"))


def split_ids(df: DataFrame, id_col: str = "id", test_size: float = 0.15, val_size: float | None = 0.15,
              seed: int | str = 42) -> DataFrame:
    """(id, split) with split in test / val / train (F1; F2 when ``val_size`` is None).

    ``n_test = max(1, round(test_size*n))`` and ``n_val = max(1, round(val_size*(n-n_test)))``
    with half-even rounding, as in Python's ``round``.
    """
    r = ranked_ids(df, id_col, seed)
    return r.select(id_col, _split(F.col("rank"), F.col("n"), test_size, val_size).alias("split"))


def with_split(df: DataFrame, splits: DataFrame, id_col: str = "id") -> DataFrame:
    """Attach the split to every row (equi-join on id; AQE broadcasts small id tables)."""
    return df.join(splits, id_col, "inner")


def rows_in(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in ``ids`` (J1, semi join)."""
    return df.join(ids.select(id_col), id_col, "left_semi")


def rows_not_in(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is not in ``ids`` (J1, anti join)."""
    return df.join(ids.select(id_col), id_col, "left_anti")


def grouped_folds(df: DataFrame, k: int = 5, id_col: str = "id", seed: int | str = 42) -> DataFrame:
    """(id, fold): no id in two folds; id counts per fold differ by at most one."""
    r = ranked_ids(df, id_col, seed, salt="fold")
    return r.select(id_col, F.pmod(F.col("rank"), F.lit(k)).cast("int").alias("fold"))


def row_folds(df: DataFrame, k: int = 5, keys=("id", "day"), seed: int | str = 42) -> DataFrame:
    """Shuffled row folds from the hash of the row key."""
    return df.select("*", F.pmod(hash_bigint("row", seed, *[F.col(c) for c in keys]), F.lit(k)).cast("int").alias("fold"))


def bootstrap_weights(df: DataFrame, n_boot: int = 200, id_col: str = "id", seed: int | str = 42,
                      mode: str = "weighted") -> DataFrame:
    """(b, id, weight): n draws with replacement of the n ids, ``n_boot`` times.

    Draw j of replicate b picks rank ``md5(seed:b:j) mod n``.  The draw table is
    generated on the executors from ``spark.range`` and reduced to counts per
    (b, rank) before it meets the id table.  ``mode='membership'`` caps the
    weight at 1 (each drawn id counts once).
    """
    r = ranked_ids(df, id_col, seed)
    n_ids = r.agg(F.max("n")).first()[0] or 0   # one scalar
    spark = df.sparkSession
    if n_ids == 0:
        return spark.createDataFrame([], f"b int, {id_col} long, weight long")
    draws = spark.range(0, int(n_boot) * int(n_ids))
    b = (F.col("id") / F.lit(n_ids)).cast("bigint")
    j = F.col("id") - b * F.lit(n_ids)
    picks = draws.select(b.cast("int").alias("b"),
                         F.pmod(hash_bigint("draw", seed, b, j), F.lit(n_ids)).alias("rank"))
    counts = picks.groupBy("b", "rank").agg(F.count(F.lit(1)).alias("weight"))
    out = counts.join(r.select(id_col, "rank"), "rank").select("b", id_col, "weight")
    if mode == "membership":
        out = out.select("b", id_col, F.least(F.col("weight"), F.lit(1)).alias("weight"))
    return out


def draw_lists(weights: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, _draws): the replicates an id is drawn in, with its weights; one row per drawn id, at most ``n_boot`` entries."""
    entry = F.struct(F.col("b").cast("int").alias("b"), F.col("weight").cast("double").alias("w"))
    return weights.groupBy(id_col).agg(F.collect_list(entry).alias("_draws"))


def draw_matrix(lists: pa.Array, rows: np.ndarray, n_boot: int) -> np.ndarray:
    """(rows, n_boot) weights of the given rows of an Arrow column of draw lists."""
    lists = lists.take(pa.array(rows))
    many = lists.value_lengths().to_numpy(zero_copy_only=False)
    got = lists.flatten()
    out = np.zeros((len(rows), n_boot))
    out[np.repeat(np.arange(len(rows)), many), got.field("b").to_numpy()] = got.field("w").to_numpy()
    return out


def replicate_rows(acc: np.ndarray):
    """One Arrow row (b, v) for each replicate with anything in it."""
    hit = np.flatnonzero(acc.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array([acc[b].tobytes() for b in hit], pa.binary())], ["b", "v"])


def summed_replicates(parts: DataFrame) -> DataFrame:
    """(b, v): the vectors of all tasks added up, a replicate in one place (tasks x replicates rows, whatever the input)."""
    def add(batches):
        now, total = None, None
        for batch in batches:
            done = []
            for b, v in zip(batch.column("b").to_pylist(), batch.column("v").to_pylist()):
                if b == now:
                    total = total + np.frombuffer(v)
                    continue
                if now is not None:
                    done.append((now, total.tobytes()))
                now, total = b, np.frombuffer(v)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in done], pa.int32()), pa.array([v for _, v in done], pa.binary())], ["b", "v"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["b", "v"])

    return parts.repartition("b").sortWithinPartitions("b").mapInArrow(add, "b int, v binary")


def ranked_ids_by(df: DataFrame, by: str, id_col: str = "id", seed: int | str = 42) -> DataFrame:
    """(by, id, rank, n): the ranks of ``ranked_ids`` within every group of ``by`` (few groups, many ids)."""
    ids = df.where(F.col(id_col).isNotNull()).select(by, id_col).distinct().withColumn("_h", hash_bigint(seed, F.col(id_col)))
    ids = ids.withColumn("_bk", F.shiftright("_h", HASH_HEX_DIGITS * 4 - BUCKET_BITS))
    order = Window.partitionBy(by).orderBy("_bk")                                      # at most 65,536 rows a group
    sizes = ids.groupBy(by, "_bk").agg(F.count(F.lit(1)).alias("_sz")).select(
        by, "_bk", F.coalesce(F.sum("_sz").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_sz").over(Window.partitionBy(by)).alias("n"))
    within = F.row_number().over(Window.partitionBy(by, "_bk").orderBy("_h", id_col)) - 1
    return ids.withColumn("_rk", within).join(sizes, [by, "_bk"]).select(by, id_col, (F.col("_off") + F.col("_rk")).cast("bigint").alias("rank"), F.col("n").cast("bigint").alias("n"))


def _split(rank, n, test_size: float, val_size: float | None):
    n = n.cast("double")
    n_test = F.greatest(F.lit(1.0), F.bround(F.lit(float(test_size)) * n, 0))
    split = F.when(rank < n_test, F.lit("test"))
    if val_size is not None:
        n_val = F.greatest(F.lit(1.0), F.bround(F.lit(float(val_size)) * (n - n_test), 0))
        split = split.when(rank < n_test + n_val, F.lit("val"))
    return split.otherwise(F.lit("train"))


def split_ids_by(df: DataFrame, by: str, id_col: str = "id", test_size: float = 0.15, val_size: float | None = 0.15, seed: int | str = 42) -> DataFrame:
    """(by, id, split): the split of ``split_ids`` over the ids of every group of ``by``."""
    r = ranked_ids_by(df, by, id_col, seed)
    return r.select(by, id_col, _split(F.col("rank"), F.col("n"), test_size, val_size).alias("split"))


def bootstrap_weights_by(df: DataFrame, by: str, n_boot: int = 300, id_col: str = "id", seed: int | str = 42) -> DataFrame:
    """(by, b, id, weight): the draws of ``bootstrap_weights`` within every group of ``by`` in one plan.

    ``by`` has few values (horizons, models): their id counts are collected and give each group
    its range of the draw table.
    """
    ranked = ranked_ids_by(df, by, id_col, seed)
    ids = df.where(F.col(id_col).isNotNull()).select(by, id_col).distinct()
    counts = sorted((r[0], r[1]) for r in ids.groupBy(by).agg(F.count(F.lit(1))).collect())
    draws = None
    for value, n in counts:
        at = F.col("id")
        b = (at / F.lit(n)).cast("bigint")
        leg = df.sparkSession.range(0, int(n_boot) * n).select(
            F.lit(value).alias(by), b.cast("int").alias("b"), F.pmod(hash_bigint("draw", seed, b, at - b * F.lit(n)), F.lit(n)).alias("rank"))
        draws = leg if draws is None else draws.unionByName(leg)
    if draws is None:
        kind = df.schema[by].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{by}` {kind}, b int, {id_col} long, weight long")
    return draws.groupBy(by, "b", "rank").agg(F.count(F.lit(1)).alias("weight")).join(ranked.drop("n"), [by, "rank"]).select(by, "b", id_col, "weight")


def parameter_grid(spark, grid: dict[str, list]) -> DataFrame:
    """Cross product of settings as a table (param_id, params map) (F5); grids are small configs."""
    import itertools
    keys = sorted(grid)
    rows = []
    for i, vals in enumerate(itertools.product(*[grid[k] for k in keys])):
        rows.append((i, {k: str(v) for k, v in zip(keys, vals)}))
    return spark.createDataFrame(rows, "param_id int, params map<string,string>")


def sample_rows(df: DataFrame, n: int, key_cols, seed: int | str = 42) -> DataFrame:
    """Deterministic sample of ``n`` rows without replacement (O4, F6): the n smallest
    hashes.  The limit is the feature (a fixed-size sample); planned as TakeOrdered."""
    return df.orderBy(hash_bigint("sample", seed, *[F.col(c) for c in key_cols]), *key_cols).limit(int(n))
