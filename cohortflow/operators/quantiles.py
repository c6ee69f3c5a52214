"""Exact quantiles (numpy's linear interpolation) by counting, without moving rows.

A float64 is mapped to an unsigned integer of the same order, and the integer is read 16 bits at
a time.  A pass counts, for every wanted rank, the values by their next 16 bits among those that
share the bits found so far; tasks count in numpy and Spark sums the counts, so what is shuffled
is a histogram and never a row.  A window over the histogram finds the bits that hold the rank.
Four passes give the order statistic exactly; as soon as few values are left in all, they are
fetched instead.  Any number of columns, row sets (folds, groups) and ranks share the passes.

``percentile``, which buffers a group's values, is used only on small, bounded inputs (bootstrap
replicates, calibration bins).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 16
#: values still in question, over all ranks, that are fetched instead of counted once more
FEW = 50_000
#: digits that wait in a task until they are counted together
WAITING = 1 << 16
_SIGN = np.uint64(1 << 63)


@dataclass(frozen=True)
class RowSet:
    """All rows, the rows whose ``set_col`` is ``value``, all others, or those with bit ``bit`` of ``set_col`` set."""
    value: object = None
    without: bool = False
    bit: int | None = None


def _order_bits(x: np.ndarray) -> np.ndarray:
    bits = (x + 0.0).view(np.uint64)                       # + 0.0 makes -0.0 and 0.0 one value
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _values(bits: np.ndarray) -> np.ndarray:
    return np.where(bits & _SIGN, bits & ~_SIGN, ~bits).view(np.float64)


class _Digits:
    """Counts of digits; those that wait to be counted are bounded."""

    def __init__(self):
        self.digit, self.many = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.waiting: list = []
        self.size = 0

    def add(self, digit: np.ndarray) -> None:
        self.waiting.append(digit)
        self.size += len(digit)
        if self.size >= WAITING:
            self.counts()

    def counts(self):
        if self.waiting:
            own = np.sort(np.concatenate(self.waiting), kind="stable")                 # 16-bit integers: a radix sort
            start = np.flatnonzero(np.diff(own.astype(np.int64), prepend=-1))
            digit = np.concatenate([self.digit, own[start].astype(np.int64)])
            many = np.concatenate([self.many, np.diff(np.append(start, len(own)))])
            self.digit, place = np.unique(digit, return_inverse=True)
            self.many = np.bincount(place, weights=many, minlength=len(self.digit)).astype(np.int64)
            self.waiting, self.size = [], 0
        return self.digit, self.many


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], set_col: str | None = None,
                     sets: tuple[RowSet, ...] = (RowSet(),)) -> dict[tuple[RowSet, str], list[float | None]]:
    """Quantiles of every column over every row set, equal to ``numpy.quantile``; NULL and NaN are ignored."""
    names = [f"x{i}" for i in range(len(cols))]
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names)],
                     *([F.col(set_col).alias("s")] if set_col else []))
    spark = df.sparkSession
    targets = {(k, j): [np.uint64(0)] for k in range(len(sets)) for j in range(len(cols))}      # prefixes in question

    def picked(batch, k):
        s = sets[k]
        if s.bit is not None:
            return (batch.column("s").to_numpy() >> s.bit) & 1 == 1
        if s.value is None:
            return np.ones(batch.num_rows, dtype=bool)
        values = batch.column("s").to_pylist()
        same = np.array([v == s.value for v in values])
        known = np.array([v is not None for v in values])
        return (~same & known) if s.without else same

    def pass_over(step: int, wanted: dict, fetch: bool):
        """Counts (t, digit, n) of every prefix, or its values (t, bits)."""
        high = 64 - DIGIT * step                                    # bits below the prefix
        flat = [(k, j, p) for (k, j), ps in sorted(wanted.items()) for p in ps]

        def run(batches):
            counts: dict = {}
            for batch in batches:
                rows = {k: picked(batch, k) for k in {k for k, _, _ in flat}}
                bits, ok = {}, {}
                for t, (k, j, p) in enumerate(flat):
                    if j not in bits:
                        x = np.asarray(batch.column(names[j]).to_numpy(zero_copy_only=False), dtype=np.float64)
                        bits[j], ok[j] = _order_bits(x), ~np.isnan(x)
                    use = rows[k] & ok[j]
                    if step:
                        use &= (bits[j] >> np.uint64(high)) == p
                    own = bits[j][use]
                    if fetch:
                        if len(own):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, dtype=np.int32)), pa.array(own.view(np.int64)), pa.array(np.ones(len(own), dtype=np.int64))], ["t", "digit", "n"])
                    elif len(own):
                        digit = ((own >> np.uint64(high - DIGIT)) & np.uint64((1 << DIGIT) - 1)).astype(np.uint16)
                        counts.setdefault(t, _Digits()).add(digit)
            for t, mine in counts.items():
                digit, many = mine.counts()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(digit), t, dtype=np.int32)), pa.array(digit), pa.array(many)], ["t", "digit", "n"])

        return flat, data.mapInArrow(run, "t int, digit bigint, n bigint")

    # counts of the sets fix the ranks wanted
    need: dict = {}
    rank: dict = {}
    for step in range(64 // DIGIT):
        flat, hist = pass_over(step, targets, False)
        hist = hist.groupBy("t", "digit").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("t").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)    # at most 65,536 rows
        cum = hist.withColumn("upto", F.sum("n").over(upto))
        if step == 0:
            cum = cum.persist()                                     # the histogram of the first digits: read for the sizes, too
            sizes = {r["t"]: r["n"] for r in cum.groupBy("t").agg(F.max("upto").alias("n")).collect()}
            for t, (k, j, _) in enumerate(flat):
                n = sizes.get(t, 0)
                spots = []
                for q in probs:
                    pos = q * (n - 1)
                    lo = int(math.floor(pos))
                    spots.append((lo, min(lo + 1, n - 1), pos - lo))
                need[(k, j)] = (n, spots)
                for r in sorted({r for lo, hi, _ in spots for r in (lo, hi)}) if n else []:
                    rank[(k, j, r)] = (np.uint64(0), r)             # prefix so far, rank among its values
        at = {(k, j, int(p)): t for t, (k, j, p) in enumerate(flat)}
        rows = [(at[(k, j, int(p))], k, j, r, left) for (k, j, r), (p, left) in rank.items()]
        if not rows:
            break
        asked = spark.createDataFrame(rows, "t int, k int, j int, r bigint, rest bigint")       # columns x sets x ranks rows
        hit = (cum.join(F.broadcast(asked), "t").where((F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("n")))
               .select("k", "j", "r", "digit", "n", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")).collect())
        if step == 0:
            cum.unpersist()
        inside: dict = {}
        for h in hit:
            p = (rank[(h["k"], h["j"], h["r"])][0] << np.uint64(DIGIT)) | np.uint64(h["digit"])
            rank[(h["k"], h["j"], h["r"])] = (p, h["rest"])
            inside[(h["k"], h["j"], int(p))] = h["n"]
        targets = {}
        for k, j, p in inside:
            targets.setdefault((k, j), []).append(np.uint64(p))
        if step + 1 < 64 // DIGIT and sum(inside.values()) <= FEW:
            flat, left = pass_over(step + 1, targets, True)
            found: dict = {}
            for r in left.select("t", "digit").collect():
                found.setdefault(r["t"], []).append(r["digit"])
            at = {(k, j, int(p)): np.sort(np.array(found[t], dtype=np.int64).view(np.uint64)) for t, (k, j, p) in enumerate(flat) if t in found}
            rank = {key: (at[(key[0], key[1], int(p))][rest], 0) for key, (p, rest) in rank.items()}
            break
    value = {key: float(_values(np.array([p], dtype=np.uint64))[0]) for key, (p, _) in rank.items()}
    out = {}
    for k, s in enumerate(sets):
        for j, c in enumerate(cols):
            n, spots = need.get((k, j), (0, []))
            out[(s, c)] = [value[(k, j, lo)] + (value[(k, j, hi)] - value[(k, j, lo)]) * f for lo, hi, f in spots] if n else [None] * len(probs)
    return out


def exact_quantiles(df: DataFrame, col: str, probs) -> list[float | None]:
    """Quantiles of a numeric column, equal to ``numpy.quantile`` (NULL/NaN ignored)."""
    return column_quantiles(df, [col], list(probs))[(RowSet(), col)]


def grouped_percentiles(df: DataFrame, group_cols, col: str, probs) -> DataFrame:
    """Per-group exact percentiles for small groups (bounded by construction), e.g. per
    bootstrap replicate summaries.  Returns group columns + one array column ``q``."""
    return df.groupBy(*group_cols).agg(F.percentile(F.col(col).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
