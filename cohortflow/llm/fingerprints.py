"""Document fingerprints by locally consistent parsing.

The UTF-8 bytes of a text are the symbols of level 0.  Each level collapses runs of one symbol,
tosses coins deterministically (the lowest bit in which a symbol differs from its left neighbour,
with that bit's value, repeated until fewer than 6 labels are left), cuts a phrase at every local
maximum of the labels, and names each phrase by a hash of its symbols.  A cut depends on a few
neighbouring symbols only, so equal substrings get equal names inside, wherever they stand.
The names of the coarser levels are the signature set of the text; its fingerprint is a
one-permutation min-hash sketch of that set (64 bins of 16 bits, hexadecimal).

All texts of a slice are parsed together by numpy, level by level: linear in the bytes, with
arrays bounded by ``SLICE`` characters or one text.

Cases: null is the empty text, whose sketch has only empty bins; two empty sketches are alike (1),
an empty and a full one are not (0); short texts use finer levels, down to single bytes; equal
texts have equal fingerprints; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import bounded, mix64, released, slices, texts_of

BINS = 64
SLICE = 250_000
#: phrases wanted at the first level of the signature set, and the first level of long texts
LEAST_PHRASES, FIRST_LEVEL = 8, 3
EMPTY = np.uint16(0xFFFF)
_CTZ = np.array([8] + [(x & -x).bit_length() - 1 for x in range(1, 256)], dtype=np.uint8)
_WEIGHTS = mix64(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)
_BYTES = mix64(np.arange(1000, 1256, dtype=np.uint64))
_RUN = np.uint64(0x9E3779B97F4A7C15)


def _toss_small(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One toss over labels below 256; ``first`` holds the places without a left neighbour."""
    differ = np.empty_like(label)
    differ[1:] = label[1:] ^ label[:-1]
    differ[first] = 1
    bit = np.minimum(_CTZ[differ], 7)
    return (bit << 1) | ((label >> bit) & 1)


def _toss_names(name: np.ndarray, first: np.ndarray) -> np.ndarray:
    differ = np.empty_like(name)
    differ[1:] = name[1:] ^ name[:-1]
    differ[first] = 1
    bit = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    bit = np.minimum(bit, 63)
    return ((bit << 1) | ((name >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)


def _runs(symbol: np.ndarray, first: np.ndarray):
    """Places where a run of one symbol starts, the run lengths, and where the texts' first runs are."""
    start = np.empty(len(symbol), dtype=bool)
    start[1:] = symbol[1:] != symbol[:-1]
    start[first] = True
    at = np.flatnonzero(start)
    return at, np.diff(at, append=len(symbol)), np.searchsorted(at, first)


def _phrases(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Phrase starts: the first symbol of a text and every local maximum of the labels."""
    up = np.empty(len(label), dtype=bool)
    up[1:] = label[1:] > label[:-1]
    up[first] = False                    # no neighbour across texts
    cut = up.copy()
    cut[:-1] &= ~up[1:]
    cut[first] = True
    return np.flatnonzero(cut)


def _names(symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
    size = np.diff(at, append=len(symbol))
    place = np.arange(len(symbol)) - np.repeat(at, size)
    total = np.add.reduceat(symbol * _WEIGHTS[place % len(_WEIGHTS)], at)
    return mix64(total + size.astype(np.uint64))


def signature_names(raw: list[bytes]):
    """Levels of phrase names of non-empty byte strings: a list of (names, first places), level 1 upward."""
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    first = np.cumsum([0] + [len(r) for r in raw[:-1]])
    at, size, first = _runs(buf, first)
    plain = buf[at]
    symbol = _BYTES[plain]
    longer = np.flatnonzero(size > 1)
    symbol[longer] = mix64(symbol[longer] + size[longer].astype(np.uint64) * _RUN)
    label = plain
    for _ in range(3):
        label = _toss_small(label, first)
    levels = [(symbol, first)]
    while True:
        cuts = _phrases(label, first)
        name = _names(symbol, cuts)
        first = np.searchsorted(cuts, first)
        levels.append((name, first))
        if len(name) == len(raw):
            return levels
        at, size, first = _runs(name, first)
        symbol = name[at]
        label = _toss_names(symbol, first)
        longer = np.flatnonzero(size > 1)
        symbol[longer] = mix64(symbol[longer] + size[longer].astype(np.uint64) * _RUN)
        for _ in range(3):
            label = _toss_small(label, first)


def sketches(texts: list[str]) -> np.ndarray:
    """One row of ``BINS`` 16-bit values for each text; empty bins hold 0xFFFF."""
    out = np.full((len(texts), BINS), EMPTY, dtype=np.uint16)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for a, b in slices(raw, SLICE):
        rows = np.array([i for i in range(a, b) if raw[i]], dtype=np.int64)
        if not len(rows):
            continue
        levels = signature_names([raw[i] for i in rows])
        counts = [np.diff(first, append=len(name)) for name, first in levels]
        start = np.zeros(len(rows), dtype=np.int64)      # the coarsest level up to FIRST_LEVEL with enough phrases
        for k in range(1, min(FIRST_LEVEL, len(levels) - 1) + 1):
            start[counts[k] >= LEAST_PHRASES] = k
        least = np.full(len(rows) * BINS, np.uint32(0xFFFFFFFF))
        for k, (name, first) in enumerate(levels):
            use = start <= k
            if k > 1:
                use &= counts[k - 1] > 1         # a text ends with its root, whatever its neighbours need
            if not use.any():
                continue
            row = np.repeat(np.arange(len(rows)), counts[k])
            keep = use[row]
            h = mix64(name[keep] + np.uint64(k))
            slot = row[keep] * BINS + (h >> np.uint64(58)).astype(np.int64)
            np.minimum.at(least, slot, ((h >> np.uint64(20)) & np.uint64(0xFFFFFFFE)).astype(np.uint32))
        full = least != np.uint32(0xFFFFFFFF)
        # low bits of the least value: its high bits are small whatever the value is
        value = np.where(full, (mix64(least) & np.uint64(0x7FFF)).astype(np.uint16), EMPTY)
        out[rows] = value.reshape(len(rows), BINS)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the signature sets, row by row."""
    some = (a != EMPTY) | (b != EMPTY)
    same = (a == b) & some
    n = some.sum(axis=1)
    return np.where(n > 0, same.sum(axis=1) / np.maximum(n, 1), 1.0)


def to_hex(sketch: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in np.ascontiguousarray(sketch.astype(">u2"))]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row, without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(to_hex(sketches(texts)), pa.string())],
                ["doc_id", "n_chars", "fingerprint"])

    return bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        released(run), f"doc_id {kind}, n_chars bigint, fingerprint string")


def in_cells(docs: DataFrame, rows_a_cell: int = 500, most_cells: int = 20_000) -> DataFrame:
    """Adds ``cell``: ranges of descending ``doc_id`` of about equal row counts, null ids in the last.

    Cell bounds are values of ``doc_id`` fixed before the rows are dealt, so a recomputed task
    deals as before.  A cell is streamed, never held, so its size is free.
    """
    ids = docs.select(F.col("doc_id").cast("double").alias("x")).where(F.col("x").isNotNull())
    n = ids.count()
    k = max(1, min(most_cells, n // rows_a_cell))
    bounds = sorted(set(ids.approxQuantile("x", [i / k for i in range(1, k)], 0.1 / k))) if k > 1 else []
    if not bounds:
        return docs.withColumn("cell", F.when(F.col("doc_id").isNull(), 1).otherwise(0))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="x", outputCol="up", handleInvalid="keep")
    top = len(bounds)
    return (cut.transform(docs.withColumn("x", F.col("doc_id").cast("double")))
            .withColumn("cell", F.when(F.col("doc_id").isNull(), top + 1).otherwise(top - F.col("up")).cast("int")).drop("x", "up"))


def with_follower(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in cells, with one more row (``extra``) that ends each cell: the next cell's first.

    Rows are dealt by cell and sorted by descending ``doc_id`` within it, so that each row's
    follower is the row after it in the same task.  Equal ids are ordered by a hash of the text.
    """
    rows = in_cells(docs).withColumn("tie", F.xxhash64("text"))
    heads = rows.groupBy("cell").agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    order = Window.orderBy("cell")                     # one narrow row per cell
    ring = heads.select("cell", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("head"))
    # the first row of a cell has the greatest (doc_id, tie); its text comes back by these two
    wanted = ring.select(F.col("cell").alias("to_cell"), F.col("head.doc_id").alias("h_id"), F.col("head.tie").alias("h_tie"))
    # at most ``most_cells`` narrow rows: broadcast, so that the texts are not shuffled to find a few
    extra = (rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie")))
             .dropDuplicates(["to_cell"]).select("doc_id", "text", F.col("to_cell").alias("cell"), "tie", F.lit(True).alias("extra")))
    dealt = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    return dealt.repartition("cell").sortWithinPartitions(F.col("cell"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("tie").desc())


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and their likeness.

    The edited text has the last half of a text replaced by the first code points of the next
    document in descending ``doc_id`` (the first follows the last).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    d = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        held = []                                      # the last row so far: its follower is still to come
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            rows = held + list(zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")),
                                   batch.column("cell").to_pylist(), batch.column("extra").to_pylist()))
            held = rows[-1:]
            for a, b in slices([r[1] for r in rows], SLICE):
                part = rows[a:b + 1]
                texts = [r[1] for r in part]
                own = [i for i in range(len(part) - 1) if not part[i][3] and part[i][2] == part[i + 1][2]]
                edited = []
                for i in own:
                    half = len(texts[i]) // 2
                    edited.append(texts[i][:len(texts[i]) - half] + texts[i + 1][:half])
                sketch, changed = sketches(texts), sketches(edited)
                mine, after = sketch[own], sketch[[i + 1 for i in own]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part[i][0] for i in own], id_type),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                    pa.array(to_hex(mine), pa.string()), pa.array(to_hex(changed), pa.string()),
                    pa.array(likeness(mine, changed)), pa.array(likeness(mine, after))], names)

    return with_follower(d).select("doc_id", "text", "cell", "extra").mapInArrow(
        released(run), f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
