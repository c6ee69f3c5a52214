"""Best-fit packing of tokenised documents into sequences of at most ``SIZE`` tokens.

Bulk-synchronous best fit.  Pieces and gaps are range-sorted by size; sizes are integers up to
``SIZE``, so a range is one size and all pieces of a size are alike for the fit.  A round takes
the pieces of one size, largest first, and sweeps over the gaps to the successors: the smallest
gap that holds the piece, then the next.  Within a size, pieces meet gaps by rank: the k-th piece
takes the k-th gap, so no two claim the same one.  The gaps shrink and the next round begins;
where no gap is left, new sequences open.  This is best-fit decreasing.

What is swept are runs of equal gaps (first sequence, number), not rows: the histogram of piece
sizes (at most ``SIZE`` numbers) is all that reaches the driver, and the rounds give a table of
rank intervals whose size depends on ``SIZE``, not on the number of documents.  The rows are
ranked within their size by Spark and look their interval up in their own task.

Ranks come without one task per size: a size with many pieces is dealt into buckets by a hash,
each bucket is ranked, and the buckets' counts give the offsets.

Cases: a null text is the empty text, one piece with the end id only; a text that holds the name
of a special token, or more than ``LONGEST_RUN`` characters of white space in a row, is encoded by
the reference tokenizer, as all others are by an equal and faster one; repeated rows are pieces of their own; no rows give no pieces; other columns are
ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import bounded, released, staged, texts_of

SIZE = 2048
END_ID = 0
BUCKET_ROWS = 20_000
LONGEST_RUN = 100_000             # white space in a row that the fast form of the vocabulary gets; it fails near a million
_RUN = re.compile(r"\s+")


def tokenizer_paths() -> tuple[str, str]:
    """The vocabulary in both file formats (public tokenizers of the machine)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoder(paths: tuple[str, str]):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(paths[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(paths[0])
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    return fast, full, special


def has_long_run(text: str) -> bool:
    return len(text) > LONGEST_RUN and any(m.end() - m.start() > LONGEST_RUN for m in _RUN.finditer(text))


def token_ids(text: str, paths: tuple[str, str]) -> list[int]:
    """Ids of a whole text.  Texts with a special token's name, or with a run that the fast form's pattern could not stand
    (it recurs once per character of white space), go through the file of the vocabulary itself."""
    fast, full, special = _encoder(paths)
    if any(s in text for s in special) or has_long_run(text):
        return full.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, the first may be shorter."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, paths: tuple[str, str] | None = None,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row's tokens, the end id included."""
    paths = paths or tokenizer_paths()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            rows, ids_out = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                ids = np.array([*token_ids(text, paths), END_ID], dtype="<u4")
                for k, (start, n) in enumerate(cut(len(ids), size)):
                    part = ids[start:start + n]
                    rows.append((doc_id, k, start, n, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            cols = list(zip(*rows)) if rows else [[]] * 5
            arrays = [pa.array(cols[0], id_type), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else []), names)

    return bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        released(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Rank intervals (length, rank from, rank to, first sequence, offset) and the number of sequences.

    The pieces of ``length`` with ranks from..to-1 go to consecutive sequences at ``offset``.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]      # by gap: runs (first sequence, number)
    out, opened = [], 0
    for length in range(size, 0, -1):
        n, rank = histogram.get(length, 0), 0
        gap = length
        while rank < n and gap <= size:
            if not gaps[gap]:
                gap += 1
                continue
            first, many = gaps[gap].pop()
            k = min(many, n - rank)
            if k < many:
                gaps[gap].append((first + k, many - k))
            out.append((length, rank, rank + k, first, size - gap))
            rest = gap - length
            gaps[rest].append((first, k))
            rank += k
            gap = max(length, min(gap, rest))         # the shrunken gap may be the best fit of the next
        left, fit = n - rank, size // length
        for many, layers in ((left // fit, fit), (1, left % fit)):
            if many and layers:
                for j in range(layers):
                    out.append((length, rank, rank + many, opened, j * length))
                    rank += many
                gaps[size - layers * length].append((opened, many))
                opened += many
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5), opened


def ranked(cut_pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``rank``: 0, 1, .. among the pieces of a length, in the order of a hash."""
    spark = cut_pieces.sparkSession
    dealt = spark.createDataFrame([(k, -(-n // BUCKET_ROWS)) for k, n in histogram.items()], "length bigint, buckets bigint")   # at most SIZE rows
    rows = cut_pieces.join(F.broadcast(dealt), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (rows.withColumn("place", F.row_number().over(inside) - 1).join(base, ["length", "bucket"])
            .withColumn("rank", F.col("base") + F.col("place")).drop("bucket", "base", "place"))


def place(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of staged pieces."""
    histogram = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}      # at most SIZE rows
    intervals, _ = plan(histogram, size)
    shift = 1 << 48
    keys = intervals[:, 0] * shift + intervals[:, 1] if len(intervals) else np.zeros(0, dtype=np.int64)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = intervals[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:5]], pa.array(row[:, 3] + rank - row[:, 1], pa.int64()), pa.array(row[:, 4].copy(), pa.int64())], names)

    kind = cut_pieces.schema["doc_id"].dataType.simpleString()
    return ranked(cut_pieces.select(*names[:5]), histogram).select(*names[:5], "rank").mapInArrow(
        released(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, paths: tuple[str, str] | None = None) -> DataFrame:
    """Tokenise, cut and place all documents: one row per piece."""
    return place(staged(pieces(docs, id_col, text_col, size, paths), "pack-pieces"), size)


def sequences(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, paths: tuple[str, str] | None = None) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, at most ``size`` each."""
    with_ids = pieces(docs, id_col, text_col, size, paths, with_ids=True).select("doc_id", "piece", "ids")
    parts = placed.select("doc_id", "piece", "sequence_id", "offset").join(with_ids, ["doc_id", "piece"])
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
