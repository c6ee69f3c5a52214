"""Helpers shared by the training-data operators: tables, staging, batch slicing and array hashing."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.session import checkpoint_dir

#: Characters of text handled by one numpy pass inside a task.  Bounds the arrays a task
#: builds whatever the Arrow batch holds; one longer text makes a pass of its own.
SLICE_CHARS = 250_000


#: bytes of one Arrow batch sent to a task's Python worker; rows alone would not bound long texts
BATCH_BYTES = 6 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df`` with the Arrow batches of its session bounded in bytes as well as in rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) != str(BATCH_BYTES):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage with files every executor can read, so a lost executor costs a
    re-read and never a recomputation of what lies before.
    """
    spark = bounded(df).sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, so that the shared folder holds only what later steps need."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t.staged_at
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def id_crc(col: str):
    """crc32 of an id written as text, null as the empty text (the rule of the held-out parts)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def slices(texts, limit: int = SLICE_CHARS):
    """Yield (from, to) ranges of a list of str whose lengths sum to at most ``limit`` (or hold one text)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def released(run):
    """``run`` for ``mapInArrow``, after which the reused worker gives its free Arrow memory back."""
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return tidy


def texts_of(column) -> list[str]:
    """An Arrow column of texts as str, null as the empty text."""
    return [t if t is not None else "" for t in column.to_pylist()]


# ------------------------------------------------------------------ array hashing

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)   # public 64-bit finaliser constants
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S33
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2^64
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POW: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base (or of its inverse) modulo 2^64."""
    key = "inv" if inverse else "pow"
    have = _POW.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, _INV if inverse else _BASE, dtype=np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if size <= 1 << 23:
            _POW[key] = have
    return have[:n]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BYTE = np.where(_SPACE, np.uint64(0), _BYTE)


class Words:
    """The lower-cased (A-Z) words of several texts, found in one numpy pass over their UTF-8 bytes.

    Words are runs of anything but ASCII white space.  ``hash`` (64 bits), ``start`` and ``end``
    (places in ``buf``) have one value per word, text after text; ``count`` words belong to each
    text, whose bytes are ``buf[base:base + size]``.
    """

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.base = np.cumsum(self.size + 1) - self.size - 1
        self.buf = buf = _LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
        word = ~_SPACE[buf]
        edge = np.flatnonzero(np.append(word[0], word[1:] != word[:-1]))
        self.start, self.end = edge[0::2], edge[1::2]
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        value = _WORD_BYTE[buf]
        value *= powers(len(buf))
        np.cumsum(value, out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(len(buf), inverse=True)[self.start]
        self.hash = mix64(h + (self.end - self.start).astype(np.uint64))
        upto = np.searchsorted(self.start, self.base + self.size + 1)
        self.count = np.diff(upto, prepend=0)

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before each place of ``buf`` (all texts and separators counted)."""
        before = np.zeros(len(self.buf) + 1, dtype=np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=before[1:])
        return before[at]


_ORDER = mix64(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def combine(parts: np.ndarray, at: np.ndarray, salt: int = 0) -> np.ndarray:
    """One 64-bit hash for each run of ``parts`` that starts at ``at``; the order within a run counts."""
    size = np.diff(at, append=len(parts))
    place = np.arange(len(parts)) - np.repeat(at, size)
    total = np.add.reduceat(parts * _ORDER[place % len(_ORDER)] ^ (parts >> np.uint64(7)) * np.uint64(2 * salt + 1), at)
    return mix64(total + size.astype(np.uint64))
