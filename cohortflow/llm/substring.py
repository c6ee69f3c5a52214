"""Substring de-duplication by line and sentence hashing.

A text is cut into units: lines, and the sentences of a line (a word that ends in ``.``, ``!`` or
``?`` ends a unit).  A unit is normalised (A-Z lower-cased, white space collapsed) and hashed.
Digests are grouped over all documents; the occurrence of least rank (document id, then place)
stays.  Later occurrences go if they stand in a run of such units of at least ``min_words``
words, so a passage goes as a whole and short common sentences stay.  With ``whole_lines`` lines
are hashed as lines, too, and every later occurrence of one goes, however short; the floor then
holds only for sentences inside a line.  What goes is given as spans of the original text (code
points).

Scale: a task first groups the digests of its own batch, and only the first occurrence in a batch
is sent on; a line that stands in a third of all documents is one row per batch.  The digests
are dealt and sorted by Spark and read as a stream, never gathered.  The texts move once, to
meet their list of repeated units.

Cases: null texts stay null; texts without a word stay as they are; rows that repeat id and text
are one occurrence and end alike; rows that repeat an id with another text are ordered by a hash
of the text; null ids rank last; no rows give no rows.  Other columns can be kept by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import Words, combine, released, slices, staged, texts_of

MIN_WORDS = 20
LINE = 1 << 30                          # added to the place of a line's first unit where the line itself is meant
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True


class Units:
    """Units of several texts: ``text`` index, ``place`` in it, digests, ``words`` and the byte places of each.

    ``line`` holds for every unit the number of its line, ``line_first`` the first unit of every line.
    """

    def __init__(self, texts: list[str]):
        w = Words(texts)
        n = len(w.start)
        owner = np.repeat(np.arange(len(texts)), w.count)
        if not n:
            self.text = self.place = self.words = self.start = self.stop = np.zeros(0, dtype=np.int64)
            self.line = self.line_first = self.line_key = np.zeros(0, dtype=np.int64)
            self.key, self.more = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
            self.line_more = self.more
            return
        lines = np.zeros(len(w.buf) + 1, dtype=np.int64)
        np.cumsum(w.buf == 10, out=lines[1:])
        breaks = np.ones(n, dtype=bool)                # words that end a line
        breaks[:-1] = (lines[w.start[1:]] != lines[w.end[:-1]]) | (owner[1:] != owner[:-1])
        ends = _STOP[w.buf[w.end - 1]] | breaks
        first = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
        self.text = owner[first]
        self.words = np.diff(first, append=n)
        at = np.searchsorted(self.text, np.arange(len(texts)))
        self.place = np.arange(len(first)) - at[self.text]
        self.key = combine(w.hash, first).view(np.int64)
        self.more = (combine(w.hash, first, salt=1) & np.uint64(0x7FFFFFFF)).astype(np.int32)
        opens = np.append(True, breaks[:-1])
        self.line = np.cumsum(opens[first]) - 1
        self.line_first = np.flatnonzero(opens[first])
        at_line = np.flatnonzero(opens)
        self.line_key = combine(w.hash, at_line, salt=2).view(np.int64)
        self.line_more = (combine(w.hash, at_line, salt=3) & np.uint64(0x7FFFFFFF)).astype(np.int32)
        # a unit reaches to the first word of the next one, the last to the end of its text
        begin = w.chars(np.concatenate([w.start[first], w.base[self.text], (w.base + w.size)[self.text]])).reshape(3, -1)
        self.start = begin[0] - begin[1]
        self.stop = np.where(np.append(self.text[1:] == self.text[:-1], False), np.append(self.start[1:], 0), begin[2] - begin[1])


def unit_rows(docs: DataFrame, whole_lines: bool = False) -> DataFrame:
    """(key, more, doc_id, tie, place, again) of all units of (doc_id, text, tie); ``again``: not the first of its batch.

    With ``whole_lines`` the lines follow as units of their own, at ``LINE`` + their first unit.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, ties, texts = batch.column("doc_id"), batch.column("tie").to_numpy(), texts_of(batch.column("text"))
            rank = _ranks(ids, ties)
            parts = []
            for a, b in slices(texts):
                u = Units(texts[a:b])
                parts.append((u.key, u.more, u.text + a, u.place))
                if whole_lines:
                    parts.append((u.line_key, u.line_more, u.text[u.line_first] + a, u.place[u.line_first] + LINE))
            if not parts:
                continue
            key, more, text, place = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((place, rank[text], more, key))
            same = np.zeros(len(key), dtype=bool)
            k, m, r, p = key[order], more[order], rank[text[order]], place[order]
            same[1:] = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
            copy = np.zeros(len(key), dtype=bool)                 # the same occurrence of a repeated row
            copy[1:] = same[1:] & (r[1:] == r[:-1]) & (p[1:] == p[:-1])
            head = np.maximum.accumulate(np.where(~same, np.arange(len(key)), 0))
            again = same & ((r != r[head]) | (p != p[head]))
            pick = order[~copy]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[pick]), pa.array(more[pick]), ids.take(pa.array(text[pick])), pa.array(ties[text[pick]]),
                 pa.array(place[pick].astype(np.int32)), pa.array(again[~copy])],
                ["key", "more", "doc_id", "tie", "place", "again"])

    return docs.select("doc_id", "text", "tie").mapInArrow(released(run), f"key bigint, more int, doc_id {kind}, tie bigint, place int, again boolean")


def _ranks(ids, ties: np.ndarray) -> np.ndarray:
    """Order of the rows of a batch by (id, nulls last, tie); equal rows share a rank."""
    values = ids.to_pylist()
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, values[i] if values[i] is not None else 0, ties[i]))
    rank = np.zeros(len(values), dtype=np.int64)
    for n, i in enumerate(order):
        before = order[n - 1] if n else i
        rank[i] = n if n == 0 or (values[i], ties[i]) != (values[before], ties[before]) else rank[before]
    return rank


def later_occurrences(units: DataFrame) -> DataFrame:
    """(doc_id, tie, place) of every unit that is not the first of its digest; ``units`` is staged."""
    kind = units.schema["doc_id"].dataType.simpleString()
    heads = units.where(~F.col("again")).repartition("key", "more").sortWithinPartitions(
        "key", "more", F.col("doc_id").asc_nulls_last(), "tie", "place")

    def run(batches):
        last = None                                    # (key, more) and the occurrence that stays, across batches
        for batch in batches:
            key, more = batch.column("key").to_numpy(), batch.column("more").to_numpy()
            tie, place = batch.column("tie").to_numpy(), batch.column("place").to_numpy()
            ids = batch.column("doc_id")
            start = np.ones(len(key), dtype=bool)
            start[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
            start[0] = last is None or (key[0], more[0]) != last[0]
            head = np.maximum.accumulate(np.where(start, np.arange(len(key)), -1))
            later = np.flatnonzero(~start)
            keep = []
            for i in later.tolist():                   # only rows of repeated digests
                mine = (ids[i].as_py(), int(tie[i]), int(place[i]))
                kept = last[1] if head[i] < 0 else (ids[int(head[i])].as_py(), int(tie[head[i]]), int(place[head[i]]))
                if mine != kept:
                    keep.append(i)
            if len(key):
                h = int(head[-1])
                if h >= 0:
                    last = ((key[h], more[h]), (ids[h].as_py(), int(tie[h]), int(place[h])))
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pick), pa.array(tie[keep]), pa.array(place[keep])], ["doc_id", "tie", "place"])

    found = heads.select("key", "more", "doc_id", "tie", "place").mapInArrow(released(run), f"doc_id {kind}, tie bigint, place int")
    return units.where("again").select("doc_id", "tie", "place").unionByName(found)


def spans(u: Units, mine: np.ndarray, repeated: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) units of one text's runs that go; ``mine`` are its units.

    Runs of fewer than ``min_words`` words stay, but for the repeated lines in them.
    """
    at = np.array(repeated, dtype=np.int64)
    lines = np.isin(u.line[mine], u.line[mine[at[at >= LINE] - LINE]])
    flag = np.zeros(len(mine) + 2, dtype=np.int8)
    flag[1 + at[at < LINE]] = 1
    first, last = _runs(flag)
    words = np.concatenate([[0], np.cumsum(u.words[mine])])
    short = words[last + 1] - words[first] < min_words
    for f, x in zip(first[short], last[short]):
        flag[f + 1:x + 2] = lines[f:x + 1]
    return _runs(flag)


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(flag))
    return edge[0::2], edge[1::2] - 1


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, keep: tuple[str, ...] = (), whole_lines: bool = False) -> DataFrame:
    """One row per input row: doc_id, *keep, text without the repeated passages, n_units, n_removed, removed_words, starts, lengths.

    ``whole_lines``: every later occurrence of a line goes, whatever ``min_words`` is.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k_{c}") for c in keep]).withColumn("tie", F.xxhash64("text"))
    units = staged(unit_rows(d, whole_lines), "substring-units")
    lists = later_occurrences(units).groupBy("doc_id", "tie").agg(F.collect_set("place").alias("repeated")).select(
        F.col("doc_id").alias("r_id"), F.col("tie").alias("r_tie"), "repeated")        # at most the units of one text
    met = d.join(lists, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tie") == F.col("r_tie")), "left").drop("r_id", "r_tie", "tie")
    kept = [f"k_{c}" for c in keep]

    def run(batches):
        for batch in batches:
            texts, repeated = batch.column("text").to_pylist(), batch.column("repeated").to_pylist()
            out, count, gone, words, starts, lengths = [], [], [], [], [], []
            for a, b in slices([t or "" for t in texts]):
                u = Units([t or "" for t in texts[a:b]])
                at = np.searchsorted(u.text, np.arange(b - a + 1))
                for i in range(a, b):
                    mine = np.arange(at[i - a], at[i - a + 1])
                    count.append(len(mine))
                    first, last = spans(u, mine, repeated[i], min_words) if repeated[i] else ((), ())
                    s, e = ([int(u.start[mine[f]]) for f in first], [int(u.stop[mine[x]]) for x in last])
                    text = texts[i]
                    if s:
                        text = "".join(text[x:y] for x, y in zip([0, *e], [*s, len(text)]))
                    out.append(text)
                    gone.append(sum(int(x) - int(f) + 1 for f, x in zip(first, last)))
                    words.append(sum(int(u.words[mine[f]:mine[x] + 1].sum()) for f, x in zip(first, last)))
                    starts.append(s)
                    lengths.append([y - x for x, y in zip(s, e)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[batch.column(c) for c in kept], pa.array(out, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(words, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64()))],
                ["doc_id", *keep, "text", "n_units", "n_removed", "removed_words", "starts", "lengths"])

    types = {f.name: f.dataType.simpleString() for f in met.schema}
    schema = ", ".join([f"doc_id {types['doc_id']}", *[f"`{c}` {types[f'k_{c}']}" for c in keep]])
    return met.mapInArrow(released(run), f"{schema}, text string, n_units bigint, n_removed bigint, removed_words bigint, starts array<bigint>, lengths array<bigint>")
