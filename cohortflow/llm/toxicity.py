"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents and combining marks, and writes homoglyphs and digit
substitutions as one letter; lexicon and text are folded alike.  Lexicon entries are whole words
and word beginnings, learned from labels: the weight is the log odds of the share of toxic and
of clean documents that hold the entry, and only entries that chance would hardly give stay.
Phrases in which an entry stands in clean documents become exceptions: matches inside them do
not count.  The weights found in a text, at most one per word, are summed, normalised by the
text's length, and turned into a probability by a logistic curve, fitted across halves of the
labelled rows.

The labelled rows are sampled down to ``most_toxic`` and ``most_clean`` rows (documented bound of
the fit), so the label table joined to the texts is small by construction and texts are never
shuffled for it.  Learning aggregates in Spark; the lexicon is bounded because an entry needs a
share of at least ``support`` of the toxic rows.  Scoring is one pass over all whole texts.

Cases: null and empty texts have no match and get the score of such texts; without labels of both
kinds the lexicon is empty and scores are the share of toxic labels (0 without labels); repeated
rows score alike; repeated or conflicting labels of an id count once, toxic first; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import bounded, released, staged, texts_of

# Letters of other scripts that look like a Latin letter, and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ё": "e", "г": "r", "п": "n",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l", "ո": "n", "ս": "u", "օ": "o", "ց": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "i", "l": "i"}
#: harmless phrases that a caller may extend
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "circus clown", "pathetic fallacy")

_PREFIXES = (4, 5, 6, 7, 8, 9)
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"(?<=\w)!(?=\w)")


def _fold_table() -> dict:
    """Accented, full-width and mathematical letters by decomposition; then look-alikes and substitutes."""
    table: dict[int, str | None] = {}
    spans = [(0xAA, 0x250), (0x1E00, 0x1F00), (0xFF10, 0xFF5B), (0x2460, 0x24EA), (0x1D400, 0x1D800), (0x370, 0x530)]
    for a, b in spans:
        for c in range(a, b):
            plain = unicodedata.normalize("NFKD", chr(c)).lower()[:1]
            plain = HOMOGLYPHS.get(plain, plain)
            if plain.isascii() and plain.isalnum():
                table[c] = plain
    for c, plain in HOMOGLYPHS.items():
        table[ord(c)] = plain
    for c in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, *range(0xFE00, 0xFE10)):
        table[c] = None
    for c, plain in SUBSTITUTES.items():
        table[ord(c)] = plain
    return {c: (SUBSTITUTES.get(x, x) if x else x) for c, x in table.items()}


_TABLE = _fold_table()


def fold(text: str) -> str:
    text = text.lower().translate(_TABLE)
    return _MARK.sub("i", text) if "!" in text else text


def entries(text: str) -> set[str]:
    """Candidate entries of a folded text: ``word`` and, ending in ``*``, its beginnings."""
    out = set()
    for w in set(_WORD.findall(text)):
        if len(w) >= 3:
            out.add(w)
        for n in _PREFIXES:
            if len(w) > n:
                out.add(w[:n] + "*")
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        """Entries and exception phrases in one Aho-Corasick automaton; None if there is no entry."""
        found: dict[str, list] = {}
        for entry, w in self.weights.items():
            key = entry.rstrip("*")
            found.setdefault(key, [None, None, False])[1 if entry.endswith("*") else 0] = w
        for phrase in self.exceptions:
            found.setdefault(" ".join(_WORD.findall(fold(phrase))), [None, None, False])[2] = True
        if not self.weights:
            return None
        auto = ahocorasick.Automaton()
        for key, value in found.items():
            auto.add_word(key, (len(key), *value))
        auto.make_automaton()
        return auto


def matches(auto, text: str) -> dict[int, tuple[int, float]]:
    """{start of a word in the folded text: (end, weight)} outside exception phrases."""
    hits: dict[int, tuple[int, float]] = {}
    excused = []
    size = len(text)
    for end, (n, whole, start_of, phrase) in auto.iter(text):
        at = end - n + 1
        if at and text[at - 1].isalnum():
            continue
        closed = end + 1 == size or not text[end + 1].isalnum()
        if phrase and closed:
            excused.append((at, end))
        w = max(whole if whole is not None and closed else 0.0, start_of if start_of is not None else 0.0)
        if w > hits.get(at, (0, 0.0))[1]:
            hits[at] = (end, w)
    return {a: v for a, v in hits.items() if not any(s <= a <= e for s, e in excused)} if excused else hits


def features(auto, text: str) -> tuple[tuple[float, float, float], dict]:
    """(log of the summed weight, log of the weight for 1000 characters, greatest weight) of a folded text, and its matches."""
    hits = matches(auto, text) if auto is not None and text else {}
    total = sum(w for _, w in hits.values())
    return (math.log1p(total), math.log1p(1000.0 * total / (len(text) + 300)), max((w for _, w in hits.values()), default=0.0)), hits


def _score(curve, x: tuple[float, ...]) -> float:
    y = curve[0] + sum(c * v for c, v in zip(curve[1:], x))
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, y))))


def labelled(docs: DataFrame, labels: DataFrame, most_toxic: int = 20_000, most_clean: int = 40_000, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """(text, toxic) of a bounded sample of labelled rows, equal texts once (toxic first)."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, most_toxic / max(1, counts.get(1, 0)))).otherwise(min(1.0, most_clean / max(1, counts.get(0, 0))))
    place = F.pmod(F.xxhash64(F.lit("labels"), "__id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    some = one.where(place < share)                       # about most_toxic + most_clean rows of two numbers
    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = d.join(F.broadcast(some), "__id")
    return staged(rows.groupBy(F.md5(F.col("text").cast("binary")).alias("m")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).drop("m"), "toxic-rows")


def _counted(rows: DataFrame, fn, schema: str) -> DataFrame:
    """Rows (key.., n) that ``fn`` counts in each batch of (text, toxic), as one Counter per batch."""
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist()):
                fn(counts, fold(text), toxic)
            if counts:
                cols = list(zip(*counts))
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], pa.array(list(counts.values()), pa.int64())], names)

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.select("text", "toxic").mapInArrow(released(run), schema)


def _chance(k: int, n: int, share: float) -> float:
    """Probability that at least ``k`` of ``n`` documents are toxic if each is with probability ``share``."""
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log(1 - share))
    total = 0.0
    for i in range(k, n + 1):
        total += term
        if i == n or term < 1e-18:
            break
        term *= (n - i) / (i + 1) * share / (1 - share)
    return total


def learn(rows: DataFrame, support: float = 0.01, least_odds: float = 8.0, chance: float = 1e-6, extra: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon, exceptions and curve from (text, toxic) rows.

    The curve is fitted on texts that the lexicon has not seen: two lexicons, each from one half
    of the rows, score the other half.  The lexicon itself is learned from all rows.
    """
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon(curve=(40.0 if n.get(1) else -40.0, 0.0, 0.0, 0.0))
    half = F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2))
    grid: Counter = Counter()
    for k in (0, 1):
        auto = lexicon_of(rows.where(half != k), support, least_odds, chance, extra).automaton()

        def binned(counts, text, toxic):
            x, _ = features(auto, text)
            counts[(*[round(v * 8) for v in x], toxic)] += 1

        cells = _counted(rows.where(half == k), binned, "a bigint, b bigint, c bigint, toxic bigint, n bigint").groupBy("a", "b", "c", "toxic").agg(F.sum("n").alias("n"))
        for r in cells.collect():                                                  # a grid in steps of 1/8
            grid[(r["a"] / 8, r["b"] / 8, r["c"] / 8, r["toxic"])] += r["n"]
    lexicon = lexicon_of(rows, support, least_odds, chance, extra)
    lexicon.curve = _fit_curve(np.array([(*k, v) for k, v in sorted(grid.items())], dtype=float))
    return lexicon


def lexicon_of(rows: DataFrame, support: float, least_odds: float, chance: float, extra: tuple[str, ...]) -> Lexicon:
    """Weighted entries and exception phrases of (text, toxic) rows."""
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon(exceptions=tuple(extra))
    least = max(3, math.ceil(support * n_toxic))

    def of_toxic(counts, text, toxic):
        counts.update((e,) for e in entries(text))

    found = _counted(rows.where("toxic = 1"), of_toxic, "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    toxic_df = {r["entry"]: r["n"] for r in found.collect()}                       # at most entries per text / support

    def of_clean(counts, text, toxic):
        counts.update((e,) for e in entries(text) if e in toxic_df)

    clean_df = {r["entry"]: r["n"] for r in _counted(rows.where("toxic = 0"), of_clean, "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    weights = {}
    for e, a in toxic_df.items():
        b = clean_df.get(e, 0)
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if odds >= math.log(least_odds) and _chance(a, a + b, n_toxic / (n_toxic + n_clean)) <= chance:
            weights[e] = odds
    # a beginning says all that a longer entry says: keep the shortest that is as sure
    for e in sorted(weights, key=len, reverse=True):
        stem = e.rstrip("*")
        if any(weights.get(k + "*", 0) >= weights[e] for k in (stem[:m] for m in _PREFIXES if m < len(stem))):
            del weights[e]
    lexicon = Lexicon(weights, tuple(extra))
    auto = lexicon.automaton()
    if auto is None:
        return lexicon

    def contexts(counts, text, toxic):
        hits = matches(auto, text)
        seen = set()
        for at, (end, _) in hits.items():
            stop = end + 1
            while stop < len(text) and text[stop].isalnum():
                stop += 1
            before, after = _WORD.findall(text[max(0, at - 40):at]), _WORD.findall(text[stop:stop + 40])
            word = text[at:stop]
            seen.update(([f"{before[-1]} {word}"] if before else []) + ([f"{word} {after[0]}"] if after else []))
        counts.update((p, toxic) for p in seen)

    by = _counted(rows, contexts, "phrase string, toxic bigint, n bigint").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("clean"), F.sum("n").alias("n"))
    keep = by.where((F.col("clean") >= 3) & (F.col("clean") >= 0.8 * F.col("n")))
    lexicon.exceptions += tuple(sorted(r["phrase"] for r in keep.collect()))          # at most the matches in clean texts / 3
    return lexicon


def _fit_curve(cells: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Weighted logistic regression by damped Newton steps on rows (features.., label, number)."""
    x = np.column_stack([np.ones(len(cells)), cells[:, :-2]])
    y, w = cells[:, -2], cells[:, -1]
    theta = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (w * (y - p)) - penalty @ theta
        h = (x.T * (w * p * (1 - p))) @ x + penalty + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        theta = theta + step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in theta)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.7) -> DataFrame:
    """(doc_id, *keep, score, predicted, n_matches, starts, ends) of every row; places are in the folded text."""
    d = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *keep)

    def run(batches):
        auto = lexicon.automaton()
        for batch in batches:
            values, starts, ends = [], [], []
            for text in texts_of(batch.column("__text")):
                x, hits = features(auto, fold(text))
                values.append(_score(lexicon.curve, x))
                places = sorted(hits)
                starts.append(places)
                ends.append([hits[p][0] + 1 for p in places])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[batch.column(c) for c in keep], pa.array(values, pa.float64()),
                 pa.array([int(v >= threshold) for v in values], pa.int32()), pa.array([len(s) for s in starts], pa.int32()),
                 pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                ["doc_id", *keep, "score", "predicted", "n_matches", "starts", "ends"])

    types = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("doc_id", *keep))
    return d.mapInArrow(released(run), f"{schema}, score double, predicted int, n_matches int, starts array<int>, ends array<int>")
