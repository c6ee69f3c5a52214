"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the tokens before, times that of its leaf in the
class given the same tokens, times that of the token in its leaf.  The softmax over the ``GROUPS``
classes and that over the ``LEAVES`` leaves of a class both sum hashed feature weights: the last
three tokens each, the last two together, and a skip pair.  A bucket has one row of ``GROUPS``
weights and, for each class, a row of ``LEAVES``, so a token costs ``GROUPS + LEAVES`` outputs.
Leaves are the most frequent tokens one by one and the others by their first two bytes, the
heaviest beginnings in leaves of their own.  Within a leaf of several tokens the maximum-entropy
distribution over unigram features has a closed form: counts plus one, over the leaf's total, with
one part for unknown tokens.

Training is a few rounds of distributed gradient updates over all training documents: in each
round every task runs minibatch gradient steps from the same weights over its shard and the
weights are merged in Spark, row by row, by how often each saw a feature.  There is a shard for
every ``SHARD_TOKENS`` tokens, up to ``SHARDS`` of ``LEAST_SHARD`` in smaller corpora, and weights meet in a tree of ``FAN_IN``
shards a step, so what a task reads is the same at any size.
Token counts, class totals and the vocabulary cover every training document, too.

Scoring is one pass over all whole texts in sparse numpy batches.  Counts of tokens that make up
at least ``HEAD_SHARE`` of the corpus (at most ``1 / HEAD_SHARE`` tokens) travel with the tasks;
all rarer tokens meet their counts in an equi-join, in which by that bound no token is hot.

Cases: null and empty texts are the end token alone; without training rows every token is
unknown and ``train_tokens`` is 0; repeated rows are scored each; null ids count as the empty
text in the split rule; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import Words, mix64, released, slices, staged, texts_of

GROUPS, LEAVES = 8, 16                 # classes, and leaves of each
CLASSES, OWN_CLASS = GROUPS * LEAVES, 64        # all leaves, and how many of them are single tokens (the end among them)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
FEATURES = 5
HEAD_SHARE = 1e-6
SLOT_BITS = 16                         # bits of a token that tell own tokens apart by a table, at most
SHARDS, ROUNDS, MINIBATCH, RATE = 8, 2, 4096, 0.08
SHARD_TOKENS = 16_000_000               # tokens of one shard of the fit, at most
LEAST_SHARD = 8_000_000                 # tokens below which the corpus is not split further; every shard sends its table
FAN_IN = 32                            # shards whose weights one task adds up
MERGE_TOKENS = 2_000_000                # tokens a task counts before it sends what it has
PARTS = 64                             # row blocks in which weights are merged
_U64, _I64 = np.uint64, np.int64
_SALT = mix64(np.arange(500, 510, dtype=_U64)) | _U64(1)
END, START = (int(x) for x in mix64(np.array([901, 902], dtype=_U64)))
END_PREFIX = 1 << 16


@dataclass
class Classes:
    own: np.ndarray            # sorted tokens with a class of their own
    own_class: np.ndarray
    of_prefix: np.ndarray      # class of every beginning of two bytes

    def __post_init__(self):
        """``slot``: by the last bits of a token, the place in ``own`` of the only one it can be."""
        self.bits = next(b for b in range(12, 65) if len(np.unique(self.own & _U64((1 << b) - 1))) == len(self.own))
        self.slot = np.zeros(1 << self.bits, dtype=np.int16) if self.bits <= SLOT_BITS else None
        if self.slot is not None:
            self.slot[self.own & _U64((1 << self.bits) - 1)] = np.arange(len(self.own))

    def __call__(self, token: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        out = self.of_prefix.take(np.minimum(prefix, END_PREFIX - 1))
        if len(self.own):
            if self.slot is not None:
                at = self.slot.take((token & _U64((1 << self.bits) - 1)).view(_I64))
            else:
                at = np.minimum(np.searchsorted(self.own, token), len(self.own) - 1)
            hit = np.flatnonzero(self.own.take(at) == token)
            out[hit] = self.own_class.take(at.take(hit))
        return out


class Stream:
    """Tokens of several texts, an end after each: ``token``, ``prefix`` (first two bytes) and ``doc``."""

    def __init__(self, texts: list[str]):
        w = Words(texts)
        first = w.buf[w.start].astype(_I64)
        second = np.where(w.end - w.start > 1, w.buf[np.minimum(w.start + 1, len(w.buf) - 1)], 0)
        upto = np.cumsum(w.count)
        self.token = np.insert(w.hash, upto, _U64(END))
        self.prefix = np.insert(first * 256 + second, upto, END_PREFIX)
        self.doc = np.repeat(np.arange(len(texts)), w.count + 1)

    def features(self) -> list[np.ndarray]:
        """Weight rows of the features of every place."""
        n = len(self.token)
        back = []
        for k in (1, 2, 3):
            x = np.full(n, _U64(START))
            if n > k:
                x[k:] = np.where(self.doc[k:] == self.doc[:-k], self.token[:-k], _U64(START))
            back.append(x)
        a, b, c = back
        sums = [a * _SALT[0], b * _SALT[1], c * _SALT[2], a * _SALT[3] + b * _SALT[4], a * _SALT[5] + c * _SALT[6]]
        return [(mix64(s) >> _U64(64 - BUCKET_BITS)).astype(_I64) for s in sums]


def log_softmax_at(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], label: np.ndarray, with_delta: bool = False):
    """Natural log probability of the labels, and the gradient of the logits if asked for."""
    logits = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        logits += weights.take(r, axis=0)
    logits += bias
    most = logits[:, 0].copy()                                     # column by column: rows are too short for a reduction of each
    for k in range(1, logits.shape[1]):
        np.maximum(most, logits[:, k], out=most)
    logits -= most[:, None]
    at = np.arange(len(label)) * logits.shape[1] + label
    own = logits.ravel().take(at)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], dtype=logits.dtype)
    out = own - np.log(total)
    if not with_delta:
        return out
    logits /= total[:, None]
    logits.reshape(-1)[at] -= 1
    return out, logits


def token_counts(train: DataFrame) -> DataFrame:
    """(token, prefix, c) of all training texts, ends included; merged per task before the shuffle."""
    def merged(tokens, prefixes):
        token, at, c = np.unique(np.concatenate(tokens), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(_I64)), pa.array(np.concatenate(prefixes)[at]), pa.array(c.astype(_I64))], ["token", "prefix", "c"])

    def run(batches):
        tokens, prefixes, held = [], [], 0
        for batch in batches:
            for a, b in slices(t := texts_of(batch.column("text"))):
                s = Stream(t[a:b])
                tokens.append(s.token)
                prefixes.append(s.prefix.astype(np.int32))
                held += len(s.token)
                if held >= MERGE_TOKENS:
                    yield merged(tokens, prefixes)
                    tokens, prefixes, held = [], [], 0
        if tokens:
            yield merged(tokens, prefixes)

    return train.select("text").mapInArrow(released(run), "token bigint, prefix int, c bigint").groupBy("token").agg(F.max("prefix").alias("prefix"), F.sum("c").alias("c"))


def make_classes(counts: DataFrame) -> Classes:
    top = counts.orderBy(F.col("c").desc(), "token").limit(OWN_CLASS - 1).collect()
    mass = counts.groupBy("prefix").agg(F.sum("c").alias("c")).where(F.col("prefix") < END_PREFIX).collect()      # at most 65,536 rows
    own = sorted({END, *(int(np.array([r["token"]], dtype=_I64).view(_U64)[0]) for r in top)})[:OWN_CLASS]
    if END not in own:
        own[-1] = END
    own = np.array(sorted(own), dtype=_U64)
    of_prefix = np.full(END_PREFIX, CLASSES - 1, dtype=_I64)
    heavy = sorted(mass, key=lambda r: (-r["c"], r["prefix"]))[:CLASSES - OWN_CLASS - 1]
    for k, r in enumerate(heavy):
        of_prefix[r["prefix"]] = OWN_CLASS + k
    return Classes(own, np.arange(len(own), dtype=_I64), of_prefix)


def class_totals(counts: DataFrame, classes: Classes) -> np.ndarray:
    """Sum of ``c + 1`` over each class's known tokens, plus one for unknown tokens."""
    def run(batches):
        for batch in batches:
            cls = classes(batch.column("token").to_numpy().view(_U64), batch.column("prefix").to_numpy())
            c = batch.column("c").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(np.bincount(cls, weights=c + 1.0, minlength=CLASSES))], ["cls", "total"])

    rows = counts.select("token", "prefix", "c").mapInArrow(released(run), "cls int, total double").groupBy("cls").agg(F.sum("total").alias("total")).collect()
    out = np.ones(CLASSES)
    for r in rows:
        out[r["cls"]] += r["total"]
    return out


def put_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``into[at] = rows`` with every row moved as one value."""
    whole = np.dtype((np.void, rows.shape[1] * rows.itemsize))
    into.view(whole)[:, 0][at] = rows.view(whole)[:, 0]


def row_sums(rows: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``rows``, how often each occurs, and the sums of their ``delta``, which repeats where it is shorter
    than ``rows``; most rows occur once or a few times."""
    bits = (len(delta) - 1).bit_length()
    place = np.tile(np.arange(len(delta)), len(rows) // len(delta))
    key = (rows << bits) | place                                   # (row, place) in one number: faster than an argsort
    if len(rows) and int(rows.max()) >> (31 - bits) == 0:
        key = key.astype(np.int32)
    key.sort()
    ordered, place = key >> bits, (key & ((1 << bits) - 1)).astype(np.int64)
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    many = np.diff(at, append=len(ordered))
    total = delta.take(place.take(at), axis=0)
    again = np.flatnonzero(many > 1)
    size = np.minimum(many.take(again), 17).astype(np.int16)
    again = again.take(np.argsort(-size, kind="stable"))           # most frequent first: those with a k-th place stand in front
    upto = len(again) - np.cumsum(np.bincount(size, minlength=18))  # how many occur more than k times
    first, some, hot = at.take(again), total.take(again, axis=0), int(upto[16])
    for k in range(1, 16):
        if upto[k] == hot:
            break
        some[hot:upto[k]] += delta.take(place.take(first[hot:upto[k]] + k), axis=0)
    if hot:
        size = many.take(again[:hot])
        start = np.cumsum(size) - size
        some[:hot] = np.add.reduceat(delta.take(place.take(np.repeat(first[:hot] - start, size) + np.arange(start[-1] + size[-1])), axis=0), start, axis=0)
    put_rows(total, again, some)
    return ordered.take(at).astype(np.int64), many, total


@dataclass
class Softmax:
    """Two softmax levels: ``upper`` (BUCKETS x GROUPS) over classes, ``lower`` (BUCKETS * GROUPS x LEAVES) over
    the leaves of a class, and the bias of each."""
    upper: np.ndarray
    lower: np.ndarray
    upper_bias: np.ndarray
    lower_bias: np.ndarray

    @classmethod
    def of_prior(cls, prior: np.ndarray) -> "Softmax":
        mass = prior.reshape(GROUPS, LEAVES)
        whole = mass.sum(axis=1)
        return cls(np.zeros((BUCKETS, GROUPS), dtype=np.float32), np.zeros((BUCKETS * GROUPS, LEAVES), dtype=np.float32),
                   np.log(whole / whole.sum()).astype(np.float32), np.log(mass / whole[:, None]).astype(np.float32))

    def copy(self) -> "Softmax":
        return Softmax(self.upper.copy(), self.lower.copy(), self.upper_bias, self.lower_bias)

    def levels(self, rows: list[np.ndarray], label: np.ndarray):
        """(weights, bias, weight rows, labels) of each level for tokens in the leaves ``label``."""
        group = label // LEAVES
        return ((self.upper, self.upper_bias, rows, group),
                (self.lower, self.lower_bias[group], [r * GROUPS + group for r in rows], label % LEAVES))

    def log_probability(self, rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
        return sum(log_softmax_at(*level) for level in self.levels(rows, label))


class Trainer:
    """Adaptive gradient steps on a copy of a softmax, and how often each weight row was seen."""

    def __init__(self, start: Softmax, step: float):
        self.model, self.step = start.copy(), np.float32(step)
        self.seen = np.zeros(len(start.lower), dtype=np.int32)      # by bucket and class
        self.power = [np.full(len(w), 1e-3, dtype=np.float32) for w in (start.upper, start.lower)]

    def update(self, rows: list[np.ndarray], label: np.ndarray) -> None:
        for (w, bias, at, target), power in zip(self.model.levels(rows, label), self.power):
            _, delta = log_softmax_at(w, bias, at, target, True)
            at = np.concatenate(at)
            if w is self.model.lower:
                np.add.at(self.seen, at, np.int32(1))               # a number of the same type: numpy's fast way
            row, _, g = row_sums(at, delta)
            so_far = power.take(row) + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
            power[row] = so_far
            g *= (self.step / np.sqrt(so_far))[:, None]
            put_rows(w, row, np.subtract(w.take(row, axis=0), g, out=g))

    def train(self, texts: list[str], classes: Classes) -> None:
        s = Stream(texts)
        rows, label = s.features(), classes(s.token, s.prefix)
        for i in range(0, len(label), MINIBATCH):
            self.update([r[i:i + MINIBATCH] for r in rows], label[i:i + MINIBATCH])

    def parts(self):
        """Batches (shard, part, weighted, seen): every weight row times how often it was seen, by blocks of buckets."""
        by_class = self.seen.reshape(BUCKETS, GROUPS).astype(np.float64)
        seen = np.hstack([by_class.sum(axis=1, keepdims=True), by_class])
        lower = self.model.lower * self.seen.astype(np.float32)[:, None]
        table = np.hstack([self.model.upper * seen[:, :1].astype(np.float32), lower.reshape(BUCKETS, CLASSES)])
        shard, size = TaskContext.get().partitionId(), BUCKETS // PARTS
        for p in range(PARTS):
            at = slice(p * size, (p + 1) * size)
            yield _sums(shard, p, table[at], seen[at])


def _sums(shard: int, part: int, weighted: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([weighted.astype(np.float32).tobytes()], pa.binary()),
         pa.array([seen.astype(np.float64).tobytes()], pa.binary())], ["shard", "part", "weighted", "seen"])


def merged_parts(found: DataFrame, shards: int) -> DataFrame:
    """Sums of (weighted, seen) by part, ``FAN_IN`` shards at a time, until one row a part is left."""
    size = BUCKETS // PARTS

    def merge(batches):
        key, total, seen = None, None, None
        for batch in batches:
            for shard, part, x, n in zip(*(batch.column(c) for c in ("shard", "part", "weighted", "seen"))):
                if (shard.as_py(), part.as_py()) != key:
                    if key is not None:
                        yield _sums(*key, total, seen)
                    key, total, seen = (shard.as_py(), part.as_py()), np.zeros((size, GROUPS + CLASSES)), np.zeros((size, 1 + GROUPS))
                total += np.frombuffer(x.as_buffer(), dtype=np.float32).reshape(total.shape)
                seen += np.frombuffer(n.as_buffer(), dtype=np.float64).reshape(seen.shape)
        if key is not None:
            yield _sums(*key, total, seen)

    while True:
        shards = -(-shards // FAN_IN)
        found = (found.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int")).repartition(PARTS * shards, "shard", "part")
                 .sortWithinPartitions("shard", "part").mapInArrow(released(merge), "shard int, part int, weighted binary, seen binary"))
        if shards == 1:
            return found


def shards_of(tokens: int) -> int:
    return max(1, min(SHARDS, -(-tokens // LEAST_SHARD)), -(-tokens // SHARD_TOKENS))


def fit(train: DataFrame, classes: Classes, prior: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, shards: int = SHARDS) -> Softmax:
    """The two-level softmax, by rounds of distributed gradient updates over all of ``train`` (text); ``prior``
    is the mass of every leaf."""
    model = Softmax.of_prior(prior)
    parts = train.select("text").repartition(shards)               # dealt in turn: equal rows do not meet in one shard
    size = BUCKETS // PARTS

    for turn in range(rounds):
        def run(batches, start=model, step=rate / (1 + turn)):
            trainer = Trainer(start, step)
            for batch in batches:
                texts = texts_of(batch.column("text"))
                for a, b in slices(texts):
                    trainer.train(texts[a:b], classes)
            if trainer.seen.any():
                yield from trainer.parts()

        found = parts.mapInArrow(released(run), "shard int, part int, weighted binary, seen binary")
        model = model.copy()
        for r in merged_parts(found, shards).collect():            # PARTS rows, the table once
            seen = np.maximum(np.frombuffer(r["seen"]).reshape(size, 1 + GROUPS), 1)
            table = np.frombuffer(r["weighted"], dtype=np.float32).reshape(size, GROUPS + CLASSES)
            at = r["part"] * size
            model.upper[at:at + size] = table[:, :GROUPS] / seen[:, :1]
            model.lower[at * GROUPS:(at + size) * GROUPS] = table[:, GROUPS:].reshape(-1, LEAVES) / seen[:, 1:].reshape(-1, 1)
    return model


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; ``held_out`` is a boolean column."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    train = d.where(~F.col("held_out"))
    counts = staged(token_counts(train), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    classes = make_classes(counts)
    norm = class_totals(counts, classes)
    head = counts.where(F.col("c") >= max(2, HEAD_SHARE * total)).select("token", "c").toPandas()      # at most 1 / HEAD_SHARE rows
    head_token = head["token"].to_numpy(dtype=_I64).view(_U64)
    order = np.argsort(head_token)
    head_token, head_log = head_token[order], np.log10(head["c"].to_numpy(dtype=np.float64)[order] + 1)

    model = fit(train.select(F.coalesce("text", F.lit("")).alias("text")), classes, norm, shards=shards_of(int(total)))
    log_norm = np.log10(norm)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            n = len(texts)
            known, logs, context, many, tails = np.zeros(n, dtype=_I64), np.zeros(n), np.zeros(n), np.zeros(n, dtype=_I64), []
            for a, b in slices(texts):
                s = Stream(texts[a:b])
                rows, label = s.features(), classes(s.token, s.prefix)
                value = -log_norm[label]
                for i in range(0, len(label), MINIBATCH):
                    value[i:i + MINIBATCH] += model.log_probability([r[i:i + MINIBATCH] for r in rows], label[i:i + MINIBATCH]) / np.log(10)
                if len(head_token):
                    at = np.minimum(np.searchsorted(head_token, s.token), len(head_token) - 1)
                    hit = head_token[at] == s.token
                    log = np.where(hit, head_log[at], 0.0)
                else:
                    hit, log = np.zeros(len(label), dtype=bool), np.zeros(len(label))
                size = b - a
                known[a:b] = np.bincount(s.doc[hit], minlength=size)
                logs[a:b] = np.bincount(s.doc, weights=log, minlength=size)
                context[a:b] = np.bincount(s.doc, weights=value, minlength=size)
                many[a:b] = np.bincount(s.doc, minlength=size)
                cut = np.concatenate([[0], np.cumsum(np.bincount(s.doc[~hit], minlength=size))])
                tails.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(s.token[~hit].view(_I64))))
            tail = pa.concat_arrays(tails) if tails else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(many), pa.array(known), pa.array(logs), pa.array(context), tail],
                ["doc_id", "held_out", "n_tokens", "known", "logs", "context", "tail"])

    part = d.mapInArrow(released(run), f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, context double, tail array<bigint>")
    part = staged(part.withColumn("rid", F.monotonically_increasing_id()), "lm-parts")      # the ids are written, so they stay
    rare = (part.select("rid", F.explode("tail").alias("token")).join(counts.where(F.col("c") < max(2, HEAD_SHARE * total)).select("token", "c"), "token")
            .groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("more_logs"), F.count("*").alias("more_known")))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base_norm = float(np.log10(total + distinct + 1))
    return part.drop("tail").join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * base_norm).alias("base_score"), (logs + F.col("context")).alias("score"))
