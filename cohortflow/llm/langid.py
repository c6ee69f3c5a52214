"""Language identification by a bidirectional gated recurrent network over bytes.

A text is its UTF-8 bytes in windows of ``WINDOW`` bytes; every byte of the whole text is in one
window.  Two gated recurrent layers, one from either side, read a window; a softmax over both
states labels every position, and the probabilities of all positions of a document are averaged.

Training is numpy backpropagation through time on a bounded sample: at most ``docs_per_lang``
labelled documents of each language (chosen by a hash of the id) with ``WINDOWS_PER_DOC``
windows each.  The sample bound is a parameter; prediction reads every byte of every row.

Scale: one narrow count of labels, one pass for the sample, one pass to predict; no shuffle of
texts.  The model (a few kilobytes) travels with the task.

Cases: null texts and texts without a letter are ``und`` with score 0; without any labelled
row every text is ``und``; null ids count as the empty text in the split rule; repeated rows are
judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import bounded, released, slices, texts_of

WINDOW, WINDOWS_PER_DOC = 64, 4
BLOCK = 1024                       # windows in one pass of the recurrent layers
UNDETERMINED = "und"
MIN_SCORE = 0.3                    # least mean probability of a text whose language counts as known


@dataclass
class Model:
    langs: list[str]
    hidden: int
    p: dict[str, np.ndarray]       # xf, xb (3H, 256), uf, ub (3H, H), w (L, 2H), b (L, 1)


def _layer(x: np.ndarray, u: np.ndarray, byte: np.ndarray, mask: np.ndarray, order, keep: list | None = None) -> np.ndarray:
    """States (T, H, B) of one direction; ``keep`` gets what the way back needs."""
    h_size = u.shape[1]
    steps, width = byte.shape
    out = np.empty((steps, h_size, width), dtype=np.float32)
    h = np.zeros((h_size, width), dtype=np.float32)
    for t in order:
        a = np.take(x, byte[t], axis=1)
        s = u @ h
        gate = np.tanh(a[:2 * h_size] + s[:2 * h_size])
        gate *= 0.5
        gate += 0.5
        z, r = gate[:h_size], gate[h_size:]
        n = np.tanh(a[2 * h_size:] + r * s[2 * h_size:])
        before = h
        h = (n + z * (h - n)) * mask[t]
        out[t] = h
        if keep is not None:
            keep.append((t, before, z, r, n, s[2 * h_size:]))
    return out


def _layer_back(u: np.ndarray, byte: np.ndarray, mask: np.ndarray, keep: list, grad: np.ndarray):
    """Gradients of the input table and the recurrent weights, from the gradients of the states."""
    h_size = u.shape[1]
    du = np.zeros_like(u)
    da_all = np.empty((3 * h_size, *byte.shape), dtype=np.float32)
    carry = 0.0
    for t, before, z, r, n, s_n in reversed(keep):
        dh = (grad[t] + carry) * mask[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * 2 * z * (1 - z)
        dr = dn * s_n * 2 * r * (1 - r)
        ds = np.concatenate([dz, dr, dn * r])
        du += ds @ before.T
        carry = dh * z + u.T @ ds
        da_all[:, t] = np.concatenate([dz, dr, dn])
    flat = byte.ravel()
    dx = np.stack([np.bincount(flat, weights=row.ravel(), minlength=256) for row in da_all]).astype(np.float32)
    return dx, du


def _logits(p, byte, mask, keep_f=None, keep_b=None):
    steps = len(byte)
    f = _layer(p["xf"], p["uf"], byte, mask, range(steps), keep_f)
    b = _layer(p["xb"], p["ub"], byte, mask, range(steps - 1, -1, -1), keep_b)
    state = np.concatenate([f, b], axis=1)                       # (T, 2H, B)
    return state, np.matmul(p["w"], state) + p["b"]              # (T, L, B)


def _softmax(logits):
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: list[tuple[bytes, str]], hidden: int = 8, steps: int = 300, batch: int = 256, rate: float = 0.015, seed: int = 7) -> Model:
    """Adam on the cross-entropy of every position's label."""
    langs = sorted({lang for _, lang in windows})
    rng = np.random.default_rng(seed)
    p = {"xf": rng.normal(0, 0.3, (3 * hidden, 256)), "xb": rng.normal(0, 0.3, (3 * hidden, 256)),
         "uf": rng.normal(0, hidden ** -0.5, (3 * hidden, hidden)), "ub": rng.normal(0, hidden ** -0.5, (3 * hidden, hidden)),
         "w": rng.normal(0, 0.3, (len(langs), 2 * hidden)), "b": np.zeros((len(langs), 1))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if len(langs) < 2:
        return Model(langs, hidden, p)
    data = np.zeros((len(windows), WINDOW), dtype=np.uint8)
    mask = np.zeros((len(windows), WINDOW), dtype=np.float32)
    for i, (w, _) in enumerate(windows):
        data[i, :len(w)] = np.frombuffer(w, dtype=np.uint8)
        mask[i, :len(w)] = 1
    label = np.array([langs.index(lang) for _, lang in windows])
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        byte, on = data[pick].T.copy(), mask[pick].T.copy()
        keep_f, keep_b = [], []
        state, logits = _logits(p, byte, on, keep_f, keep_b)
        d = _softmax(logits)
        d[:, label[pick], np.arange(batch)] -= 1
        d *= (on / on.sum())[:, None, :]
        g = {"w": np.einsum("tlb,thb->lh", d, state), "b": d.sum(axis=(0, 2))[:, None]}
        back = np.matmul(p["w"].T, d)
        g["xf"], g["uf"] = _layer_back(p["uf"], byte, on, keep_f, back[:, :hidden])
        g["xb"], g["ub"] = _layer_back(p["ub"], byte, on, keep_b, back[:, hidden:])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            p[k] = (p[k] - lr * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return Model(langs, hidden, p)


def probabilities(model: Model, texts: list[str]) -> np.ndarray:
    """Mean over all positions of the label probabilities, one row per text (zeros for empty texts)."""
    out = np.zeros((len(texts), len(model.langs)))
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for a, b in slices(raw):
        count = np.array([-(-len(r) // WINDOW) for r in raw[a:b]])
        if not count.sum():
            continue
        buf = b"".join(r + bytes(-len(r) % WINDOW) for r in raw[a:b])
        byte = np.frombuffer(buf, dtype=np.uint8).reshape(-1, WINDOW)
        doc = np.repeat(np.arange(a, b), count)
        used = np.full(len(doc), WINDOW)
        last = np.cumsum(count)[count > 0] - 1
        used[last] = [(len(r) - 1) % WINDOW + 1 for r in raw[a:b] if r]
        for i in range(0, len(doc), BLOCK):
            on = (np.arange(WINDOW)[:, None] < used[None, i:i + BLOCK]).astype(np.float32)
            _, logits = _logits(model.p, np.ascontiguousarray(byte[i:i + BLOCK].T), on)
            sums = (_softmax(logits) * on[:, None, :]).sum(axis=0)               # (L, B)
            for k in range(len(model.langs)):
                out[:, k] += np.bincount(doc[i:i + BLOCK], weights=sums[k], minlength=len(texts))
    size = np.array([len(r) for r in raw])
    return out / np.maximum(size, 1)[:, None]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 600,
          hidden: int = 8, steps: int = 300) -> Model:
    """Fit on at most about ``docs_per_lang`` rows of each non-null language of ``docs``."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Model([], hidden, {})
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, docs_per_lang / n))]), F.col("lang"))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    at = [(F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))) + 1).cast("int") for k in range(WINDOWS_PER_DOC)]
    rows = (labelled.where(F.col("text").rlike("\\p{L}")).where(place < share)
            .select("lang", "doc_id", F.array(*[F.col("text").substr(x, F.lit(WINDOW)) for x in at]).alias("parts")).collect())
    windows = sorted({(w.encode("utf-8", "surrogatepass")[:WINDOW], r["lang"]) for r in rows for w in r["parts"] if has_letter(w)})
    return fit(windows, hidden, steps)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score, letters) of every row; ``letters`` tells whether the text has a letter."""
    name_of_text = text_col if text_col in keep else "__text"
    d = bounded(docs).select(F.col(id_col).alias("doc_id"), *keep, *[F.col(text_col).alias("__text")] * (text_col not in keep))

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(name_of_text))
            letters = [has_letter(t) for t in texts]
            if model.langs:
                prob = probabilities(model, [t if ok else "" for t, ok in zip(texts, letters)])
                best = prob.argmax(axis=1)
                name = [model.langs[k] if ok else UNDETERMINED for k, ok in zip(best, letters)]
                score = np.where(letters, np.clip(prob.max(axis=1), 0, 1), 0.0)
            else:
                name, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[batch.column(c) for c in keep], pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.bool_())],
                ["doc_id", *keep, "lang_pred", "score", "letters"])

    types = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("doc_id", *keep))
    return d.mapInArrow(released(run), f"{schema}, lang_pred string, score double, letters boolean")
