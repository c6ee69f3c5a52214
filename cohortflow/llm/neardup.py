"""Embedding near-duplicates by collision counting on one-dimensional projections.

Vectors are projected on many random lines.  A table is a set of lines: ``bits`` of them cut the
space at their medians into cells, one more sorts each cell.  Two vectors collide in a table if
they share its cell and one lies in the window of half-width ``WINDOW`` centred at the other on
the sorted line.  Collisions of a pair are counted over all tables, and pairs that reach a count are verified by their cosine in double precision.  The number of
tables follows from a calibration: sampled vectors get partners at exactly the wanted cosine,
both are projected, and the smallest number of tables is taken for which pairs reach the count
with probability ``RECALL``.  Pairs above that cosine collide more often.  The cells grow in
number with the vectors, so a vector meets a few strangers in a table at any size.

Dense groups (many near copies of a vector) are not expanded into pairs.  Cells of three further
line sets that hold at least ``DENSE`` vectors form groups; a group stands in a table once per
cell, collides as one object, and is compared block by block in tasks, which return counts per
vector and a spanning part of the links.

Cases: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing; vectors of different length never link; rows that repeat id and vector are one vector
and get equal results; the same id with another vector is a vector of its own; no rows give no
rows; a null id keeps its vector and gets a component only through others; other columns are
ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import staged
from cohortflow.llm.graph import components

WINDOW = 1.0                 # half-width, for lines of standard normal direction and unit vectors
RECALL = 0.999
COUNT = 2
STRANGERS = 6                # expected vectors of a cell
DENSE, BLOCK = 32, 512
GROUPINGS = 3
SAMPLE = 4096                # vectors from which the medians of the lines are taken
SEED = 20240


@lru_cache(maxsize=8)
def _lines(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, n))


def calibrate(sample: np.ndarray, bits: int, cosine: float, probes: int = 64) -> tuple[np.ndarray, int]:
    """(collision probability of each sampled vector with a partner at ``cosine``, tables needed).

    Every vector of the sample gets a partner at exactly ``cosine`` in a random direction, and both
    are projected on ``probes`` tables cut at the medians of the sample, as the real tables are:
    a dense region that a median cuts through counts with its own, lower probability.
    """
    n, dim = sample.shape
    rng = np.random.default_rng([SEED, 1, dim])
    lines = rng.normal(size=(dim, probes * (bits + 1)))
    turn = rng.normal(size=sample.shape)
    turn -= (turn * sample).sum(axis=1, keepdims=True) * sample
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
    va, vb = sample @ lines, (cosine * sample + math.sqrt(max(0.0, 1 - cosine * cosine)) * turn) @ lines
    cut = np.median(va, axis=0)
    same = ((va > cut) == (vb > cut))[:, :probes * bits].reshape(n, probes, bits).all(axis=2)
    p = (same & (np.abs(va - vb)[:, probes * bits:] <= WINDOW)).mean(axis=1).clip(0.5 / probes, 1.0)
    tables = COUNT
    while ((1 - p) ** tables + tables * p * (1 - p) ** (tables - 1)).mean() > 1 - RECALL:
        tables += 1
    return p, tables


def _units(vectors: DataFrame) -> DataFrame:
    """(key, vec_id, dim, unit) of valid vectors: ``unit`` holds float64 components of length 1."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for i, v in enumerate(batch.column("embedding").to_pylist()):
                if not v or any(c is None for c in v):
                    continue
                x = np.array(v, dtype=np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    top = np.abs(x).max()
                    if not np.isfinite(top) or top == 0:
                        continue
                    x = x / top
                    rows.append((i, len(x), (x / np.sqrt((x * x).sum())).tobytes()))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(at), batch.column("vec_id").take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                ["key", "vec_id", "dim", "unit"])

    return vectors.select("key", "vec_id", "embedding").mapInArrow(run, f"key bigint, vec_id {kind}, dim int, unit binary")


def _by_dim(batch):
    """(dim, places, matrix) of a batch of units, one for each dimension."""
    dims, units = batch.column("dim").to_numpy(), batch.column("unit").to_pylist()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, np.frombuffer(b"".join(units[i] for i in at), dtype=np.float64).reshape(-1, dim)


def _samples(units: DataFrame, total: int) -> dict[int, np.ndarray]:
    """About ``SAMPLE`` vectors chosen by a hash, by dimension."""
    share = min(1.0, SAMPLE / max(1, total))
    place = F.pmod(F.xxhash64(F.lit("median"), "key"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    by: dict[int, list] = {}
    for r in units.where(place < share).select("key", "dim", "unit").orderBy("key").limit(2 * SAMPLE).collect():
        by.setdefault(r["dim"], []).append(np.frombuffer(r["unit"], dtype=np.float64))
    return {d: np.stack(v) for d, v in by.items()}


def _cells(x: np.ndarray, dim: int, n_lines: int, medians: dict, tables: int, bits: int):
    """Cells (n, tables) as integers, and the values on the tables' sorted lines."""
    v = x @ _lines(dim, n_lines)
    cut = v > medians.get(dim, np.zeros(n_lines))
    weight = (1 << np.arange(bits, dtype=np.int64))
    cells = np.stack([cut[:, t * bits:(t + 1) * bits] @ weight for t in range(tables)], axis=1)
    return cells * 4096 + dim % 4096, v[:, tables * bits:tables * bits + tables]


def _groups(units: DataFrame, n_lines: int, medians: dict, first: int, bits: int) -> DataFrame:
    """(key, grp) of the vectors in dense cells of up to ``GROUPINGS`` line sets."""
    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, GROUPINGS), dtype=np.int64)
            for dim, at, x in _by_dim(batch):
                cut = x @ _lines(dim, n_lines)[:, first:] > medians.get(dim, np.zeros(n_lines))[first:]
                weight = (1 << np.arange(bits, dtype=np.int64))
                for g in range(GROUPINGS):
                    out[at, g] = (cut[:, g * bits:(g + 1) * bits] @ weight) * 4096 + dim % 4096
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(out[:, g].copy()) for g in range(GROUPINGS)]], ["key", *[f"c{g}" for g in range(GROUPINGS)]])

    rest = staged(units.mapInArrow(run, "key bigint, " + ", ".join(f"c{g} bigint" for g in range(GROUPINGS))), "neardup-cells")
    found = None
    for g in range(GROUPINGS):
        dense = rest.groupBy(f"c{g}").count().where(F.col("count") >= DENSE).select(f"c{g}")
        mine = rest.join(dense, f"c{g}").select("key", F.xxhash64(F.lit(g), f"c{g}").alias("grp"))
        found = mine if found is None else found.unionByName(mine)
        if g + 1 < GROUPINGS:
            rest = rest.join(dense, f"c{g}", "left_anti")
    return staged(found, "neardup-groups")


def _entries(units: DataFrame, n_lines: int, medians: dict, tables: int, bits: int) -> DataFrame:
    """(tab, cell, lo, hi, obj, grouped) of every vector in every table."""
    def run(batches):
        for batch in batches:
            obj, grouped = batch.column("obj").to_numpy(), batch.column("grouped").to_numpy(zero_copy_only=False)
            for dim, at, x in _by_dim(batch):
                cells, value = _cells(x, dim, n_lines, medians, tables, bits)
                value = value.ravel().astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(cells.ravel()), pa.array(value), pa.array(value),
                     pa.array(np.repeat(obj[at], tables)), pa.array(np.repeat(grouped[at], tables))], ["tab", "cell", "lo", "hi", "obj", "grouped"])

    return units.select("obj", "grouped", "dim", "unit").mapInArrow(run, "tab int, cell bigint, lo float, hi float, obj bigint, grouped boolean")


def _collisions(entries: DataFrame) -> DataFrame:
    """(a, b) for every window collision in a cell, read from cells sorted on their line."""
    def pairs(cell, tab, lo, hi, obj):
        for d in range(1, len(cell)):
            same = (cell[d:] == cell[:-d]) & (tab[d:] == tab[:-d])
            if not same.any():
                return
            near = np.flatnonzero(same & (lo[d:] - hi[:-d] <= WINDOW) & (obj[d:] != obj[:-d]))
            if len(near):
                yield np.minimum(obj[near], obj[near + d]), np.maximum(obj[near], obj[near + d])

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("cell", "tab", "lo", "hi", "obj")]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            cell, tab = cols[:2]
            last = np.flatnonzero((cell != cell[-1]) | (tab != tab[-1]))
            cut = last[-1] + 1 if len(last) else 0              # the last cell may go on in the next batch
            held = [c[cut:] for c in cols]
            for a, b in pairs(*[c[:cut] for c in cols]):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if held is not None:
            for a, b in pairs(*held):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    order = ["tab", "cell", "lo", "obj"]
    return entries.select("cell", "tab", "lo", "hi", "obj").repartition("tab", "cell").sortWithinPartitions(*order).mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, units: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) of vectors with at least ``cosine``."""
    ua = units.select(F.col("key").alias("a"), F.col("unit").alias("xa"))
    ub = units.select(F.col("key").alias("b"), F.col("unit").alias("xb"), "dim")

    def run(batches):
        for batch in batches:
            xa, xb, dims = batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), batch.column("dim").to_numpy()
            ok = np.zeros(len(xa), dtype=bool)
            for dim in np.unique(dims).tolist():
                at = [i for i in np.flatnonzero(dims == dim).tolist() if len(xa[i]) == len(xb[i])]
                p, q = (np.frombuffer(b"".join(x[i] for i in at), dtype=np.float64).reshape(-1, dim) for x in (xa, xb))
                ok[at] = (p * q).sum(axis=1) >= cosine
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.join(ua, "a").join(ub, "b").select("a", "b", "xa", "xb", "dim").mapInArrow(run, "a bigint, b bigint")


def _block_links(members: DataFrame, near: DataFrame, singles: DataFrame, cosine: float) -> DataFrame:
    """(key, n, root): links of vectors through their groups, block by block.

    ``members`` (grp, key, dim, unit), ``near`` (grp, other) pairs of colliding groups, ``singles``
    (grp, key, dim, unit) vectors that collide with a group.  ``root`` joins what a block pair links.
    """
    side0 = members.select(F.col("grp").alias("p"), "key", "dim", "unit")
    inside = members.select(F.col("grp").alias("p"), F.col("grp").alias("q"), "key", "dim", "unit")
    other = near.join(members.withColumnRenamed("grp", "other"), "other").select(F.col("grp").alias("p"), F.col("other").alias("q"), "key", "dim", "unit")
    alone = singles.select(F.col("grp").alias("p"), F.lit(0).cast("bigint").alias("q"), "key", "dim", "unit")
    side1 = inside.unionByName(other).unionByName(alone)
    n0 = side0.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).alias("n0"))
    n1 = side1.groupBy("p", "q").agg(F.ceil(F.count("*") / BLOCK).alias("n1"))
    both = n1.join(n0, "p")
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = side0.join(both, "p").select("p", "q", "key", "dim", "unit", block("n0").alias("i"), every("n1").alias("j"), F.lit(0).alias("side"))
    right = side1.join(both, ["p", "q"]).select("p", "q", "key", "dim", "unit", every("n0").alias("i"), block("n1").alias("j"), F.lit(1).alias("side"))

    def run(pdf):
        out = []
        for dim in pdf["dim"].unique().tolist():
            part = pdf[pdf["dim"] == dim]
            a, b = part[part["side"] == 0], part[part["side"] == 1]
            if not len(a) or not len(b):
                continue
            x, y = (np.frombuffer(b"".join(s["unit"]), dtype=np.float64).reshape(-1, dim) for s in (a, b))
            ka, kb = a["key"].to_numpy(), b["key"].to_numpy()
            link = (x @ y.T >= cosine) & (ka[:, None] != kb[None, :])
            root_a, root_b = ka.copy(), kb.copy()
            top = np.int64(2 ** 63 - 1)
            while True:                                   # least key reachable inside the block pair
                na = np.minimum(root_a, np.where(link, root_b[None, :], top).min(axis=1))
                nb = np.minimum(root_b, np.where(link, na[:, None], top).min(axis=0))
                if (na == root_a).all() and (nb == root_b).all():
                    break
                root_a, root_b = na, nb
            out.append(pd.DataFrame({"key": ka, "n": link.sum(axis=1), "root": root_a}))
            if part["p"].iloc[0] != part["q"].iloc[0]:    # within a group side 0 counts every ordered pair
                out.append(pd.DataFrame({"key": kb, "n": link.sum(axis=0), "root": root_b}))
        out = pd.concat(out) if out else pd.DataFrame({"key": [], "n": [], "root": []})
        return out[out["n"] > 0].astype("int64")

    return left.unionByName(right).groupBy("p", "q", "i", "j").applyInPandas(run, "key bigint, n bigint, root bigint")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("key", F.xxhash64("vec_id", "embedding"))
    units = staged(_units(rows).dropDuplicates(["key"]), "neardup-units")
    total = units.count()
    bits = min(48, max(3, round(math.log2(max(8, total / STRANGERS)))))
    sample = _samples(units, total)
    tables = max((calibrate(x, bits, cosine)[1] for x in sample.values()), default=COUNT)
    group_bits = min(48, max(3, round(math.log2(max(8, total / 4)))))
    n_lines = tables * (bits + 1) + GROUPINGS * group_bits
    medians = {d: np.median(x @ _lines(d, n_lines), axis=0) for d, x in sample.items()}

    groups = _groups(units, n_lines, medians, tables * (bits + 1), group_bits)
    objects = staged(units.join(groups, "key", "left").select("key", "dim", "unit", "grp", F.coalesce("grp", "key").alias("obj"), F.col("grp").isNotNull().alias("grouped")), "neardup-objects")
    entries = _entries(objects, n_lines, medians, tables, bits)
    once = entries.where("grouped").groupBy("tab", "cell", "obj", "grouped").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    counted = _collisions(entries.where("not grouped").unionByName(once)).groupBy("a", "b").count().where(F.col("count") >= COUNT).select("a", "b")
    kinds = objects.where("grouped").select(F.col("grp").alias("g")).distinct()
    pairs = staged(counted.join(kinds.select(F.col("g").alias("a"), F.lit(True).alias("ga")), "a", "left").join(kinds.select(F.col("g").alias("b"), F.lit(True).alias("gb")), "b", "left"), "neardup-pairs")

    single = staged(_verified(pairs.where("ga is null and gb is null").select("a", "b"), objects, cosine), "neardup-links")
    near = pairs.where("ga and gb").select(F.col("a").alias("grp"), F.col("b").alias("other"))
    lone = pairs.where("ga is null or gb is null").where("ga or gb").select(F.when(F.col("ga"), F.col("a")).otherwise(F.col("b")).alias("grp"), F.when(F.col("ga"), F.col("b")).otherwise(F.col("a")).alias("key"))
    members = objects.where("grouped").select("grp", "key", "dim", "unit")
    through = staged(_block_links(members, near, lone.join(objects.select("key", "dim", "unit"), "key"), cosine), "neardup-blocks")

    counts = (single.select(F.explode(F.array("a", "b")).alias("key"), F.lit(1).alias("n")).unionByName(through.select("key", F.col("n").cast("int").alias("n")))
              .groupBy("key").agg(F.sum("n").alias("n_links")))
    comp = components(single.unionByName(through.select(F.col("key").alias("a"), F.col("root").alias("b"))))
    named = units.select("key", "vec_id").join(comp, F.col("key") == F.col("node"))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least, "component").select("key", "component_id")
    out = rows.select("vec_id", "key").join(counts, "key", "left").join(named, "key", "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), comp_id.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))
