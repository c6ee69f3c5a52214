"""Repair of conversation structure by the cheapest edits, in linear space.

A good conversation is empty, or an optional system row and then user and assistant rows in turn.
Reading it passes four states: nothing yet, after system, after user, after assistant.  A row is
kept (0), reroled to user or assistant (2) or deleted (3, the only choice for blank and duplicate
rows); an empty user or assistant row may be inserted anywhere (2); a truncated row that stays adds
1.  The audit is the string of these edits' initials; of equally cheap ones the least in ASCII wins.

Hirschberg's scheme finds it: forward costs of the first half and backward costs of the second meet
in the middle as two vectors over the four states, the best crossing is chosen, both halves recur.
Among optimal crossings the one of the least first half is right, because inserts count to the row
after them, so that no first half is a prefix of another; forward vectors carry the order of their
halves as ranks.  A segment's costs and ranks from every state to every state form a table of the
same shape as a row's, so long conversations use the scheme twice: over blocks of at most ``BLOCK``
rows, by their tables alone, and then inside each block, wherever it lies.

Work per row goes over compact rows (codes, no texts), range-partitioned by conversation and turn,
so a conversation with a third of all rows spreads over many tasks; equal rows are counted before
the exchange.  Texts are shuffled once, to be read in order beside the audits, row by row.  Only the
digest of a conversation, a single SHA-256 over its rows, needs one task to read them in turn.

Defined results: rows are ordered by turn (nulls first), then role, then md5 of the text; a null
role or text is one space; a role's initial is its first character, an empty role has none and fits
nowhere; rows of a null conversation id form one conversation; a conversation whose rows have no
copy left is reported empty; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import bounded, released, staged

# Fixed values of the contract.
SPACE = "\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

BLOCK = 4_096                     # rows of one block
START, SYSTEM, USER, ASSISTANT = range(4)
_TAIL = ("", "II", "I", "")       # inserts that end a conversation well, by state
_NEXT = (USER, USER, ASSISTANT, USER)      # state after one more user or assistant row
_KEPT = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})   # by state and initial (s, u, a)
_INITIAL, _CUT, _TWICE, _BLANK = 3, 4, 8, 16                             # bits of a row's code


# ------------------------------------------------------------------ one conversation

@lru_cache(maxsize=None)
def row_step(code: int) -> tuple:
    """For each state the (state after, cost, letters) a row of this code allows, inserts before it included."""
    out = []
    for q in range(4):
        best: dict[int, tuple[int, str]] = {}
        at, paid, letters = q, 0, ""
        for _ in range(3):                                  # more inserts only repeat a state
            options = [(at, DELETE, "D")]
            if not code & (_TWICE | _BLANK):
                extra = TRUNCATED if code & _CUT else 0
                if (code & _INITIAL) in _KEPT[at]:
                    options.append((_KEPT[at][code & _INITIAL], KEEP + extra, "K"))
                options.append((_NEXT[at], REROLE + extra, "R"))
            for to, cost, letter in options:
                found = (paid + cost, letters + letter)
                best[to] = min(best.get(to, found), found)
            at, paid, letters = _NEXT[at], paid + INSERT, letters + "I"
        out.append(tuple((to, *found) for to, found in sorted(best.items())))
    return tuple(out)


def forward(steps, lo: int, hi: int, start: int) -> dict[int, tuple[int, int]]:
    """{state: (cost, rank)} of the cheapest ways through ``steps[lo:hi]``; ranks order the ways to different states."""
    best = {start: (0, 0)}
    for step in steps[lo:hi]:
        new: dict[int, tuple] = {}
        for q, (paid, rank) in best.items():
            for to, cost, order in step[q]:
                way = (paid + cost, rank, order)
                if to not in new or way < new[to]:
                    new[to] = way
        ranked = sorted((way[1], way[2], to) for to, way in new.items())
        best = {to: (new[to][0], i) for i, (_, _, to) in enumerate(ranked)}
    return best


def backward(steps, lo: int, hi: int, end: int) -> dict[int, int]:
    """{state: cost} of the cheapest way from it through ``steps[lo:hi]`` to ``end``."""
    best = {end: 0}
    for step in reversed(steps[lo:hi]):
        new = {}
        for q in range(4):
            costs = [cost + best[to] for to, cost, _ in step[q] if to in best]
            if costs:
                new[q] = min(costs)
        best = new
    return best


def crossings(steps, start: int, end: int) -> list[int]:
    """States before each step and after the last, on the least cheapest way from ``start`` to ``end``."""
    states = [start] + [end] * len(steps)
    todo = [(0, len(steps))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        left, right = forward(steps, lo, mid, states[lo]), backward(steps, mid, hi, states[hi])
        states[mid] = min((paid + right[q], rank, q) for q, (paid, rank) in left.items() if q in right)[2]
        todo += [(lo, mid), (mid, hi)]
    return states


def finish(steps) -> tuple[int, int]:
    """(state after the last step, whole cost) of the least cheapest way that ends well."""
    cost, _, q = min((paid + INSERT * len(_TAIL[q]), rank, q) for q, (paid, rank) in forward(steps, 0, len(steps), START).items())
    return q, cost


def table(steps) -> tuple:
    """The step of a whole segment: for each state its (state after, cost, rank)."""
    return tuple(tuple((to, cost, rank) for to, (cost, rank) in sorted(forward(steps, 0, len(steps), q).items())) for q in range(4))


def letters(steps, states: list[int]) -> str:
    """The audit of row steps between known states."""
    return "".join(next(o for to, _, o in step[a] if to == b) for step, a, b in zip(steps, states, states[1:]))


def audit(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of one conversation's row codes."""
    steps = [row_step(c) for c in codes]
    end, cost = finish(steps)
    return cost, letters(steps, crossings(steps, START, end)) + _TAIL[end]


# ------------------------------------------------------------------ rows

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): by crc32 of ``conv_id:turn`` modulo 20 a row is dropped (no copy), emptied, loses its
    sentence ends, stands twice, or becomes the user's."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    case = F.pmod(F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")), F.lit(20))
    return conversations.select(
        "conv_id", "turn", F.when(case == 4, F.lit("user")).otherwise(text["role"]).alias("role"),
        F.when(case == 1, F.lit("")).when(case == 2, F.translate(text["text"], ".!?", "")).otherwise(text["text"]).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"))


def _named(rows: DataFrame) -> DataFrame:
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("bigint").alias("copies"),
                       F.unhex(F.md5(text.cast("binary"))).alias("digest"))


def coded(named: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, code): distinct rows with their number of copies and the code of the first one."""
    blank, cut = ~F.col("text").rlike(f"[^{SPACE}]"), ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    place = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1)
    rows = named.select("conv_id", "turn", "role", "digest", "copies", (initial + F.when(blank, _BLANK).when(cut, _CUT).otherwise(0)).cast("int").alias("code"))
    rows = staged(rows.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.max("code").alias("code")), "conversation-rows")
    seen = rows.where(F.col("n") > 0).groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unset"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = F.when(F.col("unset"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    twice = F.coalesce(again, F.lit(False)) & (F.col("code").bitwiseAND(_BLANK) == 0)
    code = F.when(twice, F.col("code").bitwiseAND(_INITIAL) + _TWICE).otherwise(F.col("code"))
    return rows.join(seen, same, "left").select("conv_id", "turn", "role", "digest", "n", code.alias("code"))


_LEGAL = {(0, 1), (1, 2), (2, 1)}                           # initials su, ua, au
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_BLOCK_KEYS = ("part", "chunk")


def _tally(codes: bytes) -> tuple[int, int, int, int]:
    illegal = sum((a & _INITIAL, b & _INITIAL) not in _LEGAL for a, b in zip(codes, codes[1:]))
    return (sum(bool(c & _BLANK) for c in codes), sum(bool(c & _TWICE) for c in codes), sum(bool(c & _CUT) for c in codes), illegal)


def blocks(rows: DataFrame) -> DataFrame:
    """One row per block of a conversation's rows in order: codes, the first row's place, counts and the block's table."""
    order = ("conv_id", "turn", "role", "digest")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *_BLOCK_KEYS, "turn", "role", "digest", "codes", "table", *_COUNTS, "least", "most", "first_turn", "last_turn"]

    def run(batches):
        from pyspark import TaskContext

        part, chunk, out = TaskContext.get().partitionId(), 0, []
        held: dict = {}                                      # the open block

        def opened(conv, turn, role, digest):
            held.update(conv=conv, key=(turn, role, digest), codes=bytearray(), turns=[], first=turn)

        def closed():
            nonlocal chunk
            codes, turns = bytes(held["codes"]), held["turns"]
            steps = [row_step(c) for c in codes]
            flat = [x for row in table(steps) for to, cost, rank in row for x in (len(row), to, cost, rank)]
            out.append((held["conv"], part, chunk, *held["key"], codes, flat, *_tally(codes), len(turns),
                        turns[0] if turns else None, turns[-1] if turns else None, held["first"], held["last"]))
            chunk += 1

        def sent():
            cols = list(zip(*out))
            out.clear()
            types = [id_type, pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 9]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, turn, role, digest, n, code in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held["conv"] != conv:
                    closed()
                    held.clear()
                if not held:
                    opened(conv, turn, role, digest)
                    held["last"] = turn
                now = code
                while n:
                    if len(held["codes"]) == BLOCK:
                        closed()
                        opened(conv, turn, role, digest)
                    if not held["codes"]:                   # rows without a copy before it do not count
                        held["key"], held["first"] = (turn, role, digest), turn
                    take = 1 if now == code else min(n, BLOCK - len(held["codes"]))
                    if turn is not None and (not held["turns"] or held["turns"][-1] != turn):
                        held["turns"].append(turn)
                    held["codes"] += bytes([now]) * take
                    held["last"] = turn
                    n -= take
                    now = code if code & (_BLANK | _TWICE) else code & _INITIAL | _TWICE      # a copy repeats the row before it
            if out:
                yield sent()
        if held:
            closed()
        if out:
            yield sent()

    dealt = bounded(rows).select(*order, "n", "code").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(released(run), f"conv_id {kind}, part int, chunk int, turn bigint, role string, digest binary, codes binary, table array<bigint>, "
                            + "".join(f"{c} bigint, " for c in _COUNTS) + "least bigint, most bigint, first_turn bigint, last_turn bigint")


def _step_of(flat: list[int]) -> tuple:
    """The block table that ``blocks`` wrote as one list."""
    rows, at = [], 0
    for _ in range(4):
        size = flat[at]
        rows.append(tuple(tuple(flat[at + 4 * i + 1:at + 4 * i + 4]) for i in range(size)))
        at += 4 * size
    return tuple(rows)


def _between(blocks_of: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, start, end, tail, cost, extra_illegal, shared_turns): how the blocks of a conversation meet."""
    kind = blocks_of.schema["conv_id"].dataType.simpleString()
    rows = blocks_of.select("conv_id", "part", "chunk", "table", F.ascii(F.substring("codes", 1, 1)).alias("head"), F.ascii(F.substring("codes", -1, 1)).alias("foot"),
                            F.length("codes").alias("size"), "first_turn", "last_turn")

    def solved(conv, held):
        steps = [_step_of(h[2]) for h in held]
        end, cost = finish(steps)
        states = crossings(steps, START, end)
        before = None
        for i, (part, chunk, _, head, foot, size, first, last) in enumerate(held):
            meets = before is not None and size
            yield (conv, part, chunk, states[i], states[i + 1], _TAIL[end] if i == len(held) - 1 else "", cost if i == 0 else 0,
                   int(meets and (before[0] & _INITIAL, head & _INITIAL) not in _LEGAL), int(meets and first is not None and before[1] == first))
            if size:
                before = (foot, last)

    def run(batches):
        names = ["conv_id", "part", "chunk", "start", "end", "tail", "cost", "extra_illegal", "shared_turns"]
        conv, held, id_type = None, [], None

        def sent(rows):
            types = [id_type, *[pa.int32()] * 4, pa.string(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            id_type, out = batch.schema.field("conv_id").type, []
            for c, *rest in zip(*(x.to_pylist() for x in batch.columns)):
                if held and c != conv:
                    out += solved(conv, held)
                    held = []
                conv = c
                held.append(rest)
            if out:
                yield sent(out)
        if held:
            yield sent(list(solved(conv, held)))

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(
        released(run), f"conv_id {kind}, part int, chunk int, start int, end int, tail string, cost bigint, extra_illegal bigint, shared_turns bigint")


def audited(rows: DataFrame) -> DataFrame:
    """The blocks of ``coded`` rows with ``edits``, their part of the audit."""
    every = staged(blocks(rows), "conversation-blocks")
    ends = _between(every).withColumnRenamed("conv_id", "c")
    both = every.drop("table").join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (every["part"] == ends["part"]) & (every["chunk"] == ends["chunk"]))
    keep = ("conv_id", *_BLOCK_KEYS, "turn", "role", "digest", *_COUNTS, "least", "most", "cost", "extra_illegal", "shared_turns")
    both = both.select(*[every[c] if c in every.columns else F.col(c) for c in keep], "codes", "start", "end", "tail")

    def run(batches):
        for batch in batches:
            edits = []
            for codes, start, end, tail in zip(*(batch.column(c).to_pylist() for c in ("codes", "start", "end", "tail"))):
                steps = [row_step(c) for c in codes]
                edits.append(letters(steps, crossings(steps, start, end)) + tail)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(edits, pa.string())], [*keep, "edits"])

    types = {f.name: f.dataType.simpleString() for f in both.schema}
    return staged(both.mapInArrow(released(run), ", ".join(f"{c} {types[c]}" for c in keep) + ", edits string"), "conversation-audits")


def report(audits: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation."""
    pieces = F.array_sort(F.collect_list(F.struct(*_BLOCK_KEYS, "edits")))            # the audit is a result, as long as its rows
    turns = F.sum("turns") - F.sum("shared_turns")
    return audits.groupBy("conv_id").agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - turns, F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.sum("extra_illegal")).alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(pieces, lambda p: p["edits"]), "").alias("audit"))


def repaired(named: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the rows of the repaired conversations, each conversation in order within one partition."""
    kind = named.schema["conv_id"].dataType.simpleString()
    key = ("conv_id", "turn", "role", "digest")
    none = F.lit(None).cast("string")
    texts = named.where(F.col("copies") > 0).select(*key, F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("chunk"), "copies", "text", none.alias("edits"))
    pieces = audits.where(F.col("edits") != "").select(*key, F.lit(0).alias("kind"), *_BLOCK_KEYS, F.lit(0).cast("bigint").alias("copies"), none.alias("text"), "edits")
    dealt = pieces.unionByName(texts).repartition("conv_id").sortWithinPartitions(*key, "kind", *_BLOCK_KEYS)

    def run(batches):
        none_yet = object()
        conv, queue, at, state, place = none_yet, "", 0, START, 0
        id_type, out, size = None, [], 0

        def row(edit, role, text):
            nonlocal state, place, size
            if edit != "K":
                role, text = "assistant" if state == USER else "user", "" if edit == "I" else text
                state = _NEXT[state]
            else:
                state = _KEPT[state]["sua".index(role[0])]
            out.append((conv, place, role, text, edit))
            place += 1
            size += len(text)

        def sent():
            nonlocal size
            cols, size = list(zip(*out)), 0
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (id_type, pa.int64(), pa.string(), pa.string(), pa.string()))],
                                              ["conv_id", "place", "role", "text", "edit"])

        for batch in bounded_batches(batches):
            id_type = batch.schema.field("conv_id").type
            for c, role, copies, text, edits in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "copies", "text", "edits"))):
                if conv is none_yet or c != conv:
                    for edit in queue[at:]:                  # inserts after the last row
                        row(edit, None, "")
                    conv, queue, at, state, place = c, "", 0, START, 0
                if edits is not None:
                    queue, at = queue[at:] + edits, 0
                    continue
                for _ in range(copies):
                    while queue[at] == "I":
                        row("I", None, "")
                        at += 1
                    if queue[at] != "D":
                        row(queue[at], role, text)
                    at += 1
                if size > 1 << 20:
                    yield sent()
            if out:
                yield sent()
        for edit in queue[at:]:
            row(edit, None, "")
        if out:
            yield sent()

    return bounded(dealt).select("conv_id", "role", "copies", "text", "edits").mapInArrow(
        released(run), f"conv_id {kind}, place bigint, role string, text string, edit string")


def bounded_batches(batches, rows: int = 4_096):
    """Arrow batches of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``repaired`` rows: of ``role:text``, joined by newlines.  Reads them where they are, in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, sha, id_type = None, None, None

        def sent(done):
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], id_type), pa.array([d for _, d in done], pa.string())], ["conv_id", "sha256"])

        for batch in batches:
            id_type, done = batch.schema.field("conv_id").type, []
            for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield sent(done)
        if sha is not None:
            yield sent([(conv, sha.hexdigest())])

    return rows.mapInArrow(released(run), f"conv_id {kind}, sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of ``rows`` (conv_id, turn, role, text and, where wanted, copies)."""
    named = _named(rows)
    audits = audited(coded(named))
    return report(audits), repaired(named, audits)


def repair_with_digests(rows: DataFrame) -> DataFrame:
    """``report`` with ``repaired_sha256``; an empty conversation has the digest of the empty text."""
    found, texts = repair(rows)
    by_conv = digests(texts).withColumnRenamed("conv_id", "c")
    return found.join(by_conv, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        *found.columns, F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
