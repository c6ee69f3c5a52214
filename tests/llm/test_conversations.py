import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from cohortflow.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACES = " \t\n\x0b\x0c\r"
FITS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, repaired rows) by trying every edit; ``rows`` are (role, text, gone, cut)."""
    @lru_cache(None)
    def go(i, last, inserts):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        nxt = AFTER[last]
        name = {"u": "user", "a": "assistant"}[nxt]
        if inserts < 3:
            found += [(c + 2, "I" + s, ((name, ""), *out)) for c, s, out in go(i, nxt, inserts + 1)]
        if i < len(rows):
            role, text, gone, cut = rows[i]
            found += [(c + 3, "D" + s, out) for c, s, out in go(i + 1, last, 0)]
            if not gone:
                found += [(c + 2 + cut, "R" + s, ((name, text), *out)) for c, s, out in go(i + 1, nxt, 0)]
                to = FITS.get((last, role[:1]))
                if to:
                    found += [(c + cut, "K" + s, ((role, text), *out)) for c, s, out in go(i + 1, to, 0)]
        return [min(found, key=lambda f: f[:2])] if found else []
    return go(0, "", 0)[0]


def expected(table, damage=True):
    by = {}
    for conv, turn, role, text in table:
        mine = by.setdefault(conv, [])
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        mine += [(turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in rows:
            bare = text.strip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, fixed = cheapest(tuple(marked))
        whole = "\n".join(f"{r}:{t}" for r, t in fixed)
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())
    return out


def got(spark, table, damage=True, parts=3):
    df = spark.createDataFrame(table, SCHEMA).repartition(parts)
    out = C.repair_with_digests(C.damaged(df) if damage else df).collect()
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r)[1:] for r in out}


def conversation(rng, conv, n):
    roles, texts = ["system", "user", "assistant", "tool", "user", "assistant"], ["Yes.", "No!", "", " \n", "and then", "Why? ", "é.", "a.b", None]
    return [(conv, rng.choice([t, t, None, t + rng.randint(0, 2)]), rng.choice(roles), rng.choice(texts)) for t in range(n)]


def test_audit_equals_all_edits():
    rng = random.Random(1)
    codes = [i | f for i in range(4) for f in (0, 4, 8, 16)]
    for _ in range(1500):
        c = bytes(rng.choice(codes) for _ in range(rng.randint(0, 9)))
        rows = tuple(("suax"[x & 3], "t", bool(x & 24), int(bool(x & 4))) for x in c)
        assert C.audit(c) == cheapest(rows)[:2]


def test_tables_of_segments_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(300):
        steps = [C.row_step(rng.choice([0, 1, 2, 3, 5, 6, 9, 18])) for _ in range(rng.randint(1, 30))]
        cuts = sorted({0, len(steps), *[rng.randint(0, len(steps)) for _ in range(3)]})
        tables = [C.table(steps[a:b]) for a, b in zip(cuts, cuts[1:])]
        end, cost = C.finish(tables)
        assert (end, cost) == C.finish(steps)
        at = C.crossings(tables, C.START, end)
        whole = C.crossings(steps, C.START, end)
        assert at == [whole[c] for c in cuts]
        inner = [x for a, b, p, q in zip(cuts, cuts[1:], at, at[1:]) for x in C.crossings(steps[a:b], p, q)[:-1]]
        assert C.letters(steps, inner + [end]) == C.letters(steps, whole)


@pytest.mark.parametrize("block", [2, 4_096])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(3)
    table = [r for conv in range(60) for r in conversation(rng, conv, rng.randint(1, 9))]
    table += conversation(rng, None, 6) + [(999, 5, "user", "Same."), (999, 5, "user", "Same.")]
    assert got(spark, table) == expected(table)


def test_one_conversation_over_many_blocks_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 7)
    rng = random.Random(4)
    table = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"No {t}.", f"open {t}"])) for t in range(150)]
    table += [(1, 40, "user", "Copy.")] * 60 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    assert got(spark, table) == expected(table)


def test_conversation_without_rows_left(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert got(spark, [(7, gone, "user", "x.")]) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_odd_roles_long_texts_and_clashing_columns(spark):
    table = [(1, 0, "", "a."), (1, 1, None, "b."), (1, None, "user", "long " * 50_000 + "."), (1, None, "USER", "x."), (1, -3, "assistant", ".")]
    assert got(spark, table, damage=False) == expected(table, damage=False)
    df = spark.createDataFrame([(1, 0, "user", "a.", 5, "x")], "conv_id bigint, turn bigint, role string, text string, n int, codes string")
    assert [r["audit"] for r in C.repair_with_digests(df).collect()] == ["KI"]


def test_repaired_rows(spark):
    table = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "user", "a.")]
    _, rows = C.repair(spark.createDataFrame(table, SCHEMA))
    assert [tuple(r)[1:] for r in rows.collect()] == [(0, "user", "a.", "K"), (1, "assistant", "b.", "R")]


def test_no_rows(spark):
    assert got(spark, []) == {}
