import hashlib
import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from nearloom.llm import conversations
from nearloom.llm.conversations import AFTER, solve

SCHEMA = "conv_id bigint, turn bigint, role string, text string, at int, symbols string, cost string, place string"


def plain(symbols):
    """Least (cost, audit) over all edits, by exhaustive recursion."""

    def moves(symbol, q):
        yield "D", 2, q
        if symbol != "d":
            extra = 5 if symbol.isupper() else 0
            for role, r in AFTER[q].items():
                if role == symbol.lower():
                    yield "K", extra, r
                if role in "ua":
                    yield "R", 1 + extra, r

    @lru_cache(None)
    def best(i, q, free):
        found = [(0, "")] if i == len(symbols) and q in (0, 3) else []
        if free:
            rest = best(i, AFTER[q].get("u") or AFTER[q]["a"], free - 1)
            found += [(rest[0] + 5, "I" + rest[1])] if rest else []
        if i < len(symbols):
            for letter, cost, r in moves(symbols[i], q):
                rest = best(i + 1, r, 2)
                found.append((rest[0] + cost, letter + rest[1]))
        return min(found) if found else None

    return best(0, 0, 2)[::-1]


@pytest.mark.parametrize("layers", [2, 32])
def test_auction_equals_exhaustive_search(monkeypatch, layers):
    monkeypatch.setattr(conversations, "LAYERS", layers)
    solve.cache_clear()
    draw = random.Random(layers)
    for t in range(1500):
        symbols = "".join(draw.choice(("suaoSUAOd", "uuauaaUAds")[t % 2]) for _ in range(draw.randrange(12)))
        assert solve(symbols) == plain(symbols), symbols
    solve.cache_clear()


def test_known_repairs():
    assert solve("") == ("", 0) and solve("ua") == ("KK", 0) and solve("sua") == ("KKK", 0)
    assert solve("u") == ("D", 2)  # cheaper than an answer made up
    assert solve("uu") == ("KR", 1) and solve("aa") == ("RK", 1)
    assert solve("uaUA") == ("KKDD", 4)


def rows_of(seed, convs=40):
    draw = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(draw.randrange(1, 12)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = draw.choice(["", " \n", "yes.", "no!", "so", None, f"t{draw.randrange(5)}.", "end?  \n"])
            out.append((None if c == 7 else c, draw.choice([t, t, t, None, t - 1]), role, text))
    return out


def expected(rows):
    """A plain version of ``repair`` over (conv, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in groups.items():
        seen, symbols, faults, initials = set(), "", [], []
        turns.sort()
        for _, _, role, text in turns:
            kind = ("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen
                    else "truncated" if text.rstrip(" \t\n\v\f\r")[-1] not in ".!?" else None)
            seen.add((role, text))
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            initials.append(first)
            faults.append(kind)
            symbols += "d" if kind in ("blank", "duplicate") else first.upper() if kind else first
        numbers = [t for has, t, _, _ in turns if has]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        audit, cost = plain(symbols)
        made, at, led = [], 0, 0
        for letter in audit:
            if letter == "K":
                made.append(f"{turns[at][2]}:{turns[at][3]}")
                led += len(made) == 1 and initials[at] == "s"
            elif letter != "D":
                made.append(f"{('user', 'assistant')[(len(made) - led) % 2]}:{turns[at][3] if letter == 'R' else ''}")
            at += letter != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(made).encode()).hexdigest(), made)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("bound", [2048, 3, 0])
def test_repair_equals_plain_version(spark, monkeypatch, bound):
    monkeypatch.setattr(conversations, "GATHER_TURNS", bound)
    monkeypatch.setattr(conversations, "SEGMENT", 4)
    rows = rows_of(1) + rows_of(1)[:30]
    rows += [(99, i, "user" if i % 2 == 0 else "assistant", f"long {i}.") for i in range(150)]
    want = expected(rows)
    found = conversations.repair(frame(spark, rows))
    got = {r.conv: tuple(r[1:]) for r in found.summary.collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    turns = {}
    for r in sorted(found.turns.collect(), key=lambda r: (r.conv is None, r.conv or 0, r.place)):
        turns.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    assert turns == {k: v[-1] for k, v in want.items() if v[-1]}


def test_odd_tables(spark):
    assert conversations.repair(frame(spark, [])).summary.count() == 0
    rows = [(1, None, None, None), (2, -(2**63), "user", "a."), (2, 2**63 - 1, "assistant", "x" * 300_000 + "."), (None, 1, "user", "hi.")]
    got = {r.conv: r for r in conversations.repair(frame(spark, rows)).summary.collect()}
    assert got[1].audit == "D" and got[1].blank == 1 and got[1].gaps == 0
    assert got[2].audit == "KK" and got[2].gaps is None
    assert got[None].audit == "D"


def test_damage_by_hash(spark):
    import zlib

    rows = [(c, t, "assistant", "Yes. No!") for c in range(30) for t in range(4)] + [(None, None, "assistant", None)]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        text = {1: "", 2: text.replace(".", "").replace("!", "")}.get(kind, text)
        want += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = [tuple(r) for r in conversations.damaged(frame(spark, rows)).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or 0)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_conversations_without_rows_are_returned(spark):
    import __spark_entry__ as entry

    got = entry.queries()["op12_conversation_repair"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()
    assert got.filter(F.col("audit").isNull() | F.col("repaired_sha256").isNull()).count() == 0
