"""Conversation repair against a plain recursion, and rows of odd kinds."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from retally.llm import repair

ROWS = "conv_id long, turn long, role string, text string"
FAULTS = [repair.GOOD, repair.COSTS, repair.MUST_GO]


def cheapest(rows):
    """(cost, audit) of the least edits by a recursion from the end, with whole audits."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def rest(i, last, inserts):
        out = []
        if i == len(rows):
            out += [(0, "")] if last in ("", "a") else []
        else:
            initial, fault = rows[i]
            ways = [("D", last, 2)]
            if fault != repair.MUST_GO:
                more = 5 if fault == repair.COSTS else 0
                ways += [("K", r, more) for r in follows[last] if r == initial] + [("R", r, 1 + more) for r in follows[last] if r != "s"]
            out += [(cost + found[0], edit + found[1]) for edit, to, cost in ways if (found := rest(i + 1, to, 0))]
        if inserts < 3:
            for role in follows[last].replace("s", ""):
                if found := rest(i, role, inserts + 1):
                    out.append((5 + found[0], "I" + found[1]))
        return min(out, default=None)

    return rest(0, "", 0)


def searched(rows):
    search = repair.Search()
    return "".join(e for r in rows for e in search.add(*r)) + "".join(search.close())


def test_search_equals_recursion():
    draw = random.Random(4)
    for trial in range(6000):
        letters = draw.choice(["suax", "ua", "u", "a", "su", "uax"])
        n = draw.randint(10, 40) if trial % 50 == 0 else draw.randint(0, 9)
        rows = tuple((draw.choice(letters), draw.choices(FAULTS, [6, 2, 1])[0]) for _ in range(n))
        assert searched(rows) == cheapest(rows)[1], rows


def test_settled_edits_leave_memory():
    draw = random.Random(5)
    search, waiting, most = repair.Search(), 0, 0
    for _ in range(50_000):
        fault = draw.choices(FAULTS, [20, 1, 1])[0]
        waiting += 1 - sum(len(e.replace("I", "")) for e in search.add(draw.choice("uuuaas"), fault))
        most = max(most, waiting)
    assert most < 500
    nodes, node = 0, search.leaves[0]
    while node is not None:
        nodes, node = nodes + 1, node.parent
    assert nodes < 500


def expected(rows):
    """The digests of the query, in plain Python."""
    out, by_id = [], {}
    for conv_id, turn, role, text in rows:
        by_id.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by_id[conv_id] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv_id, own in by_id.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen, kinds = [], set(), []
        for _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            kinds.append((role[:1], repair.COSTS if fault == "truncated" else repair.MUST_GO if fault else repair.GOOD))
        cost, audit = cheapest(tuple(kinds))
        made, at = [], iter(own)
        n = len(audit) - audit.count("D")
        roles = (["s"] if n % 2 else []) + ["u", "a"] * (n // 2)
        for edit in audit:
            row = None if edit == "I" else next(at)
            if edit == "D":
                continue
            role = roles[len(made)]
            name = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[role]
            made.append(f"{name}:{row[2] if row else ''}")
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, repair.digests(df).collect()), key=str)


def test_odd_rows(spark):
    draw = random.Random(6)
    texts = ["Hello.", "hello", "", " \t\n\x0b\x0c\r", None, "Hello!\n", "a.\xa0", "Wait", "x" * 200_000 + ".", " ", "Ja?"]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "u"]
    rows = []
    for conv_id in [None, *range(60)]:
        for turn in range(draw.randint(1, 12)):
            turn = None if draw.random() < 0.1 else turn // draw.choice([1, 1, 2]) * draw.choice([1, 1, 3])
            rows.append((conv_id, turn, draw.choice(roles), draw.choice(texts)))
    rows += rows[:40]  # repeated rows
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    assert got(df) == expected(rows)


def test_lost_and_no_rows(spark):
    lost = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*lost, "user", "Hi.")], ROWS)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(df) == [(lost[0], 0, 0, 0, 0, 0, 0, "", empty)]
    assert got(spark.createDataFrame([], ROWS)) == []


def test_long_conversation(spark):
    """One conversation of many rows whose ways stay open, of rows that settle, and one of copies."""
    rows = [(1, i, "user", f"Turn {i}.") for i in range(3001)]
    rows += [(2, i, "assistant" if i % 2 else "user", f"Turn {i}.") for i in range(5000)]
    rows += [(3, i, "user", "Same.") for i in range(2000)]
    df = spark.createDataFrame(rows, ROWS)
    found = {r["conv_id"]: r for r in repair.repair(df).groupBy("conv_id").agg({"edit": "count"}).collect()}
    assert {k: r[1] for k, r in found.items()} == {1: 3001, 2: 5000, 3: 2000}  # a lone user turn costs more than none
    edits = repair.repair(df).collect()
    assert "".join(r["edit"] for r in edits if r["conv_id"] == 1) == "D" + "KR" * 1500
    assert {r["edit"] for r in edits if r["conv_id"] == 2} == {"K"}
    assert [r["fault"] for r in edits if r["conv_id"] == 3].count("duplicate") == 1999


def test_edits_give_the_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", ""), (1, 3, "user", "So")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], ROWS + ", step int, edit string")  # names of the output
    edits = [tuple(r) for r in repair.repair(df).collect()]
    assert [e[2] for e in edits] == list(cheapest((("s", 2), ("a", 2), ("u", 0), ("u", 1)))[1])
    assert [e[1] for e in edits] == list(range(len(edits)))


@pytest.mark.parametrize("text,fault", [("a.", None), ("a. \n", None), ("a", "truncated"), (" ", "blank"), ("a.\xa0", "truncated")])
def test_faults(spark, text, fault):
    row = repair.with_faults(spark.createDataFrame([(1, 1, "user", text)], ROWS)).first()
    assert row["fault"] == fault
