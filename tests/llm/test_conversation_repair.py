"""Conversation repair against a search over all edits that keeps the edits themselves."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from docketspark.llm import conversation_repair as cr

WHITE = re.compile(r"[^\x20\x09-\x0D]")


def model(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)} of (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        by[conv] += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return {conv: repaired(x) for conv, x in by.items()}


def repaired(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))  # tests give rows of one turn one role and text only
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not WHITE.search(text) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    best = {"": (0, "", ())}  # by initials' state: cost, audit, turns

    def step(state, initial):
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
        return initial if initial and initial in nexts[state] else None

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserts(table):
        work = dict(table)
        for _ in range(4):
            for state, (cost, audit, out) in list(work.items()):
                for name in ("user", "assistant"):
                    if (after := step(state, name[0])) is not None:
                        better(work, after, (cost + 3, audit + "I", (*out, (name, ""))))
        return work

    for (_, role, text), fault in zip(rows, faults, strict=True):
        layer = {}
        for state, (cost, audit, out) in inserts(best).items():
            better(layer, state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if (after := step(state, role[:1])) is not None:
                better(layer, after, (cost + extra, audit + "K", (*out, (role, text))))
            for name in ("user", "assistant"):
                if (after := step(state, name[0])) is not None:
                    better(layer, after, (cost + extra + 3, audit + "R", (*out, (name, text))))
        best = layer
    cost, audit, out = min(v for s, v in inserts(best).items() if s in ("", "a"))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def talk(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "it is so?", "", " \n", "Yes.", "see\t", "stop. ", "é…", None, "long " * 400 + "."]
    rows = []
    for conv in [*range(n), None]:
        at = rng.randrange(-3, 4)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((conv, at if rng.random() < 0.95 else None, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "User", "", None]), rng.choice(texts)))
            at += rng.choice([1, 1, 1, 2, 5])
    once = {}
    for r in rows:  # one row a turn, and some of these repeated
        once.setdefault(r[:2], r)
    rows = list(once.values())
    return rows + rng.sample(rows, len(rows) // 10)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, kind string, part string").repartition(3)
    turns, summary = cr.repair(cr.damaged(frame), **options)
    got = [tuple(r) for r in cr.digest(frame, turns, summary).collect()]
    return {r[0]: r[1:] for r in got}, len(got)


@pytest.mark.parametrize("chunk", [256, 3])
def test_repair_as_by_all_edits(spark, chunk):
    rows = talk(5, 400)
    got, n = found(spark, rows, chunk=chunk)
    want = model(rows)
    assert n == len(want) and got == want


def test_long_and_hot_conversations_in_chunks(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Word.", "word", f"{t}."])) for t in range(3000)]
    rows += [(2, 1, "user", "Hello.")] * 2500 + [(3, None, "user", "Hi.")] * 3 + [(4, t, "user", "Hi.") for t in range(5)]
    got, _ = found(spark, rows)
    assert got == model(rows)


def test_macros_are_prefix_free_and_in_order():
    assert cr.MACROS == sorted(cr.MACROS)
    assert not any(a != b and b.startswith(a) for a in cr.MACROS for b in cr.MACROS)


def test_rows_of_one_turn_have_one_order(spark):
    rows = [(1, 0, r, t) for r in ("user", "assistant") for t in ("A.", "B.", "c")] * 2
    assert len({str(found(spark, random.Random(s).sample(rows, len(rows)))[0]) for s in range(3)}) == 1


def test_no_rows(spark):
    assert found(spark, [])[1] == 0
