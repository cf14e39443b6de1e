"""Conversation repair against an exhaustive search and plain counting."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from lorewell.llm import conversation_repair as cr
from lorewell.llm.queries import QUERIES
from conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string, gone int, copy string"
TARGET = re.compile(r"(s?(ua)+)?")


def damage(rows):
    by = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in by.items()}


def cheapest(rows, faults):
    """Least (cost, audit, output), by best-first search over whole edit strings; ``allowed`` prunes outputs that cannot end well."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, initials, out = heapq.heappop(queue)
        if at == len(rows) and TARGET.fullmatch(initials):
            return cost, audit, out
        state = (at, initials[-1:])
        if state in done:
            continue
        done.add(state)
        grow = [("user", "u"), ("assistant", "a")]
        steps = [("I", 5, at, i, (f"{r}:",)) for r, i in grow]
        if at < len(rows):
            _, role, text = rows[at]
            steps.append(("D", 2, at + 1, "", ()))
            if faults[at] not in ("blank", "duplicate"):
                extra = 5 if faults[at] == "truncated" else 0
                steps.append(("K", extra, at + 1, role[:1] or "?", (f"{role}:{text}",)))
                steps += [("R", 1 + extra, at + 1, i, (f"{r}:{text}",)) for r, i in grow]
        for edit, price, goes, initial, line in steps:
            if not initial or TARGET.fullmatch(initials + initial) or TARGET.fullmatch(initials + initial + "a") or TARGET.fullmatch(initials + initial + "ua"):
                heapq.heappush(queue, (cost + price, audit + edit, goes, initials + initial, out + line))


def expected(rows):
    result = {}
    for conv, kept in damage(rows).items():
        seen, faults = set(), []
        for _, role, text in kept:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        first = [r[:1] for _, r, _ in kept]
        cost, audit, out = cheapest(kept, faults)
        result[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                        sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return result


def by_id(frame):
    rows = frame.collect()
    got = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def made_up(count, seed):
    rnd, rows = random.Random(seed), []
    for conv in range(count):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Hi.", "Yes!", "no end", "", " \n", "Why? ", "Hi.", None, "x.\x0b", "é…"])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)


def test_against_search_on_made_up_conversations(spark):
    rows = made_up(400, 1) + [(None, 1, "user", "Hello."), (None, None, "assistant", "Yes."), (900, 1, "user", "a.")] + [(901, 5, "user", "same.")] * 6
    assert by_id(cr.repair(frame(spark, rows))) == expected(rows)


def test_query_against_search_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_id(QUERIES["op12_conversation_repair"](spark, SF_SMALL)) == expected(rows)


@pytest.mark.parametrize("long", [1, 3, 50])
def test_long_conversations_are_cut(spark, long):
    """Small limits cut conversations, within turns and between repeated rows too."""
    rnd, rows = random.Random(long), made_up(40, 2)
    for conv in (None, 500, 501):
        rows += [(conv, rnd.choice([i // 3, i // 3, None]), rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(["Hi.", "no end", "", "x", "Why?", f"{i}!"])) for i in range(150)]
    rows += [(502, 5, "user", "same.")] * 120
    rows += [(i, 0, "user", "x.") for i in range(10_000, 10_100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0] * 60
    assert by_id(cr.repair(frame(spark, rows), long=long)) == expected(rows)


def test_empty_and_all_lost(spark):
    assert cr.repair(frame(spark, [(1, 1, "user", "x")]).limit(0)).count() == 0
    lost = [i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert by_id(cr.repair(frame(spark, [(i, 0, "user", "x.") for i in lost]))) == dict.fromkeys(lost, nothing)


@pytest.mark.parametrize("seed", range(30))
def test_least_labels_where_arcs_share_labels(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 14)
    arcs = sorted({(a, rnd.randint(0, 1), rnd.randint(a + 1, n - 1)) for a in range(n - 1) for _ in range(rnd.randint(0, 3))})
    least = {}
    for a in reversed(range(n)):
        least[a] = min(([lab, *least[b]] for s, lab, b in arcs if s == a), default=[])
    columns = [np.array(c, np.int64) for c in zip(*arcs)] if arcs else [np.zeros(0, np.int64)] * 3
    got = cr.least_labels(n, *columns, np.arange(n))
    assert [g.tolist() for g in got] == [least[a] for a in range(n)]
