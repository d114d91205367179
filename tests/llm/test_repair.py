"""Conversation repair against a plain search over all edits, forwards."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from trencher.llm import repair

TURNS = "conv_id long, turn long, role string, text string, row int, block string"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines) by uniform-cost search; ties come out by audit."""
    seen, heap = set(), [(0, "", 0, 0, ())]
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, lines
        if (i, q) in seen:
            continue
        seen.add((i, q))
        own, to = ("assistant", 3) if q == 2 else ("user", 2)
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*lines, own + ":")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, lines))
        if fault in ("blank", "duplicate"):
            continue
        cut = fault == "truncated"
        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, to, (*lines, f"{own}:{text}")))
        if role[:1] == own[0] or role[:1] == "s" and q == 0:
            heapq.heappush(heap, (cost + cut, audit + "K", i + 1, to if role[0] == own[0] else 1, (*lines, f"{role}:{text}")))


def plain(turns):
    by = {}
    for conv, turn, role, text in turns:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        rows, seen = [], set()
        for _, role, text in own:
            bare = text.strip(BLANK)
            rows.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
            seen.add((role, text))
        turns_ = {t for t, _, _ in own if t is not None}
        faults = Counter(f for _, _, f in rows)
        cost, audit, lines = cheapest(rows)
        yield (conv, max(turns_) - min(turns_) + 1 - len(turns_) if turns_ else 0, faults["blank"], faults["duplicate"], faults["truncated"],
               sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def safe(rows):
    return [(c, t, r, x, 1, "b") for c, t, r, x in rows]


@pytest.mark.parametrize("block", [4096, 2])
def test_repair(spark, block):
    rng = random.Random(4)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "union"])
            text = rng.choice(["Yes.", "No!\n ", "half a", "", " \t", None, "é?", "\U0001f600", "a.b", f"t{rng.random()}.", f"u{rng.random()}?", f"v{rng.random()}"])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randrange(2), role, text))
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t}.") for t in range(700)] + [(501, 3, "user", "x" * 100_000)] * 3
    given = spark.createDataFrame(safe(rows), TURNS)
    assert Counter(map(tuple, repair.repaired_after_damage(given, block=block).collect())) == Counter(plain(rows))


def test_empty_table(spark):
    assert repair.repaired_after_damage(spark.createDataFrame([], TURNS)).collect() == []
    dropped = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    found = repair.repaired_after_damage(spark.createDataFrame(safe([(*dropped, "user", "a")]), TURNS)).collect()
    assert [tuple(r) for r in found] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
