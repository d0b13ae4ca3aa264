import hashlib
import heapq
import random
import zlib

import pytest

from codegauge.llm import conversations as c
from codegauge.llm.queries import damage_turns, repair_digest

WS = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def codes_of(rows):
    out, seen = [], set()
    for role, text in rows:
        shown = text.strip(WS)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) by best-first search over (turns read, last initial); no alignment table."""
    faults = codes_of(rows)
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, made
        if (i, last) in seen:
            continue
        seen.add((i, last))
        for initial in NEXT[last]:
            if initial != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", i, initial, made + (({"u": "user", "a": "assistant"}[initial], ""),)))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, made))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                for initial in NEXT[last]:
                    if role[:1] == initial:
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initial, made + ((role, text),)))
                    elif initial != "s":
                        new = ({"u": "user", "a": "assistant"}[initial], text)
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, initial, made + (new,)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged(table):
    out = []
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(x for x in text if x not in ".!?")
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute(table):
    groups = {r[0]: [] for r in table}
    for row in damaged(table):
        groups[row[0]].append(row[1:])
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in rows if r[0] is not None]
        faults = codes_of([r[1:] for r in rows])
        cost, audit, made = cheapest([r[1:] for r in rows])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        yield (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
               sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made)))


def conversations():
    rnd = random.Random(4)
    table = [(None, None, "user", "Null id."), (None, 2, None, None), (-1, None, "user", "x."), (-1, None, None, "y."), (-2, 1, "tool", ""),
             (-3, 5, "user", "same."), (-3, 5, "user", "same."), (-3, 5, "user", "same."), (-4, 0, "assistant", "z" * 50000 + ".")]
    for conv in range(1, 260):
        kinds = rnd.choice([["user", "assistant"], ["system", "user", "assistant", "user"], ["user", "assistant", "tool", "", "s"]])
        size = rnd.choice([1, 2, 3, 5, 8, 14, 40])
        texts = ["ok.", "well", "no!\n", " ", "why? ", "é.", "end.\x0b"]
        for turn in range(size):
            role = kinds[turn % len(kinds)] if rnd.random() < 0.7 else rnd.choice(kinds)
            text = rnd.choice(texts) + (str(rnd.randint(0, 99)) + rnd.choice([".", "", "."]) if rnd.random() < 0.6 else "")
            table.append((conv, turn * rnd.choice([1, 1, 2]) if rnd.random() < 0.9 else None, role, text))
    rnd.shuffle(table)
    return table


@pytest.mark.parametrize("chunk_rows", [512, 1, 3])
def test_equals_brute_force(spark, chunk_rows):
    table = conversations()
    df = spark.createDataFrame([(*r, 7, "z") for r in table], "conv_id long, turn long, role string, text string, id int, chunk string")
    found = repair_digest(df.select("conv_id"), c.repair(damage_turns(df), chunk_rows=chunk_rows))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(table), key=str)


def test_alignment_equals_search():
    rnd = random.Random(9)
    for _ in range(1500):
        rows = [(rnd.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rnd.choice(["a.", "b", "", "c.", "d.", f"{rnd.random()}."]))
                for _ in range(rnd.randint(0, 9))]
        initials, codes = c.turn_codes([r for r, _ in rows], [t for _, t in rows])
        ways = c.align(codes, c.NONE)
        cost, audit = min(ways[s] for s in (c.NONE, c.ASSISTANT) if s in ways)
        wanted = cheapest(rows)
        assert (cost, audit) == wanted[:2]
        assert tuple(zip(*c.apply_audit([r for r, _ in rows], [t for _, t in rows], c.NONE, audit))) == wanted[2]


def test_one_long_conversation_spreads_over_tasks(spark):
    rnd = random.Random(6)
    table = [(5, t, rnd.choice(["user", "assistant", "user", "assistant", "system"]), rnd.choice(["ok.", f"{t}.", f"{t}", ""])) for t in range(700)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    found = c.repair(damage_turns(df), chunk_rows=16)
    assert [tuple(r) for r in repair_digest(df.select("conv_id"), found).collect()] == list(brute(table))
    assert found.turns.count() > 700 // 20


def test_real_outputs_names_and_empty_table(spark):
    df = spark.createDataFrame([("k", 1, "user", "Hi."), ("k", 2, "user", "There."), ("m", 1, "assistant", "  ")], "c string, n int, r string, t string")
    found = c.repair(df, "c", "n", "r", "t")
    assert sorted((r.c, r.cost, r.audit) for r in found.summary.collect()) == [("k", 1, "KR"), ("m", 2, "D")]
    assert sorted((r.c, r.roles, r.texts) for r in found.turns.collect()) == [("k", ["user", "assistant"], ["Hi.", "There."]), ("m", [], [])]
    none = c.repair(df.where("n > 9"), "c", "n", "r", "t")
    assert none.summary.collect() == [] and none.turns.collect() == []
