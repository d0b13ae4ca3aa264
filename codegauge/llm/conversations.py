"""Repair of conversations by alignment with the alternating grammar `(system? (user assistant)+)?`.

A turn is blank (no visible character), a duplicate (role and text stood earlier in the conversation) or truncated (its last visible
character ends no sentence); the first of these counts. Turns are kept (0), given the role user or assistant (1), deleted (2,
required for blank and duplicate ones) or inserted with an empty text (5); a truncated turn that stays costs 5 more. Wanted is the
cheapest edit of the whole conversation, of equal ones the one whose audit (initials of the edits in order) is least.

Turns are aligned with the grammar string by Wagner and Fischer's table. All feasible lengths are prefixes of one string, so a single
table holds the cost of every length in its last row; Ukkonen's band leaves out the cells that no alignment within the incumbent's
cost can meet. The cheapest lengths are backtraced and their audits compared.

A conversation may hold any share of the rows. Rows are dealt and sorted by range, not by conversation, and cut into chunks of at
most `CHUNK_ROWS` turns. Conversations inside one chunk (nearly all) are finished there. A longer one is aligned chunk by chunk from
each of the grammar's four states into each of them; the chunks' costs and audits are then composed in order, which is exact since
equal letters from one state lead to one state and cost the same. Its duplicates are found by aggregated hashes of all turns.

Defined results: a null role or text counts as one space; null turns come first; turns of one number are ordered by role and text; a
null id is a conversation of its own; a conversation without turns has no row here; other columns are left out, whatever their
names; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from codegauge.session import scratch_path

CHUNK_ROWS, CHUNK_BYTES = 512, 4 << 20
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANK = " \t\n\x0b\x0c\r"

#: States of the grammar by the last turn: none, system, user, assistant. What may be renamed or inserted next, and its state.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NONE: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}


@dataclass
class Repair:
    """`summary`: one row per conversation (gaps, counts of faults, cost, audit). `turns`: its repaired turns in the order of `chunk`,
    as arrays `roles` and `texts`; `whole` where the row holds all of them."""

    summary: DataFrame
    turns: DataFrame


def turn_codes(roles: list[str], texts: list[str], repeated: Iterable[int] | None = None) -> tuple[str, str]:
    """For each turn its role's initial (x for any other) and the letter that alignment reads: D for a turn to be deleted, else the
    initial, as a capital where the text is truncated. `repeated` are the places of duplicates, None: all turns are here."""
    initials, codes, seen = [], [], set()
    known = None if repeated is None else set(repeated)
    for place, (role, text) in enumerate(zip(roles, texts)):
        initial = role[:1] if role[:1] in STATE else "x"
        shown = text.rstrip(BLANK)
        again = (role, text) in seen if known is None else place in known
        if known is None:
            seen.add((role, text))
        initials.append(initial)
        codes.append("B" if not shown else "D" if again else initial if shown[-1] in ".!?" else initial.upper())
    return "".join(initials), "".join(codes)


def _match(code: str, wanted: str) -> int | None:
    """Cost of letting a turn stand for a letter of the grammar, None where it cannot."""
    extra = TRUNCATED if code.isupper() else 0
    if code.lower() == wanted:
        return KEEP + extra
    return None if wanted == "s" else RENAME + extra


def _target(state: int, lead: str, size: int) -> str:
    first = "au" if state == USER else "ua"
    return (lead + first * size)[:size]


def _table(live: str, target: str, most: int) -> list[dict[int, int]]:
    """Cost of aligning i turns with j letters, where it may be part of an alignment that costs `most` at most."""
    table: list[dict[int, int]] = []
    for i in range(len(live) + 1):
        row: dict[int, int] = {}
        above = table[-1] if i else {}
        for j in range(max(0, i - most // DELETE), min(len(target), i + most // INSERT) + 1):
            best = 0 if not i and not j else most + 1
            if i and j in above:
                best = min(best, above[j] + DELETE)
            if j and target[j - 1] != "s" and j - 1 in row:
                best = min(best, row[j - 1] + INSERT)
            if i and j and j - 1 in above:
                cost = _match(live[i - 1], target[j - 1])
                if cost is not None:
                    best = min(best, above[j - 1] + cost)
            if best <= most:
                row[j] = best
        table.append(row)
    return table


def _least_audit(live: str, dead: list[int], target: str, table: list[dict[int, int]], size: int) -> str:
    """The least audit of the cheapest alignments with the first `size` letters: cells on such alignments are marked backwards, then
    the smallest letter that stays on marked cells is taken. Turns that must go are deleted as soon as they are reached."""
    marked, todo = set(), [(len(live), size)]
    while todo:
        cell = todo.pop()
        if cell in marked:
            continue
        marked.add(cell)
        i, j = cell
        cost = table[i][j]
        if i and table[i - 1].get(j, cost) + DELETE == cost:
            todo.append((i - 1, j))
        if j and target[j - 1] != "s" and table[i].get(j - 1, cost) + INSERT == cost:
            todo.append((i, j - 1))
        if i and j and j - 1 in table[i - 1]:
            step = _match(live[i - 1], target[j - 1])
            if step is not None and table[i - 1][j - 1] + step == cost:
                todo.append((i - 1, j - 1))
    out, i, j = ["D" * dead[0]], 0, 0
    while (i, j) != (len(live), size):
        cost = table[i][j]
        if (i + 1, j) in marked and table[i + 1][j] == cost + DELETE:
            out.append("D")
            i += 1
        elif (i, j + 1) in marked and target[j] != "s" and table[i][j + 1] == cost + INSERT:
            out.append("I")
            j += 1
            continue
        else:
            out.append("K" if live[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
        out.append("D" * dead[i])
    return "".join(out)


@lru_cache(1 << 14)
def align(codes: str, start: int) -> dict[int, tuple[int, str]]:
    """Cheapest cost and least audit of leading the grammar from state `start` over all turns into each state that can be reached."""
    live = "".join(c for c in codes if c not in "BD")
    dead = [len(part) for part in codes.translate(str.maketrans("BDsuaxSUAX", "DDkkkkkkkk")).split("k")]
    n, forced = len(live), DELETE * (len(codes) - len(live))
    ways = {start: (forced + DELETE * n, "D" * len(codes))}  # nothing stays

    def offer(state: int, cost: int, audit: str) -> None:
        ways[state] = min(ways.get(state, (cost, audit)), (cost, audit))

    if start == NONE:  # nothing but one system turn stays, the last of the cheapest ones
        system = [(TRUNCATED * code.isupper(), -place) for place, code in enumerate(codes) if code in "sS"]
        if system:
            cost, place = min(system)
            offer(SYSTEM, forced + DELETE * (n - 1) + cost, "D" * -place + "K" + "D" * (len(codes) + place - 1))
    for lead in ("", "s") if start == NONE else ("",):
        one_each = [_match(code, wanted) for code, wanted in zip(live, _target(start, lead, n))]
        most = min(DELETE * n, DELETE * n if None in one_each else sum(one_each)) + 2 * INSERT
        target = _target(start, lead, n + most // INSERT)
        table = _table(live, target, most)
        last = table[n]
        sizes: dict[int, list[int]] = {}
        for j in last:
            if j:
                sizes.setdefault(STATE[target[j - 1]], []).append(j)
        for state, found in sizes.items():
            cost = min(last[j] for j in found)
            if forced + cost <= ways.get(state, (forced + cost,))[0]:
                for j in found:
                    if last[j] == cost:
                        offer(state, forced + cost, _least_audit(live, dead, target, table, j))
    return ways


def apply_audit(roles: list[str], texts: list[str], state: int, audit: str) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of an audit that begins in a state of the grammar."""
    new_roles, new_texts, place = [], [], 0
    for edit in audit:
        if edit != "D":
            letter, after = NEXT[state]
            if edit == "K":
                after = STATE[roles[place][:1]]
            new_roles.append(roles[place] if edit == "K" else ROLE[letter])
            new_texts.append("" if edit == "I" else texts[place])
            state = after
        place += edit != "I"
    return new_roles, new_texts


def chunk_facts(initials: str, codes: str, turns: list[int | None]) -> dict[str, Any]:
    """Counts of a stretch of turns and what its neighbours must know to add theirs."""
    numbers = [t for t in turns if t is not None]
    return {"blank": codes.count("B"), "duplicate": codes.count("D"), "truncated": sum(c in "SUAX" for c in codes),
            "illegal": sum(initials[k:k + 2] not in LEGAL for k in range(len(initials) - 1)),
            "first": initials[:1], "last": initials[-1:], "low": min(numbers, default=None), "high": max(numbers, default=None),
            "numbers": len(set(numbers))}


def joined_facts(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
    out = {name: a[name] + b[name] for name in ("blank", "duplicate", "truncated", "illegal", "numbers")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["numbers"] -= a["high"] is not None and a["high"] == b["low"]
    out |= {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"],
            "high": a["high"] if b["high"] is None else b["high"]}
    return out


def _summary(facts: dict[str, Any], cost: int, audit: str) -> dict[str, Any]:
    gaps = 0 if facts["low"] is None else facts["high"] - facts["low"] + 1 - facts["numbers"]
    return {"gaps": gaps, "blank": facts["blank"], "duplicate": facts["duplicate"], "truncated": facts["truncated"],
            "illegal": facts["illegal"], "cost": cost, "audit": audit}


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SUMMARY = [(name, pa.int64()) for name in _COUNTS] + [("audit", pa.string())]
_SUMMARY_SQL = ", ".join(f"{name} long" for name in _COUNTS) + ", audit string"
_STRINGS = pa.list_(pa.string())
_WAYS = pa.list_(pa.struct([("into", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_FACTS = pa.struct([(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "numbers", "low", "high")]
                   + [("first", pa.string()), ("last", pa.string())])
_PARTS = pa.list_(pa.struct([("chunk", pa.int64()), ("into", pa.int32()), ("audit", pa.string())]))


def _batches(rows: Iterator[dict[str, Any]], fields: list[tuple[str, pa.DataType]], size=lambda row: 1, limit: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about `limit` in size."""
    schema, held, total = pa.schema(fields), [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for batch in batches:
        yield from batch.to_pylist()


def _cut(rows: Iterator[dict[str, Any]], part: int, chunk_rows: int) -> Iterator[dict[str, Any]]:
    """Chunks of sorted turns. Whole are conversations of one chunk with others before and behind them in this partition."""
    chunk, number, size = None, 0, 0
    opened = False  # the chunk's conversation surely began with it
    for row in rows:
        other = chunk is not None and chunk["id"] != row["id"]
        if chunk is None or other or len(chunk["roles"]) >= chunk_rows or size >= CHUNK_BYTES:
            if chunk is not None:
                yield chunk | {"whole": opened and other}
            opened, size = other, 0
            chunk = {"id": row["id"], "chunk": (part << 40) + number, "roles": [], "texts": [], "turns": []}
            number += 1
        chunk["roles"].append(row["role"])
        chunk["texts"].append(row["text"])
        chunk["turns"].append(row["turn"])
        size += len(row["text"]) + len(row["role"])
    if chunk is not None:
        yield chunk | {"whole": False}


def _composed(rows: Iterator[dict[str, Any]]) -> Iterator[dict[str, Any]]:
    """Conversations from their chunks in order: the cheapest ways into each state, chunk after chunk."""

    def text(path) -> str:
        out = []
        while path:
            path, _, _, audit = path
            out.append(audit)
        return "".join(reversed(out))

    def done(owner, facts, ways) -> dict[str, Any]:
        cost, audit, path = min((cost, text(path), path) for state, (cost, path) in ways.items() if state in (NONE, ASSISTANT))
        parts = []
        while path:
            path, chunk, into, own = path
            parts.append({"chunk": chunk, "into": into, "audit": own})
        return {"id": owner, "parts": parts} | _summary(facts, cost, audit)

    owner, facts, ways = None, None, {}
    for row in rows:
        if facts is not None and row["id"] != owner:
            yield done(owner, facts, ways)
            facts = None
        if facts is None:
            owner, facts, ways = row["id"], row["facts"], {NONE: (0, None)}
        else:
            facts = joined_facts(facts, row["facts"])
        after: dict[int, tuple[int, Any]] = {}
        for way in row["ways"]:
            if way["into"] in ways:
                cost, path = ways[way["into"]]
                new = (cost + way["cost"], (path, row["chunk"], way["into"], way["audit"]))
                old = after.get(way["state"])
                if old is None or new[0] < old[0] or (new[0] == old[0] and text(new[1]) < text(old[1])):
                    after[way["state"]] = new
        ways = after
    if facts is not None:
        yield done(owner, facts, ways)


def _text_size(row: dict[str, Any]) -> int:
    return 100 + sum(map(len, row["texts"]))


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           chunk_rows: int = CHUNK_ROWS) -> Repair:
    """The repaired conversations of a table with one row per turn."""
    spark = rows.sparkSession
    source = rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"),
                         F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    id_arrow = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"conversations-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("id", id_arrow), ("chunk", pa.int64()), ("whole", pa.bool_()), ("roles", _STRINGS), ("texts", _STRINGS),
                  ("turns", pa.list_(pa.int64()))]
        yield from _batches(_cut(_rows(batches), TaskContext.get().partitionId(), chunk_rows), fields, _text_size, CHUNK_BYTES)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict[str, Any]]:
            for row in _rows(batches):
                initials, codes = turn_codes(row["roles"], row["texts"])
                ways = align(codes, NONE)
                cost, audit = min(ways[state] for state in (NONE, ASSISTANT) if state in ways)
                roles, texts = apply_audit(row["roles"], row["texts"], NONE, audit)
                yield {"id": row["id"], "chunk": row["chunk"], "roles": roles, "texts": texts} \
                    | _summary(chunk_facts(initials, codes, row["turns"]), cost, audit)

        yield from _batches(each(), [("id", id_arrow), ("chunk", pa.int64()), *_SUMMARY, ("roles", _STRINGS), ("texts", _STRINGS)],
                            _text_size, CHUNK_BYTES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict[str, Any]]:
            for row in _rows(batches):
                initials, codes = turn_codes(row["roles"], row["texts"], row["again"] or [])
                yield {"id": row["id"], "chunk": row["chunk"], "facts": chunk_facts(initials, codes, row["turns"]),
                       "ways": [{"into": into, "state": state, "cost": cost, "audit": audit} for into in range(4)
                                for state, (cost, audit) in align(codes, into).items()]}

        yield from _batches(each(), [("id", id_arrow), ("chunk", pa.int64()), ("facts", _FACTS), ("ways", _WAYS)])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_composed(_rows(batches)), [("id", id_arrow), *_SUMMARY, ("parts", _PARTS)])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict[str, Any]]:
            for row in _rows(batches):
                roles, texts = apply_audit(row["roles"], row["texts"], row["into"], row["audit"])
                yield {"id": row["id"], "chunk": row["chunk"], "roles": roles, "texts": texts}

        yield from _batches(each(), [("id", id_arrow), ("chunk", pa.int64()), ("roles", _STRINGS), ("texts", _STRINGS)], _text_size, CHUNK_BYTES)

    texts_sql = "roles array<string>, texts array<string>"
    chunks = stored(source.repartitionByRange("id", "turn").sortWithinPartitions("id", "turn", "role", "text")
                    .mapInArrow(cut, f"id {id_type}, chunk long, whole boolean, {texts_sql}, turns array<long>"), "chunks")
    done = stored(chunks.where("whole").mapInArrow(finish, f"id {id_type}, chunk long, {_SUMMARY_SQL}, {texts_sql}"), "whole")

    split = chunks.where("NOT whole")
    turns = split.select("id", "chunk", F.posexplode(F.expr(
        "transform(arrays_zip(roles, texts), t -> md5(concat(length(t.roles), ':', t.roles, t.texts)))")).alias("place", "turn_hash"))
    first = turns.groupBy(F.col("id").alias("i"), F.col("turn_hash").alias("h")) \
        .agg(F.min(F.struct("chunk", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = turns.join(first, F.col("id").eqNullSafe(F.col("i")) & (F.col("turn_hash") == F.col("h"))) \
        .where("struct(chunk, place) <> first").groupBy("chunk").agg(F.collect_list("place").alias("again"))
    facts_sql = ", ".join(f"{f.name}: {'string' if f.type == pa.string() else 'long'}" for f in _FACTS)
    composed = stored(
        split.join(again, "chunk", "left").select("id", "chunk", "roles", "texts", "turns", "again")
        .mapInArrow(measure, f"id {id_type}, chunk long, facts struct<{facts_sql}>, "
                             "ways array<struct<into: int, state: int, cost: long, audit: string>>")
        .repartition("id").sortWithinPartitions("id", "chunk")
        .mapInArrow(compose, f"id {id_type}, {_SUMMARY_SQL}, parts array<struct<chunk: long, into: int, audit: string>>"), "composed")
    parts = composed.select(F.explode("parts").alias("part")).select("part.*")
    edited = split.select("id", "chunk", "roles", "texts").join(parts, "chunk").select("id", "chunk", "roles", "texts", "into", "audit") \
        .mapInArrow(edit, f"id {id_type}, chunk long, {texts_sql}")

    names = [*_COUNTS, "audit"]
    summary = done.select("id", *names).unionByName(composed.select("id", *names))
    repaired = done.select("id", "chunk", F.lit(True).alias("whole"), "roles", "texts") \
        .unionByName(edited.select("id", "chunk", F.lit(False).alias("whole"), "roles", "texts"))
    return Repair(summary.withColumnRenamed("id", id_col), repaired.withColumnRenamed("id", id_col))
