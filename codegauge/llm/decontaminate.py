"""Benchmark decontamination with suffix arrays over the training words.

Every task turns its documents into shards of a few MiB, builds a word-level suffix array of each shard, and binary-searches all
benchmark suffixes in it. A suffix that meets a training suffix in at least `window` words (or in all words of a shorter item) is
an occurrence; it is extended to its longest verbatim length. Documents never move: the step is row-local, and only the
benchmark travels, in blocks of bounded size, one pass for each block.

Defined results: a null or empty text has no words and is never hit; a null item text has no window; an item without an id marks
words but is not listed; equal item ids are listed once; repeated documents are judged row by row; all other columns pass
unchanged, whatever their names; empty tables give empty or clean results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codegauge.llm.words import NON_WORD, row_filter, slices, word_hashes, words

WINDOW = 10
#: Text bytes of the benchmark that one pass takes to the executors.
BLOCK_BYTES = 32 << 20

MATCH = "array<struct<start:long,n_words:long,item_start:long,item_ids:array<string>>>"
_MATCH_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("item_start", pa.int64()),
                                   ("item_ids", pa.list_(pa.string()))]))


@dataclass
class Tests:
    """The suffixes of the distinct benchmark texts that hold a whole window, packed several words to a key."""

    vocabulary: np.ndarray  # sorted word hashes; id of a word: its position + 1, 0 for a word the benchmark lacks
    bits: int
    per_key: int
    keys: np.ndarray  # suffixes x blocks, zero-padded
    need: np.ndarray  # words of a suffix that an occurrence must share
    length: np.ndarray
    text: np.ndarray  # number of the benchmark text
    start: np.ndarray  # first word of the suffix in its text
    ids: list[list[str]]  # item ids of each text


def pack(ids: np.ndarray, bits: int, per_key: int) -> np.ndarray:
    """At every position the next `per_key` word ids as one integer."""
    padded = np.concatenate([ids, np.zeros(per_key, np.int64)])
    out = np.zeros(len(ids), np.int64)
    for k in range(per_key):
        out = (out << bits) | padded[k:k + len(ids)]
    return out


def build_tests(items: list[tuple[str | None, str | None]], window: int) -> Tests | None:
    by_text: dict[bytes, tuple[np.ndarray, set[str]]] = {}
    for (item_id, _), hashes in zip(items, word_hashes([text or "" for _, text in items], NON_WORD)):
        if len(hashes):
            by_text.setdefault(hashes.tobytes(), (hashes, set()))[1].update([] if item_id is None else [item_id])
    if not by_text:
        return None
    sequences = [h for h, _ in by_text.values()]
    vocabulary = np.unique(np.concatenate(sequences))
    bits = max(1, int(len(vocabulary)).bit_length())
    per_key = max(1, 62 // bits)
    need, length, text, start, flat, at = [], [], [], [], [], []
    total = 0
    for number, hashes in enumerate(sequences):
        w = min(window, len(hashes))
        first = np.arange(len(hashes) - w + 1)
        need.append(np.full(len(first), w))
        length.append(len(hashes) - first)
        text.append(np.full(len(first), number))
        start.append(first)
        at.append(first + total)
        ids = np.append(np.searchsorted(vocabulary, hashes) + 1, np.zeros(per_key, np.int64))
        flat.append(ids)
        total += len(ids)
    keys, at = pack(np.concatenate(flat), bits, per_key), np.concatenate(at)
    length = np.concatenate(length)
    blocks = math.ceil(int(length.max()) / per_key)
    steps = np.arange(blocks) * per_key
    reach = np.minimum(at[:, None] + steps, len(keys) - 1)
    packed = np.where(steps < length[:, None], keys[reach], 0)
    return Tests(vocabulary, bits, per_key, packed, np.concatenate(need), length, np.concatenate(text),
                 np.concatenate(start), [sorted(ids) for _, ids in by_text.values()])


def word_ids(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def suffix_array(ids: np.ndarray, keys: np.ndarray, tests: Tests) -> np.ndarray:
    """Positions of benchmark words in the order of their suffixes, as far as a benchmark text can reach."""
    order = np.flatnonzero(ids)
    key = keys[order]
    by = np.argsort(key, kind="stable")
    order, key = order[by], key[by]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else np.zeros(0, np.int64)
    last = (1 << tests.bits) - 1
    open_ = np.arange(len(order))
    for block in range(1, tests.keys.shape[1]):
        same = np.zeros(len(open_), bool)
        if len(open_) > 1:
            equal = group[open_][1:] == group[open_][:-1]
            same[1:] |= equal
            same[:-1] |= equal
        whole = (keys[np.minimum(order[open_] + (block - 1) * tests.per_key, len(keys) - 1)] & last) != 0
        open_ = open_[same & whole]  # after a foreign word no benchmark suffix goes on
        if not len(open_):
            break
        ahead = order[open_] + block * tests.per_key
        key = np.where(ahead < len(keys), keys[np.minimum(ahead, len(keys) - 1)], 0)
        by = np.lexsort((key, group[open_]))
        order[open_], key = order[open_][by], key[by]
        parts = group[open_]
        # positions keep their slots; inside a group, equal keys keep a common number below any other group's
        new = np.concatenate([[True], (parts[1:] != parts[:-1]) | (key[1:] != key[:-1])])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] + len(order) * block
    return order


def bound(order: np.ndarray, keys: np.ndarray, probes: np.ndarray, blocks: np.ndarray, per_key: int) -> np.ndarray:
    """For every probe the number of suffixes that are smaller, by binary search over all probes at once."""
    low, high = np.zeros(len(probes), np.int64), np.full(len(probes), len(order), np.int64)
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        mid = (low[live] + high[live]) // 2
        less, todo, block = np.zeros(len(live), bool), np.arange(len(live)), 0
        while len(todo):
            at = order[mid[todo]] + block * per_key
            there = np.where(at < len(keys), keys[np.minimum(at, len(keys) - 1)], 0)
            wanted = probes[live[todo], block]
            less[todo[there < wanted]] = True
            block += 1
            todo = todo[(there == wanted) & (blocks[live[todo]] > block)]
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]


def _shared(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, suffix: np.ndarray, tests: Tests) -> np.ndarray:
    """Words that training suffix and benchmark suffix have in common."""
    out = np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    for block in range(tests.keys.shape[1]):
        here = at[todo] + block * tests.per_key
        there = np.where(here < len(keys), keys[np.minimum(here, len(keys) - 1)], 0)
        wanted = tests.keys[suffix[todo], block]
        equal = np.ones(len(todo), bool)
        for k in range(tests.per_key):
            shift = tests.bits * (tests.per_key - 1 - k)
            mask = (1 << tests.bits) - 1
            a, b = (there >> shift) & mask, (wanted >> shift) & mask
            equal &= (a == b) & (a != 0)
            out[todo] += equal
        todo = todo[equal]
        if not len(todo):
            break
    return out


def occurrences(number: np.ndarray, hashes: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word in the shard, suffix, words in common) of every occurrence in a shard's words."""
    ids = word_ids(hashes, tests.vocabulary)
    # a foreign word parts neighbouring documents
    gap = np.concatenate([[0], np.cumsum(number[1:] != number[:-1])]) if len(number) else np.zeros(0, np.int64)
    spread = np.zeros(len(ids) + (int(gap[-1]) + 1 if len(gap) else 0), np.int64)
    place = np.arange(len(ids)) + gap
    spread[place] = ids
    back = np.zeros(len(spread), np.int64)
    back[place] = np.arange(len(ids))
    keys = pack(spread, tests.bits, tests.per_key)
    order = suffix_array(spread, keys, tests)
    blocks = -(-tests.need // tests.per_key)
    column = np.arange(tests.keys.shape[1])
    free = (blocks * tests.per_key - tests.need) * tests.bits
    low = tests.keys.copy()
    rows = np.arange(len(low))
    low[rows, blocks - 1] = (low[rows, blocks - 1] >> free) << free
    low[column[None, :] >= blocks[:, None]] = 0
    high = low.copy()
    high[rows, blocks - 1] += np.int64(1) << free
    first, last = (bound(order, keys, p, blocks, tests.per_key) for p in (low, high))
    count = np.maximum(last - first, 0)
    suffix = np.repeat(rows, count)
    at = order[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    shared = np.minimum(_shared(spread, keys, at, suffix, tests), tests.length[suffix])
    return number[back[at]], back[at], suffix, shared


def _judge(batch: pa.RecordBatch, text_col: str, tests: Tests) -> tuple[np.ndarray, list[list[dict]]]:
    """Words and maximal matches of every row: a match is left out if one word earlier it is a match already."""
    number, hashes = words(batch.column(text_col), NON_WORD)
    n_words = np.bincount(number, minlength=batch.num_rows)
    found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    doc, at, suffix, shared = occurrences(number, hashes, tests)
    if len(at):
        first_word = np.cumsum(n_words) - n_words
        by = np.lexsort((at, tests.text[suffix], at - tests.start[suffix], doc))
        doc, at, suffix, shared = doc[by], at[by], suffix[by], shared[by]
        again = np.zeros(len(at), bool)
        again[1:] = (doc[1:] == doc[:-1]) & (tests.text[suffix[1:]] == tests.text[suffix[:-1]]) & (at[1:] == at[:-1] + 1) \
            & (tests.start[suffix[1:]] == tests.start[suffix[:-1]] + 1)
        for d, a, s, n in zip(*(x[~again].tolist() for x in (doc, at, suffix, shared))):
            found[d].append({"start": a - int(first_word[d]), "n_words": n, "item_start": int(tests.start[s]),
                             "item_ids": tests.ids[tests.text[s]]})
    return n_words, found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Benchmark rows in blocks of about `limit` bytes; the driver never holds more than one."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")) \
        .where("t IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("t") + F.lit(16))).first()[0] or 0
    n = math.ceil(2 * total / limit) if total > limit else 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its id, `n_words`, and `matches`: the longest verbatim stretches shared with the benchmark
    (first word, length in words, first word in the item, ids of the items with that text)."""
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
                        F.expr(f"CAST(array() AS {MATCH})").alias("matches"))
    schema = state.schema
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        tests = docs.sparkSession.sparkContext.broadcast(build_tests(items, window))

        def one_pass(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    if tests.value is None:
                        number, _ = words(part.column("text"), NON_WORD)
                        n, found = np.bincount(number, minlength=part.num_rows), [[] for _ in range(part.num_rows)]
                    else:
                        n, found = _judge(part, "text", tests.value)
                    known = part.column("matches").to_pylist()
                    matches = pa.array([a + b for a, b in zip(known, found)], _MATCH_ARROW)
                    yield pa.record_batch([part.column("id"), part.column("text"), pa.array(n, pa.int64()), matches],
                                          names=["id", "text", "n_words", "matches"])

        state = state.mapInArrow(one_pass, schema)
    return state.select(F.col("id").alias(id_col), "n_words", "matches")


def covered_words(matches: str = "matches") -> F.Column:
    """Words inside any match: the union of its stretches."""
    return F.expr(f"""aggregate(array_sort({matches}), named_struct('n', 0L, 'upto', 0L),
        (s, m) -> named_struct('n', s.n + greatest(0L, m.start + m.n_words - greatest(s.upto, m.start)),
                               'upto', greatest(s.upto, m.start + m.n_words)), s -> s.n)""")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                        item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any window of the benchmark, all columns as they are."""
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        tests = docs.sparkSession.sparkContext.broadcast(build_tests(items, window))

        def keep(part: pa.RecordBatch, tests=tests) -> np.ndarray:
            clean = np.ones(part.num_rows, bool)
            if tests.value is not None:
                clean[occurrences(*words(part.column("text"), NON_WORD), tests.value)[0]] = False
            return clean

        docs = docs.where(row_filter(keep)(F.col(text_col)))
    return docs
