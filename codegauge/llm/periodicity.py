"""Periodic runs of words, found with a run-length grammar built by recompression.

Every task turns its texts into one sequence of words with a separator of its own behind each text. Recompression alternates two
steps until one symbol is left: block compression names every repetition of one symbol, pair compression splits the symbols into a
left and a right side and names every left-right pair. The levels form a grammar whose parse of a place depends on its
surroundings only, so the longest common extension of two places is found by climbing while both parses agree and descending into
the first symbols that differ: one step for each level, for all places of a slice at once. Symbols are named exactly (no
fingerprints), and no suffix array is built.

A run of period q and length `least` or more keeps word and word-q-later equal over at least `least - q` places, so a grid of that
width meets it: n/q places for each q, n log n in all. Forward and backward extension of a grid place give the exact run. Texts
never move: the step is row-local, and memory follows one slice of texts (or one long text).

Defined results: a null or empty text has no words, no runs and an empty collapsed text; repeated rows are judged row by row;
ids may be null; other columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codegauge.llm.words import joined_words, mix, slices, split_words

LEAST, TIMES = 6, 4
#: Text bytes that share one grammar, and grid places looked at in one go.
SLICE_BYTES, PLACES = 1 << 20, 1 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


@dataclass
class Level:
    """A level's symbols and how the next level holds them."""

    symbols: np.ndarray
    parent: np.ndarray  # number of the next level's symbol that holds a symbol
    first: np.ndarray  # first symbol that a symbol of the next level holds, and the end
    blocks: bool  # repetitions were compressed, else pairs

    def mirrored(self) -> Level:
        return Level(self.symbols[::-1], self.parent[-1] - self.parent[::-1], len(self.symbols) - self.first[::-1], self.blocks)


def _next_level(symbols: np.ndarray, head: np.ndarray, blocks: bool) -> Level:
    return Level(symbols, np.cumsum(head) - 1, np.append(np.flatnonzero(head), len(symbols)), blocks)


def recompress(symbols: np.ndarray) -> list[Level]:
    """The grammar of a sequence of non-negative numbers, lowest level first."""
    levels, turn = [], 0
    fresh = int(symbols.max(initial=0)) + 1
    while len(symbols) > 1:
        again = symbols[1:] == symbols[:-1]
        if again.any():
            level = _next_level(symbols, np.append(True, ~again), True)
            length = np.diff(level.first)
            many = length > 1
            symbols = symbols[level.first[:-1]]
            code, names = pd.factorize(symbols[many] * (int(length.max()) + 1) + length[many])
            symbols[many] = fresh + code
            fresh += len(names)
            levels.append(level)
            if len(symbols) == 1:
                break
        turn += 1
        right = (mix(symbols.astype(np.uint64) + np.uint64(turn << 40)) & np.uint64(1)).astype(bool)
        pair, other = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
        if other.sum() > pair.sum():
            pair = other
        if not pair.any():
            continue  # all symbols on one side: dealt anew
        level = _next_level(symbols, np.append(True, ~pair), False)
        head = level.first[:-1]
        two = np.append(pair, False)[head]
        code, names = pd.factorize(symbols[head[two]] * fresh + symbols[head[two] + 1])
        symbols = symbols[head]
        symbols[two] = fresh + code
        fresh += len(names)
        levels.append(level)
    return levels


def common_extension(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For all pairs of different places the number of equal symbols from there on; both must meet unequal symbols at last."""
    start, stopped, live = y, [], np.arange(len(x))
    for level in levels:
        if not len(live):
            break
        symbols, parent, first = level.symbols, level.parent, level.first
        same = symbols[x] == symbols[y]
        differ = [(live[~same], x[~same], y[~same])]
        live, x, y = live[same], x[same], y[same]
        up, vp = parent[x], parent[y]
        inner = (first[up] != x) | (first[vp] != y)  # a parse differs to the left: this symbol is taken off
        if level.blocks:
            left, other = first[up + 1] - x, first[vp + 1] - y
            taken = np.where(inner, np.minimum(left, other), 0)
            ends = inner & (left != other)
        else:
            taken, ends = inner.astype(np.int64), np.zeros(len(x), bool)
        x, y = x + taken, y + taken
        differ.append((live[ends], x[ends], y[ends]))
        live, x, y = live[~ends], parent[x[~ends]], parent[y[~ends]]
        stopped.append([np.concatenate(part) for part in zip(*differ)])
    place = y[:0]
    row, x = live[:0], x[:0]
    out = np.zeros(len(start), np.int64)
    y = place
    for depth in range(len(stopped) - 1, -1, -1):
        if len(row):
            level = levels[depth]
            symbols, first = level.symbols, level.first
            left, other = first[x + 1] - first[x], first[y + 1] - first[y]
            x, y = first[x], first[y]
            taken = np.where(symbols[x] == symbols[y], np.minimum(left, other) if level.blocks else 1, 0)
            x, y = x + taken, y + taken
        row, x, y = (np.concatenate(part) for part in zip((row, x, y), stopped[depth]))
    out[row] = y
    return out - start


def _grid(sizes: np.ndarray, base: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place and period of every grid place, a bounded number at a time."""
    periods = np.where(sizes >= least, sizes // times, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    width = np.maximum(least, times * period) - period
    count = (sizes[text] - period) // width
    total = np.cumsum(count)
    start = 0
    while start < len(text):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + PLACES, "right")))
        part = np.repeat(np.arange(start, stop), count[start:stop])
        nth = np.arange(len(part)) - np.repeat(total[start:stop] - count[start:stop] - done, count[start:stop])
        yield text[part], base[text[part]] + (nth + 1) * width[part] - 1, period[part]
        start = stop


def find_periods(number: np.ndarray, ids: np.ndarray, rows: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Columns text, start, length, period of all runs of a slice, by text, start and period."""
    sizes = np.bincount(number, minlength=rows).astype(np.int64)
    base = np.cumsum(sizes) - sizes + np.arange(rows) + 1
    known = int(ids.max(initial=-1)) + 1
    symbols = np.full(len(ids) + rows + 1, -1, np.int64)
    symbols[np.arange(len(ids)) + number + 1] = ids
    gaps = np.flatnonzero(symbols < 0)
    symbols[gaps] = known + np.arange(len(gaps))
    levels, mirror, found = None, None, [np.zeros((4, 0), np.int64)]
    for text, place, period in _grid(sizes, base, least, times):
        equal = symbols[place] == symbols[place + period]
        text, place, period = text[equal], place[equal], period[equal]
        if not len(text):
            continue
        if levels is None:
            levels = recompress(symbols)
            mirror = [level.mirrored() for level in levels]
        last = len(symbols) - 1
        ahead = common_extension(levels, place, place + period)
        back = common_extension(mirror, last - place, last - place - period)
        start, length = place - back + 1, ahead + back - 1 + period
        long = length >= np.maximum(least, times * period)
        found.append(np.unique(np.stack([text, start - base[text], length, period])[:, long], axis=1))
    out = np.concatenate(found, axis=1)
    out = out[:, np.lexsort((out[3], out[2], out[1], out[0]))]
    # a stretch found with several periods is a run of the smallest only
    fresh = np.append(True, (out[:3, 1:] != out[:3, :-1]).any(axis=0))[:out.shape[1]]
    out = out[:, fresh]
    return out[:, np.lexsort((out[3], out[1], out[0]))]


def repeats(number: np.ndarray, rows: int, found: np.ndarray) -> np.ndarray:
    """Whether a word stands in any run behind the run's first period."""
    first = np.searchsorted(number, np.arange(rows))
    edge = np.zeros(len(number) + 1, np.int64)
    text, start, length, period = found
    np.add.at(edge, first[text] + start + period, 1)
    np.add.at(edge, first[text] + start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, `n_words`, `runs` (start, length, period, by start and period) of `least` words and `times`
    periods or more, and `collapsed`, the text without the words that repeat a run's first period."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows = part.num_rows
                number, found = split_words(part.column("text"))
                ids = found.dictionary_encode().indices.to_numpy().astype(np.int64)
                table = find_periods(number, ids, rows, least, times)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(table[0], np.arange(rows + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(c) for c in table[1:]], ["start", "length", "period"]))
                yield pa.record_batch(
                    [part.column("id"), pa.array(np.bincount(number, minlength=rows)), lists,
                     joined_words(found, number, rows, ~repeats(number, rows, table))],
                    names=["id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"
    return source.mapInArrow(judge, schema).withColumnRenamed("id", id_col)
