"""Words of whole texts as 64-bit hashes, computed over the bytes of an Arrow batch.

Both word classes used here separate at ASCII bytes only, so UTF-8 bytes can be cut without decoding. Bytes are worked off in
blocks of about one MiB that end between two words; memory does not grow with the length of a text, only with its words.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

BLOCK = 1 << 20
#: Bytes of a word from which on `plain_words` hashes it by itself: long words can be built to share a sum of powers.
_LONG = 256
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD1342543DE82EF95
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)

#: Separators of words `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, applied after lower-casing A-Z.
NON_WORD = np.ones(256, bool)
NON_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(odd: int, n: int) -> np.ndarray:
    out = np.full(n, odd, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_ODD, BLOCK), _powers(_ODD_INVERSE, BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its head and the hash of its next item."""
    return mix(first * _MULT + then)


def stretches(hashes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from starts and numbers of items to the hashes of these stretches."""
    n = len(hashes)
    power, inverse = _powers(_ODD, n + 1), _powers(_ODD_INVERSE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[1:], out=total[1:])
    return lambda start, size: mix((total[start + size] - total[start]) * inverse[start] + size.astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column and the offsets of each text; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def _blocks(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that begin and end between two words."""
    start, n = 0, len(data)
    while start < n:
        stop = min(start + BLOCK, n)
        if stop < n:
            text_end = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            if text_end > start:
                stop = text_end
            else:
                gaps = np.flatnonzero(separators[data[start:stop]])
                if len(gaps):
                    stop = start + int(gaps[-1]) + 1
                else:  # one word longer than a block: up to its end
                    text_end = int(offsets[np.searchsorted(offsets, stop, "right")])
                    while stop < text_end:
                        gaps = np.flatnonzero(separators[data[stop:min(stop + BLOCK, text_end)]])
                        if len(gaps):
                            stop += int(gaps[0])
                            break
                        stop = min(stop + BLOCK, text_end)
        yield start, stop
        start = stop


def _block_words(data: np.ndarray, cuts: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; `cuts` are the positions where another text begins."""
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(column: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number (its position in the column) and 64-bit hash of every lower-cased word, in order."""
    data, offsets = text_bytes(column)
    texts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start, stop in _blocks(data, offsets, separators):
        block = _LOWER[data[start:stop]]
        cuts = offsets[np.searchsorted(offsets, start, "right"):np.searchsorted(offsets, stop, "left")] - start
        begins, ends = _block_words(block, np.unique(cuts), separators)
        if not len(begins):
            continue
        n = len(block)
        power, inverse = (_POWER, _INVERSE) if n <= BLOCK else (_powers(_ODD, n), _powers(_ODD_INVERSE, n))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[block] * power[:n], out=total[1:])
        value = (total[ends] - total[begins]) * inverse[begins]
        hashes.append(mix(value + (ends - begins).astype(np.uint64)))
        texts.append(np.searchsorted(offsets, begins + start, "right") - 1)
    return np.concatenate(texts), np.concatenate(hashes)


def plain_words(column: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of every unchanged word, in order; the same in all tasks."""
    data, offsets = text_bytes(column)
    texts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start, stop in _blocks(data, offsets, separators):
        block = data[start:stop]
        cuts = offsets[np.searchsorted(offsets, start, "right"):np.searchsorted(offsets, stop, "left")] - start
        begins, ends = _block_words(block, np.unique(cuts), separators)
        size = ends - begins
        long = np.flatnonzero(size > _LONG)
        total = np.zeros(min(len(block), BLOCK) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[block[:BLOCK]] * _POWER[:len(block)], out=total[1:])
        value = (total[np.minimum(ends, BLOCK)] - total[begins]) * _INVERSE[begins] if len(begins) else np.zeros(0, np.uint64)
        value[long] = [xxhash.xxh3_64_intdigest(block[begins[k]:ends[k]]) for k in long.tolist()]
        hashes.append(mix(value + size.astype(np.uint64)))
        texts.append(np.searchsorted(offsets, begins + start, "right") - 1)
    return np.concatenate(texts), np.concatenate(hashes)


def split_words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Text number and unchanged bytes of every word `[^\x20\x09-\x0D]+`, in order."""
    data, offsets = text_bytes(column)
    inside = ~SPACES[data]
    begins, ends = _block_words(data, np.unique(offsets[(offsets > 0) & (offsets < len(data))]), SPACES)
    at = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(ends - begins, out=at[1:])
    found = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    return np.searchsorted(offsets, begins, "right") - 1, found


def joined_words(found: pa.Array, number: np.ndarray, rows: int, keep: np.ndarray) -> pa.Array:
    """For each of `rows` texts its kept words joined by one space."""
    ends = np.searchsorted(number[keep], np.arange(rows), "right")
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, ends), pa.int64()), found.filter(pa.array(keep)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def word_hashes(texts: list[str], separators: np.ndarray) -> list[np.ndarray]:
    """The word hashes of each text."""
    number, hashes = words(pa.array(texts, pa.string()), separators)
    return np.split(hashes, np.searchsorted(number, np.arange(1, len(texts)))) if texts else []


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.append(starts[1:], len(keys))


def released() -> None:
    """Gives the memory of a finished task back: workers outlive their task, and what they hold counts beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def row_filter(keep: Callable[[pa.RecordBatch], np.ndarray], make: Callable[[], object] | None = None) -> Callable[[F.Column], F.Column]:
    """A condition on a text column: only the texts go to Python, slice by slice, and one boolean per row returns.

    `keep` gets a slice with the column `text` and, where `make` is given, what it made once for the task."""
    @F.arrow_udf("boolean")
    def condition(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = () if make is None else (make(),)
        for column in columns:
            batch = pa.record_batch([column], names=["text"])
            yield pa.array(np.concatenate([np.zeros(0, bool), *(keep(part, *made) for part in slices(batch, "text"))]))
        released()

    return condition


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about `limit` bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop
