"""Sparse term vectors as few categorical columns, so that trees can split on every term at a bounded cost.

1. Terms whose weights rank the training rows alike (same rows, same counts) are one column: a tree cannot tell them apart.
2. A term's weights become up to LEVELS levels between quantiles of its own weights.
3. Terms that share no training row are bundled: a bundle is one categorical column whose categories are the levels of its
   terms, and category 0 where it has none. A split of categories can part any level of any term from the rest.

The vectors are read once and kept as blocks of a few thousand rows in flat arrays. Steps 1 and 2: every block orders its weights by
term, groups of terms are dealt to tasks, and a task sorts the weights of its terms. Step 3 needs the pairs of terms that meet in a
row: every task keeps them as one bit matrix of terms by terms, and the matrices are united in pieces, so what is
shuffled and held for it is bounded by the vocabulary (at most 12,000 terms: 18 MB as bits), whatever the number of rows.

Weights are compared as 32-bit floats, cut off and not rounded: a limit lies just below the next such number.

Defined results: a row with several terms of a bundle (possible in unseen texts only) has the category of the one latest in the
vocabulary, which is the rarest; a term without a training row is in no bundle; weights beyond the training range have the outer levels.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from codegauge.operators import textvec
from codegauge.operators.batches import stretches

LEVELS = 4
#: Categories of a bundle at most, the empty one included; also the bins of the trees.
SLOTS = 32
#: Rows and cells of a block, cells that a task sorts by term, bytes of a block's rows by terms: at most.
PACKED_ROWS, PACKED_CELLS, GROUP_CELLS, MEETING_BYTES = 1 << 13, 1 << 21, 1 << 22, 1 << 24


class TermBundler(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Sparse vectors to vectors of bundle categories; the categories are marked in the column's metadata."""

    bundle = Param(Params._dummy(), "bundle", "bundle of each term, -1 for none", typeConverter=TypeConverters.toListInt)
    first = Param(Params._dummy(), "first", "category of each term's lowest level", typeConverter=TypeConverters.toListInt)
    limits = Param(Params._dummy(), "limits", "limits between levels, term after term", typeConverter=TypeConverters.toListFloat)
    starts = Param(Params._dummy(), "starts", "where each term's limits start, and the end", typeConverter=TypeConverters.toListInt)
    sizes = Param(Params._dummy(), "sizes", "categories of each bundle", typeConverter=TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, bundle=None, first=None, limits=None, starts=None, sizes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def categoriser(self) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A function from (row, term, weight) of cells, terms ascending in a row, to (row, bundle, category)."""
        bundle, first, starts = (np.asarray(self.getOrDefault(p), np.int64) for p in (self.bundle, self.first, self.starts))
        limits, n = np.asarray(self.getOrDefault(self.limits)), len(self.getOrDefault(self.sizes))
        longest = int(np.diff(starts).max(initial=0))
        table = np.full((len(bundle), longest), np.inf)
        for term, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            table[term, :b - a] = limits[a:b]

        def categories(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            known = bundle[term] >= 0
            row, term, weight = row[known], term[known], weight[known]
            column = row * max(n, 1) + bundle[term]
            order = np.argsort(column, kind="stable")  # the last of a bundle is its latest
            last = order[np.flatnonzero(np.diff(column[order], append=-1))]
            row, term, weight = row[last], term[last], weight[last]
            level = first[term]
            for k in range(longest):
                level = level + (weight > table[term, k])
            return row, bundle[term], level

        return categories

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sizes, of_cells = self.getOrDefault(self.sizes), self.categoriser()

        def categories(vectors: pa.Array) -> pa.Array:
            out = []
            for part in textvec.by_cells(vectors):
                row, bundle, category = of_cells(*textvec.cells_of(part))
                out.append(textvec.sparse_vectors(
                    len(sizes), textvec.lists(row, len(part), pa.array(bundle, pa.int32())),
                    textvec.lists(row, len(part), pa.array(category.astype(float)))))
            return pa.concat_arrays(out)

        marked = {"ml_attr": {"num_attrs": len(sizes), "attrs": {"nominal": [
            {"idx": i, "num_vals": size} for i, size in enumerate(sizes)]}}}
        return dataset.withColumn(self.getOutputCol(), F.arrow_udf(categories, VectorUDT())(F.col(self.getInputCol()))).withMetadata(self.getOutputCol(), marked)


@dataclass(frozen=True)
class Packed:
    """Training rows in flat arrays: a label and a key per row, where its cells end, and term, count and weight (see `_keys`) per cell."""

    label: np.ndarray
    key: np.ndarray
    ends: np.ndarray
    term: np.ndarray
    n: np.ndarray
    weight: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))


#: Least exponent of a weight that is told from zero.
_LEAST = 1023 - 255


def _keys(weight: np.ndarray) -> np.ndarray:
    """Weights from 0 to below 2 as 31-bit numbers of the same order: the first 24 bits of each and its exponent."""
    return np.maximum((np.ascontiguousarray(weight, np.float64).view(np.int64) >> 29) - (_LEAST << 23), 0).astype(np.int32)


def weights(keys: np.ndarray) -> np.ndarray:
    """The least weight of each key."""
    return ((keys.astype(np.int64) + (_LEAST << 23)) << 29).view(np.float64)


def _smallest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def pack(rows: DataFrame) -> RDD:
    """`Packed` blocks of rows of `key`, `counts`, `wide` and, where there is one, `label` (0 or 1)."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, key, terms, n, weight = batch.columns
            sizes = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if label.null_count or not np.isin(label, (0, 1)).all():
                raise ValueError("labels must be 0 or 1")
            for a, b in ((i, min(i + PACKED_ROWS, b)) for a, b in stretches(sizes, PACKED_CELLS) for i in range(a, b, PACKED_ROWS)):
                flat = [x[a:b].flatten().to_numpy(zero_copy_only=False) for x in (terms, n, weight)]
                block = Packed(label[a:b].to_numpy(zero_copy_only=False).astype(np.int8), key[a:b].to_numpy(zero_copy_only=False),
                               np.cumsum(sizes[a:b], dtype=np.int64), _smallest(flat[0]), _smallest(flat[1].astype(np.int64)), _keys(flat[2]))
                yield pa.record_batch([pa.array([pickle.dumps(block, pickle.HIGHEST_PROTOCOL)], pa.binary())], names=["block"])

    label = F.col("label").cast("double") if "label" in rows.columns else F.lit(0.0)
    flat = rows.select(label.alias("label"), "key", F.unwrap_udt("counts").alias("c"), F.unwrap_udt("wide").alias("v")).select(
        "label", "key", "v.indices", F.col("c.values").alias("n"), F.col("v.values").alias("w"))
    return flat.mapInArrow(blocks, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _term_facts(blocks: RDD, cells: int, levels: int) -> list[tuple[int, int, int, int, list[float], list[int]]]:
    """(term, n, odd, sign, cuts, sizes): rows of the term, a signature of where and how often it stands, limits at the quantiles of
    its weights, and how many rows each level has. Terms are dealt to tasks by their number, so frequent ones lie apart."""
    groups = max(blocks.ctx.defaultParallelism, -(-cells // GROUP_CELLS))

    def by_group(packed: Iterator[Packed]) -> Iterator[tuple]:
        for block in packed:
            if not len(block.term):
                continue
            term = block.term.astype(np.int64)
            each = int(term.max()) // groups + 1
            rank = term % groups * each + term // groups
            order = np.argsort(rank.astype(np.uint16 if groups * each <= 1 << 16 else np.int64), kind="stable")
            term, weight = term[order], block.weight[order]
            n = block.n[order].astype(np.uint64)
            sign = _mixed(_mixed(block.key.view(np.uint64)[block.row[order]] + np.uint64(0x9E3779B97F4A7C15) * n) + n)
            first = np.flatnonzero(np.diff(term, prepend=-1))
            facts = (term[first], np.diff(first, append=len(term)), np.bitwise_xor.reduceat(sign, first), np.add.reduceat(_mixed(sign + np.uint64(1)), first))
            group = facts[0] % groups
            cut = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
            for a, b in zip(cut, [*cut[1:], len(group)]):
                lo, hi = first[a], first[b] if b < len(first) else len(term)
                yield int(group[a]), (*(x[a:b] for x in facts), weight[lo:hi])

    def of_group(found: Iterator[tuple]) -> Iterator[tuple]:
        parts = [part for _, part in found]
        if not parts:
            return
        term, n, odd, sign = (np.concatenate([p[k] for p in parts]) for k in range(4))
        own, place = np.unique(term, return_inverse=True)
        cells = np.concatenate([p[4] for p in parts]).astype(np.int64) | np.repeat(place, n).astype(np.int64) << 32
        cells.sort()
        order = np.argsort(place, kind="stable")
        first = np.searchsorted(place[order], np.arange(len(own)))
        total, odd, sign = np.add.reduceat(n[order], first), np.bitwise_xor.reduceat(odd[order], first), np.add.reduceat(sign[order], first)
        ends = np.cumsum(total)
        for k, (a, b) in enumerate(zip((ends - total).tolist(), ends.tolist())):
            keys = cells[a:b] & 0xFFFFFFFF
            at = [-(-(b - a) * j // levels) - 1 for j in range(1, levels)]
            cuts = np.unique(keys[at]) if at else keys[:0]
            sizes = np.diff(np.searchsorted(keys, cuts, "right"), prepend=0, append=b - a)
            yield int(own[k]), b - a, int(odd[k]), int(sign[k]), np.nextafter(weights(cuts + 1), 0).tolist(), sizes.tolist()

    dealt = blocks.mapPartitions(by_group).partitionBy(groups, int)
    return sorted(dealt.mapPartitions(of_group).collect())


def _meetings(blocks: RDD, terms: np.ndarray, size: int) -> np.ndarray:
    """Bit matrix (packed) of which of the given terms share a row."""
    if not len(terms):
        return np.zeros((0, 0), np.uint8)
    place = np.full(size, -1, np.int64)
    place[terms] = np.arange(len(terms))
    words = -(-len(terms) // 64)
    step = max(64, MEETING_BYTES // max(len(terms), 1))

    def of_task(packed: Iterator[Packed]) -> Iterator[tuple[int, np.ndarray]]:
        met = np.zeros((len(terms), words * 8), np.uint8)
        for block in packed:
            own = place[block.term]
            known = own >= 0
            own, row = own[known], block.row[known]
            for a in range(0, len(block.ends), step):
                lo, hi = np.searchsorted(row, (a, a + step)).tolist()
                r, t = row[lo:hi] - a, own[lo:hi]
                has = np.zeros((min(step, len(block.ends) - a), words * 64), bool)
                has[r, t] = True
                bits = np.packbits(has, axis=1).view(np.uint64)
                order = np.argsort(t, kind="stable")
                t, r = t[order], r[order]
                first = np.flatnonzero(np.diff(t, prepend=-1))
                wide = met.view(np.uint64)
                for x, i, j in zip(t[first].tolist(), first.tolist(), [*first[1:].tolist(), len(t)]):
                    wide[x] |= np.bitwise_or.reduce(bits[r[i:j]], axis=0)
        for a in range(0, len(terms), 1000):
            yield a, met[a:a + 1000]

    out = np.zeros((len(terms), words * 8), np.uint8)
    united = blocks.mapPartitions(of_task).reduceByKey(np.bitwise_or, max(1, -(-len(terms) // 1000)))
    for a, bits in united.toLocalIterator():
        out[a:a + len(bits)] = bits
    return out[:, :(len(terms) + 7) // 8]


def _colour(met: np.ndarray, levels: list[int], slots: int) -> tuple[list[int], list[int], list[int]]:
    """(bundle, first category) of each term and the categories of each bundle: first fit, most meetings first."""
    n = len(levels)
    order = np.argsort(-np.bitwise_count(met).sum(axis=1, dtype=np.int64), kind="stable")
    blocked, used = np.zeros((0, met.shape[1]), np.uint8), np.zeros(0, np.int64)
    bundle, first = [0] * n, [0] * n
    spare = 0
    for j in order.tolist():
        free = np.flatnonzero((blocked[:spare, j >> 3] >> (7 - (j & 7)) & 1 == 0) & (used[:spare] + levels[j] <= slots))
        if len(free):
            b = int(free[0])
        else:
            b, spare = spare, spare + 1
            if spare > len(used):  # room grows by doubling
                more = max(64, len(used))
                blocked, used = np.vstack([blocked, np.zeros((more, met.shape[1]), np.uint8)]), np.concatenate([used, np.ones(more, np.int64)])
        bundle[j], first[j] = b, int(used[b])
        used[b] += levels[j]
        blocked[b] |= met[j]
    return bundle, first, used[:spare].tolist()


def fit_bundles(rows: DataFrame, size: int, output: str = "features", levels: int = LEVELS, slots: int = SLOTS) -> TermBundler:
    """A bundler of the column `wide` (vectors of `size` terms), from rows of `key`, `counts` and `wide`."""
    blocks = pack(rows).persist(StorageLevel.DISK_ONLY)
    try:
        return fit_packed(blocks, size, output, levels, slots)[0]
    finally:
        blocks.unpersist()


def fit_packed(blocks: RDD, size: int, output: str = "features", levels: int = LEVELS, slots: int = SLOTS) -> tuple[TermBundler, list[int], int]:
    """A bundler from `Packed` blocks, the category that most rows have of each bundle, and the number of cells."""
    n, cells = (sum(x) for x in zip((0, 0), *blocks.map(lambda b: (len(b.ends), len(b.term))).collect()))
    found = _term_facts(blocks, cells, levels)
    leader: dict[tuple, int] = {}
    for term, *signature, _, _ in found:
        leader.setdefault(tuple(signature), term)
    own = set(leader.values())
    kept = [r for r in found if r[0] in own]
    cuts = [r[4] for r in kept]
    terms = np.array([r[0] for r in kept], np.int64)
    bundle_of, first_of, sizes = _colour(_meetings(blocks, terms, size), [len(c) + 1 for c in cuts], slots)
    bundle, first, limits, starts = [-1] * size, [0] * size, [], [0]
    where = {int(t): k for k, t in enumerate(terms)}
    for term in range(size):
        k = where.get(term)
        if k is not None:
            bundle[term], first[term] = bundle_of[k], first_of[k]
            limits += cuts[k]
        starts.append(len(limits))
    rows = [np.zeros(s, np.int64) for s in sizes]
    for b, f, r in zip(bundle_of, first_of, kept):
        rows[b][f:f + len(r[5])] = r[5]
    for r in rows:
        r[0] = n - r.sum()
    bundler = TermBundler(inputCol="wide", outputCol=output, bundle=bundle, first=first, limits=limits, starts=starts, sizes=sizes)
    return bundler, [int(r.argmax()) for r in rows], cells
