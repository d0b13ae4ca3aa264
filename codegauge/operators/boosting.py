"""Boosted trees over sparse categories: the trees of `GBTClassifier`, at a cost that follows the cells that stand in the rows.

Spark's own trees add every feature of every row to the statistics of its node on every level. Here a row holds only the bundles in
which it differs from the most frequent category, and of two sibling nodes only the smaller one is summed:

* A block has a few thousand training rows. For every cell (category of a bundle) it lists the rows that have it; the most
  frequent category of a bundle has no list, its sums are what is missing to the node's.
* A level of a tree is one pass over the blocks. A task adds up sums and counts by node and cell, one result a task; the other
  sibling is its parent less the smaller one.
* Scores are kept apart from the blocks and renewed tree by tree. Every RENEWED trees they are worked out from the blocks and all trees, so
  their lineage stays short and no checkpoint is needed.

Trees, splits and leaves are defined as Spark's: variance of the residuals of the log loss, categories in order of their mean,
the first of equally good bundles. Sums differ in rounding only (residuals are added in steps of 2 ** -32), and gains within TIE of
each other count as equal.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import SparkSession
from pyspark.storagelevel import StorageLevel

#: Trees after which scores start afresh; bytes of partial sums that the driver takes at once.
RENEWED, DRIVER_BYTES = 30, 1 << 26
#: Residuals (at most 4) in a block's sums: steps of 2 ** -32, and ones above a sum of 2 ** 14 rows.
SCALE, ONE, MOST_ROWS = 2.0 ** 32, 1 << 49, 1 << 14
#: Relative differences that are rounding; variance of a node that is not split, as Spark has it.
TIE, PURE = 1e-12, 2.0 ** -52


@dataclass(frozen=True)
class Shape:
    """Cells of all bundles: the categories of bundle b are the cells from offsets[b] to offsets[b + 1]."""

    sizes: np.ndarray
    default: np.ndarray

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])


@dataclass
class Tree:
    """Nodes by heap number (root 1, children 2v and 2v + 1): split bundles with the categories that go right, and statistics."""

    splits: dict[int, tuple[int, np.ndarray]] = field(default_factory=dict)
    stats: dict[int, list[float]] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)

    def values(self, depth: int) -> np.ndarray:
        out = np.zeros(2 << depth)
        for v, (n, s, _) in self.stats.items():
            out[v] = s / n
        return out


Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # labels (-1, 1), rows by cell, where each cell's rows start


def make_block(label: np.ndarray, row: np.ndarray, bundle: np.ndarray, category: np.ndarray, shape: Shape) -> Block:
    """A block from the bundles in which rows differ from category 0."""
    n, offsets = len(label), shape.offsets
    if n > MOST_ROWS:
        raise ValueError(f"{n} rows in a block")
    odd = np.flatnonzero(shape.default)  # bundles whose rows without a term are the listed ones
    if len(odd):
        place = np.full(len(shape.sizes), -1)
        place[odd] = np.arange(len(odd))
        empty = np.ones((n, len(odd)), bool)
        own = place[bundle] >= 0
        empty[row[own], place[bundle[own]]] = False
        r, b = np.nonzero(empty)
        keep = category != shape.default[bundle]
        row = np.concatenate([row[keep], r])
        cell = np.concatenate([(offsets[bundle] + category)[keep], offsets[odd[b]]])
    else:
        cell = offsets[bundle] + category
    small = np.uint16 if offsets[-1] <= 1 << 16 else np.int64
    order = np.argsort(cell.astype(small), kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=int(offsets[-1])))]).astype(np.int32)
    return (2 * label - 1).astype(np.int8), row[order].astype(np.uint16), starts


def _place(block: Block, splits: dict[int, tuple[int, np.ndarray]], shape: Shape) -> np.ndarray:
    """Heap number of the node where each row stands."""
    label, rows, starts = block
    at, offsets = np.ones(len(label), np.int64), shape.offsets
    for v in sorted(splits):
        bundle, right = splits[v]
        a, b = offsets[bundle], offsets[bundle + 1]
        side = np.full(len(label), right[shape.default[bundle]])
        side[rows[starts[a]:starts[b]]] = np.repeat(right, np.diff(starts[a:b + 1]))
        here = at == v
        at[here] = 2 * v + side[here]
    return at


def _residuals(label: np.ndarray, score: np.ndarray, first: bool) -> np.ndarray:
    """What the next tree is fitted to, in whole steps."""
    y = label.astype(float)
    if first:
        return y
    with np.errstate(over="ignore"):
        return np.rint(4.0 * SCALE * y / (1.0 + np.exp(2.0 * y * score))) / SCALE


def _single(rdd: RDD) -> RDD:
    """Blocks one by one, so that two such RDDs are zipped without being regrouped."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _added(parts: RDD, size: int) -> list[np.ndarray]:
    """Sums of the arrays that every task gives once: by the driver if they are few, else in tasks first."""
    add = lambda a, b: [x + y for x, y in zip(a, b)]
    if parts.getNumPartitions() * size > DRIVER_BYTES:
        return parts.treeReduce(add)
    found = parts.collect()
    total = [x.copy() for x in found[0]]
    for more in found[1:]:
        for x, y in zip(total, more):
            x += y
    return total


def _gathered(values: np.ndarray, rows: np.ndarray, some: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows' values by cell, for the cells that have rows."""
    return np.add.reduceat(values.take(rows, mode="clip"), starts[some])


def _fixed(r: np.ndarray) -> np.ndarray:
    """Residuals as whole numbers of steps with a one for each row above them, so that one sum gives sum and count."""
    return (r * SCALE).astype(np.int64) + ONE


def _split_up(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, count) of sums of `_fixed`."""
    count = (sums + ONE // 2) // ONE
    return (sums - count * ONE) / SCALE, count


def _settle() -> None:
    """In a worker: it collects garbage after every task, and need not go through its imported modules each time."""
    if not gc.get_freeze_count():
        gc.freeze()


def _level_sums(shape: Shape, first: bool, splits: dict, small: list[int], width: int):
    """Sums and counts by node and cell for the nodes `small`; number, sum and squares of all nodes by heap number."""
    def sums(pairs: Iterator) -> Iterator:
        _settle()
        size = len(small), int(shape.offsets[-1])
        total, count, nodes = np.zeros(size), np.zeros(size, np.int64), np.zeros((3, width))
        for block, (score, _) in pairs:
            label, rows, starts = block
            r, at = _residuals(label, score, first), _place(block, splits, shape)
            nodes += [np.bincount(at, w, width) for w in (None, r, r * r)]
            some, fixed = np.flatnonzero(np.diff(starts)), _fixed(r)
            for k, v in enumerate(small):
                here = at == v
                if len(some) and here.any():
                    s, n = _split_up(_gathered(np.where(here, fixed, 0), rows, some, starts))
                    total[k, some] += s
                    count[k, some] += n
        yield [total, count, nodes]

    return sums


def _scored(shape: Shape, trees: list[Tree], weights: list[float], depth: int, start: int):
    """Scores after the trees from number `start` on, from blocks with the scores before or None.

    The last block of a task also has, summed over the task, what the next tree starts from: sums of the residuals by cell; number,
    sum and squares of the rows; and the squares of the residuals that the last tree was fitted to, by its leaves."""
    splits, values = [t.splits for t in trees], [w * t.values(depth) for w, t in zip(weights, trees)]

    def scored(pairs: Iterator) -> Iterator:
        _settle()
        cells, node, leaves, out = np.zeros(int(shape.offsets[-1])), np.zeros(3), np.zeros(2 << depth), []
        for block, state in pairs:
            label, rows, starts = block
            score = np.zeros(len(label)) if state is None else state[0]
            for k, (s, value) in enumerate(zip(splits, values)):
                at = _place(block, s, shape)
                if k == len(splits) - 1:
                    r = _residuals(label, score, start + k == 0)
                    leaves += np.bincount(at, r * r, 2 << depth)
                score = score + value[at]
            r = _residuals(label, score, start + len(splits) == 0)
            some = np.flatnonzero(np.diff(starts))
            if len(some):
                cells[some] += _split_up(_gathered(_fixed(r), rows, some, starts))[0]
            node += len(r), r.sum(), (r * r).sum()
            out.append((score, None))
        if out:
            out[-1] = out[-1][0], [cells, node, leaves]
        return iter(out)

    return scored


def _last(states: Iterator) -> Iterator:
    return (sums for _, sums in states if sums is not None)


class _Search:
    """The best split of a node from sums and counts of its cells."""

    def __init__(self, shape: Shape) -> None:
        self.shape, longest = shape, int(shape.sizes.max(initial=1))
        offsets = shape.offsets
        self.real = np.arange(longest) < shape.sizes[:, None]
        self.cell = np.where(self.real, offsets[:-1, None] + np.arange(longest), 0)
        self.missing = offsets[:-1] + shape.default

    def filled(self, cells: np.ndarray, total: float) -> np.ndarray:
        """With the sums of the most frequent categories."""
        out = cells.copy()
        if len(self.missing):
            out[self.missing] = total - np.add.reduceat(cells, self.shape.offsets[:-1])
        return out

    def best(self, sums: np.ndarray, counts: np.ndarray, n: float, s: float, q: float):
        """(gain, bundle, categories that go right, rows and sum on the left) or None."""
        if not len(self.shape.sizes) or n < 2:
            return None
        count = np.where(self.real, counts[self.cell], 0).astype(float)
        total = np.where(count > 0, sums[self.cell], 0.0)
        mean = np.where(count > 0, total / np.maximum(count, 1), np.inf)
        order = np.argsort(mean, axis=1, kind="stable")
        left, of_left = (np.cumsum(np.take_along_axis(x, order, 1), 1)[:, :-1] for x in (count, total))
        right = n - left
        valid = (left > 0) & (right > 0)
        gain = np.where(valid, (of_left ** 2 / np.maximum(left, 1) + (s - of_left) ** 2 / np.maximum(right, 1) - s * s / n) / n, -1.0)
        if not gain.size or gain.max() <= TIE * q / n:
            return None
        bundle, k = (int(x[0]) for x in np.nonzero(gain >= gain.max() * (1 - TIE)))
        goes = np.ones(int(self.shape.sizes[bundle]), bool)
        goes[order[bundle, :k + 1]] = False
        return float(gain[bundle, k]), bundle, goes, float(left[bundle, k]), float(of_left[bundle, k])


def _grow(blocks: RDD, state: RDD, shape: Shape, counts: np.ndarray, first: bool, depth: int) -> tuple[Tree, np.ndarray]:
    """One tree, with the squares of the tree before by leaf."""
    pairs = blocks.zip(state)
    search, tree = _Search(shape), Tree()
    cells = int(shape.offsets[-1])
    sums, (n, s, q), before = _added(state.mapPartitions(_last), 8 * cells)
    tree.stats[1] = [n, s, q]
    known, smaller = {1: (search.filled(sums, s), counts)}, {}
    for level in range(depth):
        if level:
            small = sorted(smaller.values())
            total, count, nodes = _added(pairs.mapPartitions(_level_sums(shape, first, tree.splits, small, 2 << level)), 16 * cells * len(small))
            above, known = known, {}
            for k, v in enumerate(small):
                n, s, _ = nodes[:, v]
                known[v] = search.filled(total[k], s), search.filled(count[k], int(n))
                known[v ^ 1] = tuple(a - b for a, b in zip(above[v >> 1], known[v]))
            for v in known:
                tree.stats[v] = nodes[:, v].tolist()
        smaller = {}
        for v in sorted(known):
            n, s, q = tree.stats[v]
            pure = level and q / n - (s / n) ** 2 < max(PURE, TIE * q / n)
            found = None if pure else search.best(*known[v], n, s, q)
            if found:
                tree.gains[v], bundle, goes, left, of_left = found
                tree.splits[v] = bundle, goes
                tree.stats[2 * v], tree.stats[2 * v + 1] = [left, of_left, 0.0], [n - left, s - of_left, 0.0]
                smaller[v] = 2 * v + (left > n - left)
        if not smaller:
            break
    return tree, before


def grow_trees(blocks: RDD, shape: Shape, trees: int, depth: int, rate: float) -> list[Tree]:
    """The trees of gradient boosting with the log loss; the first counts in full, the others by the rate."""
    blocks = _single(blocks).persist(StorageLevel.DISK_ONLY)
    state = kept = None
    try:
        facts = blocks.map(lambda b: (np.diff(b[2]).astype(np.int64), len(b[0])))
        found = _added(facts.mapPartitions(_counts(int(shape.offsets[-1]))), 8 * int(shape.offsets[-1]))
        n = int(found[1][0])
        if not n:
            raise ValueError("there are no training rows")
        counts = _Search(shape).filled(found[0], n)
        out: list[Tree] = []
        while True:
            whole = len(out) % RENEWED == 0 and len(out) < trees  # also the first time, when there are none
            done = out if whole else out[-1:]
            weights = [1.0 if tree is out[0] else rate for tree in done]
            pairs = blocks.map(lambda b: (b, None)) if whole else blocks.zip(state)
            kept, state = state, _single(pairs.mapPartitions(_scored(shape, list(done), weights, depth, len(out) - len(done)))).persist(
                StorageLevel.MEMORY_AND_DISK)
            if len(out) == trees:
                _complete(out[-1:], _added(state.mapPartitions(_last), 0)[2])
                return out
            tree, squares = _grow(blocks, state, shape, counts, not out, depth)
            if kept is not None:
                kept.unpersist()
            _complete(out[-1:], squares)
            out.append(tree)
    finally:
        for rdd in (kept, state, blocks):
            if rdd is not None:
                rdd.unpersist()


def _counts(cells: int):
    def counts(facts: Iterator) -> Iterator:
        total, rows = np.zeros(cells, np.int64), np.zeros(1, np.int64)
        for own, n in facts:
            total += own
            rows += n
        yield [total, rows]

    return counts


def _complete(last: list[Tree], squares: np.ndarray) -> None:
    """Leaves get their sums of squares with the pass that renews the scores."""
    for tree in last:
        for v, own in tree.stats.items():
            if v not in tree.splits:
                own[2] = float(squares[v])


def to_model(spark: SparkSession, trees: list[Tree], shape: Shape, **params) -> GBTClassificationModel:
    """The trees as Spark's own model, with the parameters of a `GBTClassifier`."""
    sc = spark.sparkContext
    jvm, ml = sc._jvm, sc._jvm.org.apache.spark.ml
    # classes are looked up once, and all numbers travel at once: every access is a call to the JVM
    internal, leaf, categorical = ml.tree.InternalNode, ml.tree.LeafNode, ml.tree.CategoricalSplit
    regression, boosted = ml.regression.DecisionTreeRegressionModel, ml.classification.GBTClassificationModel
    variance, part = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, jvm.java.util.Arrays.copyOfRange
    lefts = {(i, v): np.flatnonzero(~goes) for i, tree in enumerate(trees) for v, (_, goes) in tree.splits.items()}
    stats = {(i, v): x for i, tree in enumerate(trees) for v, x in tree.stats.items()}
    flat = [1.0] + [float(params["stepSize"])] * (len(trees) - 1)
    where = {}
    for kind, found in (("left", lefts), ("stats", stats)):
        for at, values in found.items():
            where[kind, at] = len(flat), len(flat) + len(values)
            flat.extend(map(float, values))
    numbers = _py2java(sc, DenseVector(flat)).toArray()

    def node(i: int, v: int):
        """(node, its value if it is a leaf); leaves of one value under one parent are one leaf, as Spark has it."""
        tree = trees[i]
        n, s, q = tree.stats[v]
        calculator = variance(part(numbers, *where["stats", (i, v)]), int(n))
        value, spread = float(s / n), float(q / n - (s / n) ** 2)
        if v in tree.splits:
            (left, a), (right, b) = node(i, 2 * v), node(i, 2 * v + 1)
            if a is None or a != b:
                bundle, goes = tree.splits[v]
                split = categorical(bundle, part(numbers, *where["left", (i, v)]), len(goes))
                return internal(value, spread, float(tree.gains[v]), left, right, split, calculator), None
        return leaf(value, spread, calculator), value

    size = len(shape.sizes)
    grown = sc._gateway.new_array(regression, len(trees))
    for i in range(len(trees)):
        grown[i] = regression(f"dtr_{uuid.uuid4().hex[-12:]}", node(i, 1)[0], size)
    estimator = GBTClassifier(**params)
    return estimator._copyValues(GBTClassificationModel(boosted(estimator.uid, grown, part(numbers, 0, len(trees)), size, 2)))
