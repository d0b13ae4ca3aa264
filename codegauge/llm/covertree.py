"""Exact top-k by inner product: dual-tree search over cover trees of queries and candidates.

Vectors are laid out in blocks of nearby vectors. A block holds a cover tree in arrays: every level divides the scale by BASE, the centres of
a node's children are a net of its points at that scale (each point within the scale of its centre, centres further apart than
it), and every node keeps the measured covering radius of its points. A node whose net would be nearly all of its points is a leaf. A pair of nodes, one of queries (centre q, radius r) and
one of candidates (centre p, radius s), can reach at most q.p + r|p| + s|q| + rs; it is pruned when that is below the worst kth score
of the query group. The search goes down both trees, sorts the remaining leaf pairs by bound and scores them best first.

On Spark: pivots (a bounded sample, PIVOTS at most) only decide which vectors share a block, so any choice is exact. Blocks of at
most BLOCK vectors are packed per (pivot, salt) group; the number of salts grows with the rows, so a pivot with many vectors is many
groups. First every query block searches its home blocks, those of its own pivot; the worst kth score found there prunes
pairs of block summaries; the remaining pairs of blocks are joined and searched. Each pair returns at most k rows for a query.

Scores are exact: sums below 2**53 are computed in doubles, larger ones in Python integers, held within the long range before they are ranked.

Defined results: vectors that are null, or hold a null or non-finite component, and rows without id take no part; vectors of another
length than the query's are no candidates; rows that share an id are one vector (the smallest by component order); a query is
not its own candidate; ties go to the smaller id; fewer candidates than k give all; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codegauge.session import scratch_path

BLOCK = 4096
PIVOTS = 64
LEAF = 48
#: Each level of a tree divides the scale by this.
BASE = 1.3
#: A net with more than a part of CROWD of its points as centres is no use; its node is not split.
CROWD = 4
#: Node pairs, and candidates, that are worked off at once.
CHUNK = 4096
#: Block pairs that go to Python at once, while blocks are written and searched.
ROWS_PER_BATCH = 8
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


@dataclass
class Tree:
    """Points in tree order; node n covers points[start[n]:stop[n]] and has the children first[n]:last[n] (none for a leaf)."""

    points: np.ndarray
    ids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    last: np.ndarray


def build_tree(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Level by level: split each node into the cells of a net at the next scale, down to small or single-valued nodes."""
    order = np.arange(len(ids))
    centres, radii, starts, stops, firsts, lasts = [], [], [], [], [], []

    def add(where: np.ndarray, start: int, centre: int) -> float:
        gap = points[where] - points[centre]
        radius = math.sqrt(float((gap * gap).sum(axis=1).max(initial=0.0)))
        centres.append(centre)
        radii.append(math.nextafter(radius, math.inf) if radius else 0.0)
        starts.append(start)
        stops.append(start + len(where))
        firsts.append(0)
        lasts.append(0)
        return radius

    add(order, 0, 0)
    node = 0
    while node < len(centres):
        start, stop, scale = starts[node], stops[node], radii[node] / BASE
        if stop - start > leaf and radii[node] > 0:
            where, cells, centre = order[start:stop].copy(), [], centres[node]
            while len(where) and len(cells) <= (stop - start) // CROWD:
                gap = points[where] - points[centre]
                near = (gap * gap).sum(axis=1) <= scale * scale
                near |= where == centre
                cells.append((where[near], centre))
                where = where[~near]
                centre = where[0] if len(where) else -1
            if not len(where):  # else the net has nearly as many centres as points, and the node stays a leaf
                firsts[node], at = len(centres), start
                for own, centre in cells:
                    order[at:at + len(own)] = own
                    add(own, at, centre)
                    at += len(own)
                lasts[node] = len(centres)
        node += 1
    slot = np.empty(len(order), np.int64)
    slot[order] = np.arange(len(order))
    return Tree(points[order], ids[order], slot[np.array(centres)], np.array(radii), *(np.array(x, np.int64) for x in (starts, stops, firsts, lasts)))


def _bounds(q: Tree, c: Tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most that a query of node a and a candidate of node b can reach; rounding never prunes."""
    out = np.empty(len(a))
    for at in range(0, len(a), CHUNK):
        x, y = a[at:at + CHUNK], b[at:at + CHUNK]
        p, r = q.points[q.centre[x]], c.points[c.centre[y]]
        most = (p * r).sum(axis=1) + q.radius[x] * np.sqrt((r * r).sum(axis=1)) + c.radius[y] * np.sqrt((p * p).sum(axis=1)) \
            + q.radius[x] * c.radius[y]
        out[at:at + CHUNK] = np.maximum(most + np.abs(most) * 1e-9 + 1e-6, -float(_LONG))
    return out


def _products(p: np.ndarray, r: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return p @ r.T
    whole = [[int(x) for x in row] for row in r]
    held = lambda x: max(-_LONG - 1, min(_LONG, x))
    return np.array([[held(sum(int(x) * y for x, y in zip(row, other))) for other in whole] for row in p], dtype=object).reshape(len(p), len(r))


def _group_worst(tree: Tree, worst: np.ndarray) -> np.ndarray:
    """For every node the worst kth score among its queries."""
    return np.array([worst[a:b].min() for a, b in zip(tree.start, tree.stop)])


class Best:
    """The k best candidates of every query of a tree so far, in tree order."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.found = k, [[] for _ in range(n)]
        self.worst = np.full(n, -np.inf)

    def offer(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old = self.found[row]
        if len(scores) > self.k and scores.dtype != object:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[near], ids[near]
            first = np.lexsort((ids, -scores))[:self.k]
            scores, ids = scores[first], ids[first]
        pool = old + list(zip((-scores).tolist(), ids.tolist()))
        pool.sort()
        self.found[row] = pool[:self.k]
        if len(pool) >= self.k:
            self.worst[row] = -float(pool[self.k - 1][0])


def search(q: Tree, c: Tree, k: int, floor: np.ndarray, best: Best | None = None) -> Best:
    """The k best candidates in `c` of every query in `q`; `floor` is a kth score each query is known to reach."""
    best = best or Best(len(q.ids), k)
    biggest = [np.abs(t.points).max(initial=0.0) for t in (q, c)]
    exact = biggest[0] * biggest[1] * max(1, q.points.shape[1]) < _EXACT
    group = _group_worst(q, np.maximum(floor, best.worst))
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(a):
        bound = _bounds(q, c, a, b)
        keep = bound >= group[a]
        a, b, bound = a[keep], b[keep], bound[keep]
        qs, cs = q.last[a] - q.first[a], c.last[b] - c.first[b]
        end = (qs == 0) & (cs == 0)
        leaves.append((a[end], b[end], bound[end]))
        a, b, qs, cs = a[~end], b[~end], qs[~end], cs[~end]
        # split the side with the larger radius, or the one that can be split
        left = (qs > 0) & ((cs == 0) | (q.radius[a] >= c.radius[b]))
        n = np.where(left, qs, cs)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        side = np.repeat(left, n)
        a, b = np.repeat(a, n), np.repeat(b, n)
        a, b = np.where(side, q.first[a] + offset, a), np.where(side, b, c.first[b] + offset)
    a, b, bound = (np.concatenate(x) for x in zip(*leaves))
    by = np.lexsort((-bound, a))
    a, b, bound = a[by], b[by], bound[by]
    cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, cuts[1:]):
        s, t = q.start[a[lo]], q.stop[a[lo]]
        at = lo
        while True:
            live = at + int(np.searchsorted(-bound[at:hi], -np.maximum(floor[s:t], best.worst[s:t]).min(), "right"))
            if live == at:
                break
            sizes = np.cumsum(c.stop[b[at:live]] - c.start[b[at:live]])
            step = max(1, int(np.searchsorted(sizes, min(CHUNK, 4 * LEAF if at == lo else CHUNK), "right")))
            part = b[at:min(at + step, live)]
            rows = np.concatenate([np.arange(c.start[x], c.stop[x]) for x in part])
            scores = _products(q.points[s:t], c.points[rows], exact)
            ids = c.ids[rows]
            for row in range(s, t):
                least = max(floor[row], best.worst[row])
                ok = (scores[row - s] >= least) & (ids != q.ids[row])
                if ok.any():
                    best.offer(row, scores[row - s][ok], ids[ok])
            at += len(part)
    return best


# --- blocks on Spark -------------------------------------------------------------------------------------------------------------

_FIELDS = ["points", "ids", "centre", "radius", "start", "stop", "first", "last"]
_BLOCK_SCHEMA = "dim int, pivot int, block string, n int, mid array<double>, radius double, " + ", ".join(f"t_{f} binary" for f in _FIELDS)


def _pack(tree: Tree) -> list[bytes]:
    return [np.ascontiguousarray(getattr(tree, f)).tobytes() for f in _FIELDS]


def _unpack(dim: int, n: int, parts: list[bytes]) -> Tree:
    kinds = [np.float64, np.int64, np.int64, np.float64, np.int64, np.int64, np.int64, np.int64]
    arrays = [np.frombuffer(p, kind) for p, kind in zip(parts, kinds)]
    return Tree(arrays[0].reshape(n, dim), *arrays[1:])


def _blocks(key: tuple, rows: pd.DataFrame, size: int) -> pd.DataFrame:
    dim, pivot, salt = key
    rows = rows.assign(t=[tuple(v) for v in rows["v"]]).sort_values(["id", "t"]).drop_duplicates("id")
    out = []
    for start in range(0, len(rows), size):
        part = rows.iloc[start:start + size]
        tree = build_tree(part["id"].to_numpy(np.int64), np.array(part["t"].tolist(), np.float64).reshape(len(part), dim))
        out.append([dim, pivot, f"{dim}.{pivot}.{salt}.{start}", len(part), tree.points[tree.centre[0]].tolist(), float(tree.radius[0]), *_pack(tree)])
    return pd.DataFrame(out, columns=["dim", "pivot", "block", "n", "mid", "radius", *(f"t_{f}" for f in _FIELDS)])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component as doubles, for the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(usable)

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(v=[np.floor(x) for x in batch["v"]])

    return rows.mapInPandas(floors, rows.schema)


def _nearest(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """dim and number of the nearest pivot of every vector."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["v"].map(len).to_numpy()
            pivot = np.zeros(len(batch), np.int32)
            for dim in np.unique(dims):
                if dim in pivots:
                    where = np.flatnonzero(dims == dim)
                    points = np.array([batch["v"].iloc[k] for k in where]).reshape(len(where), dim)
                    p = pivots[dim]
                    pivot[where] = (np.square(p).sum(axis=1)[None, :] - 2 * points @ p.T).argmin(axis=1)
            yield batch.assign(dim=dims.astype(np.int32), pivot=pivot)

    return rows.mapInPandas(assign, "id long, v array<double>, dim int, pivot int")


def _search_pairs(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, ranked, scores = [], [], []
        for row in batch.itertuples(index=False):
            q = _unpack(row.dim, row.qn, [getattr(row, f"q_{f}") for f in _FIELDS])
            c = _unpack(row.dim, row.n, [getattr(row, f"t_{f}") for f in _FIELDS])
            floor = np.full(len(q.ids), -np.inf) if row.worst is None else np.frombuffer(row.worst, np.float64)
            best = search(q, c, k, floor)
            for query, found in zip(q.ids.tolist(), best.found):
                ids += [query] * len(found)
                ranked += [x for _, x in found]
                scores += [-int(s) for s, _ in found]
        yield pd.DataFrame({"query_id": ids, "vec_id": ranked, "score": scores}, dtype="int64")


@contextmanager
def _few_rows_per_batch(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, ROWS_PER_BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
          block: int = BLOCK, max_pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest integer inner product for every query."""
    spark = vectors.sparkSession

    def stored(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
        path = scratch_path(spark, name)
        with _few_rows_per_batch(spark) if large_rows else nullcontext():
            df.write.parquet(path)
        return spark.read.parquet(path)

    rows = quantised(vectors, id_col, vector_col, scale)
    total = rows.count()
    wanted = min(max_pivots, math.ceil(total / block))
    sample = [np.array(r.v) for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()] if wanted else []
    pivots = {d: np.unique([v for v in sample if len(v) == d], axis=0) for d in {len(v) for v in sample} if d}
    salts = max(1, math.ceil(total / (block * max_pivots)))
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        placed = _nearest(df, pivots).select("id", "v", "dim", "pivot", salt)
        return stored(placed.groupBy("dim", "pivot", "salt").applyInPandas(lambda key, x: _blocks(key, x, block), _BLOCK_SCHEMA), name)

    cand = blocks(rows, "candidates")
    asked = blocks(quantised(queries, id_col, vector_col, scale), "queries").select(
        "dim", "pivot", F.col("block").alias("qblock"), F.col("n").alias("qn"), F.col("mid").alias("qmid"), F.col("radius").alias("qradius"),
        *(F.col(f"t_{f}").alias(f"q_{f}") for f in _FIELDS))
    pair_cols = ["dim", "qblock", "qn", *(f"q_{f}" for f in _FIELDS), "block", "n", *(f"t_{f}" for f in _FIELDS), "worst"]
    result = "query_id long, vec_id long, score long"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best_of(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    home_pairs = asked.join(cand.drop("mid", "radius"), ["dim", "pivot"]).withColumn("worst", F.lit(None).cast("binary"))
    home = stored(home_pairs.select(*pair_cols).mapInPandas(lambda it: _search_pairs(it, k), result), "home", True)
    # the kth score that each query has reached, and the worst of them in each query block
    reached = best_of(home).groupBy("query_id").agg(F.max("rank").alias("m"), F.min("score").alias("s")).where(F.col("m") == k)
    members = asked.select("qblock", F.explode(_ids("q_ids")).alias("query_id"))
    floors = members.join(reached, "query_id", "left").groupBy("qblock").agg(
        F.sort_array(F.collect_list(F.struct("query_id", "s"))).alias("f"), F.min(F.coalesce(F.col("s").cast("double"), F.lit(float("-inf")))).alias("least"))
    aimed = stored(asked.join(floors, "qblock").withColumn("worst", _floor_bytes("q_ids", "f")).drop("f"), "aimed")
    gap = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y)
    dot = F.aggregate(F.zip_with("mid", "qmid", lambda x, y: x * y), F.lit(0.0), lambda s, y: s + y)
    most = dot + F.col("qradius") * F.sqrt(gap("mid")) + F.col("radius") * F.sqrt(gap("qmid")) + F.col("radius") * F.col("qradius")
    near = aimed.select("dim", F.col("pivot").alias("qpivot"), "qblock", "qmid", "qradius", "least") \
        .join(cand.select("dim", "pivot", "block", "mid", "radius"), "dim").where("pivot <> qpivot") \
        .where(F.greatest(most + F.abs(most) * 1e-9 + 1e-6, F.lit(-float(_LONG))) >= F.col("least")).select("qblock", "block")
    far_pairs = near.join(aimed.drop("pivot", "qmid", "qradius", "least"), "qblock").join(cand.drop("dim", "pivot", "mid", "radius"), "block")
    far = stored(far_pairs.select(*pair_cols).mapInPandas(lambda it: _search_pairs(it, k), result), "far", True)
    return best_of(home.union(far)).select("query_id", "rank", "vec_id", "score")


def _ids(column: str) -> F.Column:
    @F.pandas_udf("array<long>")
    def ids(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: np.frombuffer(x, np.int64))

    return ids(column)


def _floor_bytes(ids: str, found: str) -> F.Column:
    """The kth scores of a block's queries in the order of its tree."""
    @F.pandas_udf("binary")
    def floors(raw: pd.Series, pairs: pd.Series) -> pd.Series:
        out = []
        for x, rows in zip(raw, pairs):
            known = {r["query_id"]: -np.inf if r["s"] is None else float(r["s"]) for r in rows}
            out.append(np.array([known[i] for i in np.frombuffer(x, np.int64).tolist()], np.float64).tobytes())
        return pd.Series(out)

    return floors(ids, found)
