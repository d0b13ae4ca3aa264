import math
import random

import numpy as np

from codegauge.llm import covertree as c

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = tuple(math.floor(64 * x) for x in v)
            usable[i] = min(usable.get(i, q), q)
    out = []
    for q, v in usable.items():
        if q % 20 == 0:
            found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in usable.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def result(spark, rows, k, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    found = c.top_k(df, df.where("vec_id % 20 = 0"), k=k, **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)


def test_equals_brute_force_with_ties_copies_and_odd_rows(spark):
    rnd = random.Random(3)
    centres = [[rnd.uniform(-2, 2) for _ in range(4)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + rnd.gauss(0, 0.1))) for x in rnd.choice(centres)]) for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(400, 560)]
    rows += [(560, None), (580, [0.1, None, 0.2, 0.3]), (600, [float("nan"), 0.0, 0.0, 0.0]), (620, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(640, [1.0, 2.0]), (641, [3.0, 1.0]), (660, []), (661, []), (680, [2.0] * 3)]
    rows += [(20, rows[20][1]), (40, [0.0, 0.0, 0.0, 0.0]), (401, [0.5, 0.5, 0.5, 0.5])]
    assert result(spark, rows, 7, block=64, max_pivots=4) == brute(rows, 7)


def test_large_components_and_empty_tables(spark):
    rows = [(i, [float(np.float32(3e9 * (i - 3))), float(np.float32(1e9 * i))]) for i in range(0, 60, 5)]
    assert result(spark, rows, 5) == brute(rows, 5)
    assert result(spark, [], 5) == []


def test_tree_covers_its_points_and_prunes():
    rng = np.random.default_rng(1)
    points = np.floor(64 * (rng.normal(size=(6, 3))[rng.integers(0, 6, 2000)] * 9 + rng.normal(size=(2000, 3)) * 0.05))
    tree = c.build_tree(np.arange(2000), points)
    assert len(tree.centre) > 20 and sorted(tree.ids.tolist()) == list(range(2000))
    for n in range(len(tree.centre)):
        gap = tree.points[tree.start[n]:tree.stop[n]] - tree.points[tree.centre[n]]
        assert np.sqrt((gap * gap).sum(axis=1)).max() <= tree.radius[n]
        if tree.last[n]:
            parts = [(tree.start[x], tree.stop[x]) for x in range(tree.first[n], tree.last[n])]
            assert parts[0][0] == tree.start[n] and parts[-1][1] == tree.stop[n] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    scored = []
    plain = c._products
    c._products = lambda p, r, exact: scored.append(p.shape[0] * r.shape[0]) or plain(p, r, exact)
    try:
        query = c.build_tree(np.arange(100) * 20, points[:100])
        best = c.search(query, tree, 5, np.full(100, -np.inf))
    finally:
        c._products = plain
    assert sum(scored) < 100 * 2000 * 0.6
    for i, found in zip(query.ids, best.found):
        scores = points[i // 20] @ points.T
        assert found == sorted((-s, j) for j, s in enumerate(scores.tolist()) if j != i)[:5]
