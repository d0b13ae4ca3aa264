import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codegauge.operators import corrections as C, nearest
from helpers import similarity, texts

SCHEMA = "row_no bigint, code string, bug_type string, has_bug int, corrected_code string, description string"


def brute(code, bug_type, rows):
    """(exact, similar) by trying every row."""
    code = code.strip()
    exact = None
    for r in rows:
        if r[3] and r[4].strip() and r[1].strip() == code:
            exact = r[4]
    same = [r for r in rows if r[3] and r[4].strip() and r[2] == bug_type]
    similar = max(same, key=lambda r: similarity(code, r[1]))[4] if bug_type and same else None
    return exact, similar


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(5)
    pool = texts(80, 21) + ["", "  ", "same start of a long text " * 4 + "a", "same start of a long text " * 4 + "b"]
    # one type holds most rows; equal codes carry different corrections
    rows = [(i, rnd.choice(pool), rnd.choice(["hot"] * 5 + ["cold", "rare", ""]), rnd.randint(0, 3) and 1,
             rnd.choice(["", " "] + [f"fix {i}"] * 5), "d") for i in range(300)]
    snips = [(i, f" {code}\n" if i % 3 else code, kind) for i, (code, kind) in enumerate(
        (code, kind) for code in pool + texts(60, 22) for kind in ("hot", "cold", "unknown", ""))]
    corr = C.corrections(spark.createDataFrame(rows, SCHEMA)).persist()
    df = spark.createDataFrame(snips, "doc_id bigint, code string, bug_type string").persist()
    return rows, snips, corr, df


@pytest.mark.parametrize("sizes", [{}, {"book": 3, "shelf": 8, "part": 5}])
def test_lookups_match_brute_force(data, monkeypatch, sizes):
    rows, snips, corr, df = data
    monkeypatch.setattr(C, "SIZES", sizes)
    exact = {r.doc_id: r.exact_correction for r in C.exact_lookup(df, corr).collect()}
    similar = {r.doc_id: r.similar_correction for r in C.best_by_type(df, corr).collect()}
    suggested = {r.doc_id: r.suggestion for r in C.suggest_correction(df, corr).collect()}
    assert len(exact) == len(similar) == len(suggested) == len(snips)
    for i, code, kind in snips:
        want = brute(code, kind, rows)
        assert (exact[i], similar[i]) == want, (code, kind)
        assert suggested[i] == (want[0] if want[0] is not None else want[1])


def test_similarity_cases(spark):
    pairs = [("abcd", "abxd", 3), ("", "a", 0), ("x" * 80, "x" * 80, 50), ("é-", "é+", 1), ("a.b", "a.b", 3)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    got = [r[0] for r in df.select(C.prefix_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [p[2] for p in pairs]


def test_statistics_and_lists_per_type(data, monkeypatch):
    rows, _, corr, _ = data
    kept = [r for r in rows if r[3] and r[4].strip()]
    stats = C.correction_stats(corr).first()
    assert (stats.exact_entries, stats.bug_categories) == (len({r[1].strip() for r in kept}), len({r[2] for r in kept}))
    monkeypatch.setattr(C, "BLOCK", 16)
    got = {}
    for r in C.corrections_by_type(corr).orderBy("bug_type", "position").collect():
        got.setdefault(r.bug_type, []).append((r.position, r.code, r.corrected_code))
    want = {}
    for r in kept:
        mine = want.setdefault(r[2], [])
        mine.append((len(mine) + 1, r[1], r[4]))
    assert got == want


def test_search_equals_trying_all_pairs():
    rng = np.random.default_rng(4)
    for n, m, k in [(1, 3, 2), (40, 30, 3), (700, 200, 60), (300, 50, 200)]:
        def made(count):
            return ["".join(chr(97 + c) for c in rng.integers(0, k, rng.integers(0, 13))) for _ in range(count)]

        inside, asked, rows = sorted(made(n)), made(m), rng.permutation(n).astype(np.int64) + 5
        floor = rng.integers(-1, 4, m).astype(np.int16)
        floor_row = np.where(floor < 0, np.iinfo(np.int64).max, rng.integers(0, n + 9, m))
        best, row = nearest.search(nearest.letters(inside, 10, -1), rows, nearest.letters(asked, 10, -2), floor, floor_row, book=16)
        for i, text in enumerate(asked):
            all_ = [(sum(x == y for x, y in zip(text[:10], c[:10])), -r) for c, r in zip(inside, rows.tolist())]
            assert (best[i], -row[i]) == max(all_ + [(floor[i], -floor_row[i])])


def test_a_frequent_type_spreads_over_tasks(spark):
    rnd = random.Random(8)
    rows = [(("hot" if i % 10 else "cold"), "".join(rnd.choice("abcdef") for _ in range(20)), i) for i in range(2000)]
    cands = spark.createDataFrame(rows, "kind string, text string, row_no long")
    asks = spark.createDataFrame([(k, t[::-1]) for k, t, _ in rows[:900]], "kind string, text string").distinct()
    used = nearest._meet
    seen = []

    def counted(found, shelves, *sizes):
        seen.append((found.groupBy("shelf").count().count(), shelves.filter("kind = 'hot'").count()))
        return used(found, shelves, *sizes)

    nearest._meet = counted
    try:
        got = {(r.kind, r.text): r.row_no for r in nearest.nearest(asks, cands, 20, book=16, shelf=128, part=100).collect()}
    finally:
        nearest._meet = used
    assert all(groups >= 15 and hot >= 15 for groups, hot in seen) and len(seen) == 2
    for kind, text in random.Random(1).sample(sorted(got), 60):
        assert got[kind, text] == max(((similarity(text, c), -n) for k, c, n in rows if k == kind))[1] * -1
