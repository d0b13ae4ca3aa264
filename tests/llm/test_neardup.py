import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codegauge.llm import neardup as n
from codegauge.llm.words import mix

from test_words import lower

SPACES = " \t\n\x0b\x0c\r"


def shingle_set(text, size):
    for c in SPACES:
        text = (text or "").replace(c, " ")
    words = [w for w in lower(text).split(" ") if w]
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    """(id, set size, smallest id reachable) of every row."""
    sets = [shingle_set(t, size) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def result(df, **options):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in n.near_duplicates(df, **options).collect())


@pytest.mark.parametrize("size, percent", [(2, 80), (5, 80), (1, 50)])
def test_equals_brute_force(docs, texts, size, percent):
    assert result(docs, shingle=size, percent=percent) == brute(list(enumerate(texts)), size, percent)


def test_chains_and_large_groups(spark, monkeypatch):
    """Neighbours of a chain are linked, its ends are not; a group larger than a block is compared in blocks."""
    monkeypatch.setattr(n, "BLOCK", 8)
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[i:i + 40])) for i in range(0, 90, 3)]
    rnd = random.Random(4)
    for i in range(60):
        own = [f"c{k}" for k in range(40)]
        for _ in range(rnd.randint(1, 4)):
            own[rnd.randrange(40)] = f"r{i}x{rnd.random()}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, " ".join(f"c{k}" for k in range(40))) for i in range(50)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2) == brute(rows, 2, 80)


def test_keep_first_and_odd_rows(spark, docs, texts, empty):
    kept = n.keep_first(docs, shingle=2)
    assert kept.columns == docs.columns
    wanted = [i for i, _, c in brute(list(enumerate(texts)), 2, 80) if i == c]
    assert sorted(r.doc_id for r in kept.collect()) == wanted
    odd = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, None), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in n.near_duplicates(odd, shingle=2).orderBy("doc_id", "n_shingles").collect()] == [
        (None, 0, None), (None, 3, 3), (3, 3, 3), (3, 3, 3), (7, 3, 3), (9, 0, 9)]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in n.keep_first(odd, shingle=2).collect()) == [(False, 3), (False, 3), (False, 9), (True, 0), (True, 0)]
    assert result(empty) == [] and n.keep_first(empty).collect() == []


def test_rows_without_an_id_bridge_others(spark):
    words = [f"w{i}" for i in range(60)]
    text = [" ".join(words[a:a + 45]) for a in (0, 4, 8)]  # neighbours share 40 of 48 shingles, the ends 36 of 52
    rows = [(1, text[0]), (None, text[1]), (5, text[2]), (None, "x y z"), (None, "x y z"), (6, text[1] + " end"), (8, "lone one")]
    found = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    assert sorted((r.doc_id or 0, r.component_id) for r in found.collect() if r.n_shingles > 2) == [(0, 1), (1, 1), (5, 1), (6, 1)]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found.collect() if r.n_shingles <= 2) == [(0, 0), (0, 0), (8, 8)]
    apart = spark.createDataFrame([r for r in rows if r[1] not in (text[1], text[1] + " end")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in n.near_duplicates(apart, shingle=2).collect() if r.doc_id} == {1: 1, 5: 5, 8: 8}


def test_rows_of_one_id_are_linked_by_their_own_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(3, a), (3, b), (7, a + " end"), (2, b + " end"), (9, a)]
    found = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(2, 2), (3, 2), (3, 3), (7, 3), (9, 3)]


def test_column_names_of_the_operator_pass_through(spark):
    rows = [(1, "a b c", 10, 11, "p"), (2, "a b c", 20, 21, "q"), (3, "d e f", 30, 31, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, component_id int, c string")
    assert sorted(map(tuple, n.keep_first(docs, shingle=2).collect())) == [rows[0], rows[2]]


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    for size in (4, 20, 400):
        pool = mix(np.arange(200 * size, dtype=np.uint64) + np.uint64(size << 40))
        agree = []
        for k in range(100):
            own = pool[k * size:(k + 1) * size]
            other = own[:-(size // 4)]
            text = np.repeat([0, 1], [len(own), len(other)])
            _, rows = n.signatures(text, np.concatenate([np.sort(own), np.sort(other)]), 384)
            agree.append((rows[0] == rows[1]).mean())
        assert abs(np.mean(agree) - 0.75) < 0.05, (size, np.mean(agree))
    assert rng is not None


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (21, 22), (22, 20), (9, 1)], "a long, b long")
    found = {r.node: r.label for r in n.components(spark, edges).collect()}
    assert found == {1: 1, 3: 1, 4: 1, 5: 1, 9: 1, 20: 20, 21: 20, 22: 20}
    assert n.components(spark, edges.where(F.lit(False))).count() == 0
