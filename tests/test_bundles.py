import random

import pytest
from pyspark.sql import functions as F

from codegauge.operators import bundles, models, textvec


@pytest.fixture(scope="module")
def fitted(spark):
    rnd = random.Random(4)
    words = [[f"{g}{rnd.choice('klmnp')}{rnd.choice('aeiou')}" for _ in range(12)] for g in "uvwxyz"]
    texts = [(i, " ".join(rnd.choice(words[i % 6]) for _ in range(rnd.randint(1, 9)))) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    vectoriser = textvec.fit_text_vectors(df, 2, 5, 400, output="wide")
    grams, counter, scaler = vectoriser.stages
    counted = counter.transform(grams.transform(df))
    rows = scaler.transform(counted.select("doc_id", F.xxhash64("text").alias("key"), "_counts", F.col("_counts").alias("counts"))).persist()
    return rows, counter.vocabulary, bundles.fit_bundles(rows, len(counter.vocabulary))


def test_no_term_is_left_out_and_equal_columns_share_one(fitted):
    rows, vocabulary, bundler = fitted
    bundle = bundler.getOrDefault(bundler.bundle)
    column = {t: [] for t in range(len(vocabulary))}
    for r in rows.select("doc_id", "counts").collect():
        for t, n in zip(r.counts.indices.tolist(), r.counts.values.tolist()):
            column[t].append((r.doc_id, n))
    leaders = {}
    for t in range(len(vocabulary)):
        leaders.setdefault(tuple(sorted(column[t])), t)
    assert {t for t, b in enumerate(bundle) if b >= 0} == set(leaders.values())
    assert len(set(bundle)) < len(leaders)


def test_terms_of_a_bundle_share_no_row_and_no_category(fitted):
    rows, vocabulary, bundler = fitted
    bundle, first, starts, sizes = (bundler.getOrDefault(p) for p in (bundler.bundle, bundler.first, bundler.starts, bundler.sizes))
    for r in rows.select("wide").collect():
        own = [bundle[t] for t in r.wide.indices.tolist() if bundle[t] >= 0]
        assert len(own) == len(set(own))
    taken = [(b, first[t] + k) for t, b in enumerate(bundle) if b >= 0 for k in range(starts[t + 1] - starts[t] + 1)]
    assert len(taken) == len(set(taken)) and all(1 <= c < sizes[b] <= bundles.SLOTS for b, c in taken)


def test_levels_follow_the_weights(fitted):
    rows, vocabulary, bundler = fitted
    bundle, first, starts, limits = (bundler.getOrDefault(p) for p in (bundler.bundle, bundler.first, bundler.starts, bundler.limits))
    for r in bundler.transform(rows).select("wide", "features").collect():
        want = {}
        for t, w in zip(r.wide.indices.tolist(), r.wide.values.tolist()):
            if bundle[t] >= 0:
                want[bundle[t]] = first[t] + sum(w > x for x in limits[starts[t]:starts[t + 1]])
        assert dict(zip(r.features.indices.tolist(), r.features.values.tolist())) == want


def test_a_term_beyond_any_thousand_decides(spark):
    """The one telling word is rarer than all others: a selection of frequent or merged-away terms would lose it."""
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(12)) + (" qqq" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, has_bug int").repartition(2)
    model = models.train_advanced(df, trees=2)
    assert len(model.stages[1].vocabulary) > 1000
    assert model.transform(df).where(F.col("prediction") != F.col("has_bug")).count() == 0


def test_few_rows_and_null_texts(spark):
    rows = [(1, "a b", 0), (2, "c d", 1), (3, None, 0)]
    model = models.train_advanced(spark.createDataFrame(rows, "doc_id bigint, text string, has_bug int"), trees=1)
    assert model.transform(spark.createDataFrame(rows, "doc_id bigint, text string, has_bug int")).count() == 3
