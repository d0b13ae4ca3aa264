import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from codegauge.operators import boosting, bundles, models

SIZES, DEFAULT = np.array([5, 2, 9, 3]), np.array([0, 1, 4, 0])
PARAMS = {"maxIter": 7, "maxDepth": 3, "stepSize": 0.1, "seed": 42, "maxBins": 32}


@pytest.fixture(scope="module")
def table():
    rnd = np.random.default_rng(3)
    categories = np.stack([rnd.integers(0, s, 900) for s in SIZES], axis=1)
    usual = rnd.random(categories.shape) < 0.5
    categories[usual] = np.broadcast_to(DEFAULT, categories.shape)[usual]
    score = np.sin(categories * [1.0, 3.0, 2.0, 5.0]).sum(axis=1) + rnd.normal(0, 0.7, 900)
    return categories, (score > 0.4).astype(np.int8)


def blocks_of(spark, categories, label, parts=3):
    shape, made = boosting.Shape(SIZES, DEFAULT), []
    for own in np.array_split(np.arange(len(label)), 7):
        row, bundle = np.nonzero(categories[own])
        made.append(boosting.make_block(label[own], row, bundle, categories[own][row, bundle], shape))
    return spark.sparkContext.parallelize(made, parts), shape


@pytest.fixture(scope="module")
def spark_trees(spark, table):
    schema = StructType([StructField("i", IntegerType()), StructField("label", DoubleType()), StructField("features", VectorUDT())])
    rows = spark.createDataFrame([(i, float(y), Vectors.dense(x.astype(float))) for i, (x, y) in enumerate(zip(*table))], schema)
    marked = {"ml_attr": {"num_attrs": len(SIZES), "attrs": {"nominal": [{"idx": i, "num_vals": int(s)} for i, s in enumerate(SIZES)]}}}
    rows = rows.withMetadata("features", marked).persist()
    return rows, GBTClassifier(**PARAMS).fit(rows)


def probabilities(model, rows):
    return np.array([r.p for r in model.transform(rows).orderBy("i").select(vector_to_array("probability")[1].alias("p")).collect()])


def grown(spark, table, parts=3):
    blocks, shape = blocks_of(spark, *table, parts)
    trees = boosting.grow_trees(blocks, shape, PARAMS["maxIter"], PARAMS["maxDepth"], PARAMS["stepSize"])
    return trees, boosting.to_model(spark, trees, shape, **PARAMS)


def test_trees_are_those_of_spark(spark, table, spark_trees):
    rows, theirs = spark_trees
    trees, ours = grown(spark, table)
    assert np.abs(probabilities(ours, rows) - probabilities(theirs, rows)).max() < 1e-8
    shapes = [[line.strip() for line in m.toDebugString.split("\n") if "feature" in line] for m in (ours, theirs)]
    assert shapes[0] == shapes[1]
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-7)
    for tree in trees:  # every statistic of a node is that of its children
        for v in tree.splits:
            assert np.allclose(tree.stats[v], np.add(tree.stats[2 * v], tree.stats[2 * v + 1]), atol=1e-5)


def test_scores_afresh_and_sums_in_tasks_change_nothing(spark, table, spark_trees, monkeypatch):
    rows, theirs = spark_trees
    monkeypatch.setattr(boosting, "RENEWED", 2)
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)
    _, ours = grown(spark, table, 5)
    assert np.abs(probabilities(ours, rows) - probabilities(theirs, rows)).max() < 1e-8


def test_a_block_lists_only_rows_that_differ_from_the_most_frequent_category(table):
    categories, label = table
    row, bundle = np.nonzero(categories)
    shape = boosting.Shape(SIZES, DEFAULT)
    y, rows, starts = boosting.make_block(label, row, bundle, categories[row, bundle], shape)
    assert len(rows) == (categories != DEFAULT).sum() and rows.dtype == np.uint16 and set(y.tolist()) == {-1, 1}
    for b, (lo, size) in enumerate(zip(shape.offsets, SIZES)):
        for c in range(size):
            want = np.flatnonzero(categories[:, b] == c) if c != DEFAULT[b] else []
            assert rows[starts[lo + c]:starts[lo + c + 1]].tolist() == list(want)


def test_one_class_gives_one_leaf_and_no_rows_are_refused(spark, table):
    trees, model = grown(spark, (table[0], np.ones(900, np.int8)))
    assert all(not t.splits for t in trees) and model.trees[0].numNodes == 1
    with pytest.raises(ValueError):
        grown(spark, (table[0][:0], table[1][:0]))


def test_weights_keep_their_order_and_their_side_of_a_limit():
    w = np.sort(np.random.default_rng(1).random(5000) ** 4)
    keys = bundles._keys(w)
    assert (np.diff(keys) >= 0).all() and np.allclose(bundles.weights(keys), w, rtol=2e-7, atol=0)
    limits = np.nextafter(bundles.weights(keys[::50] + 1), 0)
    assert ((w[:, None] > limits) == (bundles.weights(keys)[:, None] > limits)).all()


def test_cuts_are_quantiles_of_all_weights_of_a_term(spark):
    rnd = np.random.default_rng(2)
    made, of_term = [], {t: [] for t in range(0, 70, 7)}
    for _ in range(6):
        sizes = rnd.integers(0, 6, 40)
        term = np.concatenate([np.sort(rnd.choice(list(of_term), s, replace=False)) for s in sizes]).astype(np.uint8)
        weight = bundles._keys(rnd.random(len(term)))
        for t, k in zip(term.tolist(), weight.tolist()):
            of_term[t].append(k)
        made.append(bundles.Packed(np.zeros(40, np.int8), rnd.integers(0, 1 << 60, 40), np.cumsum(sizes), term, np.ones(len(term), np.uint8), weight))
    found = bundles._term_facts(spark.sparkContext.parallelize(made, 3), sum(len(b.term) for b in made), 4)
    assert [f[0] for f in found] == list(of_term)
    for term, n, _, _, cuts, sizes in found:
        keys = np.sort(of_term[term])
        at = keys[[-(-n * j // 4) - 1 for j in (1, 2, 3)]]
        assert n == len(keys) == sum(sizes) and cuts == np.nextafter(bundles.weights(at + 1), 0).tolist()
        assert sizes == [int(x) for x in np.diff([0, *(int((keys <= a).sum()) for a in at), n])]


def test_labels_must_be_known(spark):
    rows = spark.createDataFrame([(1, "a b", 0), (2, "c d", None)], "doc_id bigint, text string, has_bug int")
    with pytest.raises(Exception, match="labels"):
        models.train_advanced(rows, trees=1)


def test_texts_without_terms_get_the_share_of_the_labels(spark):
    rows = spark.createDataFrame([(i, None, int(i < 3)) for i in range(4)], "doc_id bigint, text string, has_bug int")
    model = models.train_advanced(rows, trees=2)
    assert model.transform(rows).where(F.col("prediction") == 1).count() == 4
