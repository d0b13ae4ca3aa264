import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from codegauge.llm import compression as c, quality, toxicity
from codegauge.llm.queries import QUERIES


def ranking(rows):
    """Chance that a row of class 1 scores above one of class 0."""
    ones, zeros = ([r.score for r in rows if r.label == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("name, label, least", [("op6_quality", "quality", 0.97), ("op10_toxicity", "toxic", 0.88)])
def test_held_out_ranking(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.1"
    found = QUERIES[name](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = spark.createDataFrame([r for r in rows if r.held_out]).join(labels, "doc_id").collect()
    assert ranking(held) >= least
    if label == "toxic":
        langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
        for lang, caught in (("en", 0.8), ("de", 0.5), ("fr", 0.5)):
            own = [r for r in held if langs[r.doc_id] == lang]
            ones, zeros = ([r.predicted for r in own if r.label == k] for k in (1, 0))
            assert sum(ones) >= caught * len(ones) and sum(zeros) <= 0.05 * len(zeros), lang


def test_telling_grams_by_hand():
    """The bound on chance, worked out in plain Python for every n-gram of two or more toxic pieces."""
    rnd = random.Random(7)
    plain = [bytes(rnd.choice(b"abcdef ") for _ in range(200)) for _ in range(300)]
    toxic = [p[:90] + (b" vilely!! " if k % 3 else b" so bad!! ") + p[90:] for k, p in enumerate(plain[:40])]
    ordinary = plain[40:] + [b"a vilely!! thing"]
    for n in toxicity.NGRAMS:
        def pieces_with(gram, pieces):
            return sum(gram in p for p in pieces)

        seen = {p[i:i + n] for p in toxic for i in range(len(p) - n + 1)}
        tested = [g for g in seen if pieces_with(g, toxic) > 1]
        share, expected = len(toxic) / (len(toxic) + len(ordinary)), set()
        for g in tested:
            a, b = pieces_with(g, toxic), pieces_with(g, ordinary)
            p = a / (a + b)
            if p > share and a / len(toxic) >= toxicity.RATIO * b / len(ordinary):
                bound = (a + b) * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if b else 0.0))
                if len(tested) * math.exp(-bound) <= toxicity.FALSE:
                    expected.add(int.from_bytes(g, "big"))
        assert expected and set(toxicity.telling(toxic, ordinary, n).tolist()) == expected


def test_toxic_dictionary_holds_the_wording():
    rnd = random.Random(9)
    plain = [bytes(rnd.choice(b"abcdefghij ") for _ in range(300)) for _ in range(200)]
    toxic = [b"".join(p[i:i + 60] + rnd.choice([b" worthless ", b" horrible "]) for i in range(0, 300, 60)) for p in plain[:60]]
    made = toxicity.toxic_dictionary(toxic, plain[60:])
    assert b"worthless" in made and b"horrible" in made
    make = toxicity.saving_features(made, c.trained(plain[60:], 4000))
    assert make()(b"x" * 40 + b" worthless " + b"y" * 30)[0] >= 3 and make()(b"")[0] == 0
    assert toxicity.toxic_dictionary([b"same words"] * 3, [b"same words"] * 3)  # nothing tells


def make(spark):
    """Random words; every third text has shouted words in between and is labelled bad and toxic."""
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        words = ["".join(rnd.choice("aeiou") + rnd.choice("bdfgklmnprst") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
        if i % 3 == 0:
            for at in range(5, 55, 10):
                words[at:at + 1] = [rnd.choice(["worthless", "idiotic", "horrible", "stupidity"]), "BUY!! NOW!!"]
        rows.append((i, " ".join(words)))
    labels = [(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_odd_rows(spark, docs, empty):
    own, labels = make(spark)
    for model in (quality.quality_model(own, labels), toxicity.toxicity_model(own, labels)):
        odd = c.scored(docs, model, "doc_id", "text").collect()
        assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
        kept = c.keep_rows(docs, model, least=0.5)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r.id for r in odd if r.score >= 0.5)
        assert c.scored(empty, model, "doc_id", "text").collect() == [] and c.keep_rows(empty, model, least=0.5).collect() == []


@pytest.mark.xfail(reason="open: 84 of 600 rows of this small table are wrong, where a constant answer has 200 wrong")
def test_learns_a_small_table(spark):
    own, labels = make(spark)
    for model, one in ((quality.quality_model(own, labels), lambda i: i % 3 != 0), (toxicity.toxicity_model(own, labels), lambda i: i % 3 == 0)):
        rows = c.scored(own, model, "doc_id", "text").collect()
        assert sum((r.score >= 0.5) != one(r.id) for r in rows) <= 12


def test_labels_of_the_held_out_fold_change_nothing(spark):
    own, labels = make(spark)
    turned = labels.withColumn("quality", F.when(c.fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.quality_scores(own, x).collect()) for x in (labels, turned))
    assert a == b


def test_missing_labels_and_single_classes(spark):
    own, labels = make(spark)
    for rows, share in ((labels.where("doc_id < 0"), 0.5), (labels.where("quality = 1"), 1.0), (labels.withColumn("quality", F.lit(None).cast("int")), 0.5),
                        (labels.withColumn("doc_id", F.lit(None).cast("long")), 0.5), (labels.withColumn("doc_id", F.col("doc_id") + 10_000), None)):
        scores = {r.score for r in quality.quality_scores(own, rows).collect()}
        assert len(scores) == 1 and (share is None or scores == {share})
    few = labels.where("doc_id IN (1, 2, 3, 4, 6, 7)")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(own, few).collect())
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(own, few).collect())
