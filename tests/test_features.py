import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codegauge.functions import features as X, ngrams as N
from codegauge.operators import evaluation, textvec
from helpers import texts

# has_no_return as a search pattern of Python's re (group repeated without possessive loops)
NO_RETURN = r"def \w+\([^)]*\):\s*\n(?:\s+(?!return)\S.*\n)*\s*$"


def model(code, lang):
    out = {"len": len(code), "lines": code.count("\n")}
    for name, pattern in X.PATTERNS.items():
        pattern = NO_RETURN if name == "has_no_return" else pattern
        hit = re.search(pattern, code, re.I if name in X.ANY_CASE else 0) is not None
        out[name] = int(hit and (lang == "javascript" or name not in X.JAVASCRIPT_ONLY))
    for name, of in X.LANG_FLAGS.items():
        out[name] = int(lang == of)
    return out


def samples():
    fixed = ["def g(x):\n    x * x", "def g(x):\n    x * x\n", "let a = 1", "a == b", "def f():\n\nx\n", "def f():\n  \n  a\n return\n",
             "def f():\n", "def f(): \n\n\n", "def f():\n a\nb\n", "def f():\n returned\n", "def a():\n x\ndef b():\n return\n"]
    return [(lang, c) for lang in ("python", "javascript", "java") for c in fixed + texts(500, 70 + len(lang))]


def test_features_and_rule_model_match_python(spark):
    rows = samples()
    df = spark.createDataFrame([(i, lang, c) for i, (lang, c) in enumerate(rows)], "doc_id bigint, lang string, code string")
    assert len(X.NAMES) == 27
    for r in evaluation.extract_features(df).collect():
        lang, code = rows[r.doc_id]
        assert {n: r[n] for n in X.NAMES} == model(code, lang), repr(code)
    for r in evaluation.rule_probability(df).collect():
        feats = model(*reversed(rows[r.doc_id]))
        p = min(1.0, sum(w * feats[n] for n, w in X.WEIGHTS.items()) / 3.0)
        assert r.p_bug == pytest.approx(p, abs=1e-9) and r.prediction == int(r.p_bug >= 0.4)


def test_a_function_of_20000_lines_does_not_overflow_the_matcher(spark):
    code = "def f(x):\n" + "    x = x + 1\n" * 20000
    df = spark.createDataFrame([(1, "python", code), (2, "python", code + "    return x\n")], "doc_id int, lang string, code string")
    assert {r.doc_id: r.has_no_return for r in evaluation.extract_features(df).collect()} == {1: 1, 2: 0}


def test_accuracy_of_nothing_is_zero(spark):
    df = spark.createDataFrame([], "doc_id int, lang string, code string, has_bug int")
    assert evaluation.rule_accuracy(df).first().accuracy == 0.0


def test_report_is_zero_where_undefined(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "label int, prediction int")
    got = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    assert (got["bug"].precision, got["bug"].recall, got["bug"].f1, got["bug"].support) == (0, 0, 0, 2)
    assert got["clean"].recall == 1 and got["accuracy"].f1 == pytest.approx(1 / 3)
    assert got["weighted avg"].precision == pytest.approx(1 / 9)


def grams(text, lo, hi):
    out = []
    for word in text.lower().split():
        word = f" {word} "
        for n in range(lo, hi + 1):
            out += [word[i:i + n] for i in range(len(word) - n + 1)]
    return out


@pytest.mark.parametrize("lo,hi", [(2, 4), (2, 5)])
def test_ngrams_match_the_written_rule(spark, lo, hi):
    values = texts(300, lo + hi) + ["", " ", "a", "É b"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, text string")
    for r in df.select("i", N.char_wb_ngrams(F.col("text"), lo, hi).alias("g")).collect():
        assert r.g == grams(values[r.i], lo, hi)


def test_vocabulary_and_tfidf_match_brute_force(spark):
    values = [v for v in texts(120, 9) if v.strip()]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")
    counts = Counter(g for v in values for g in grams(v, 2, 4))
    top = sorted(counts.items(), key=lambda t: (-t[1], t[0].encode()))[:150]
    assert [(r.term, r.freq) for r in textvec.top_vocabulary(df, 2, 4, 150).collect()] == top
    vocab = {t for t, _ in top}
    docs = [Counter(g for g in grams(v, 2, 4) if g in vocab) for v in values]
    df_of = Counter(t for d in docs for t in d)
    want = {}
    for i, d in enumerate(docs):
        w = {t: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df_of[t])) + 1) for t, n in d.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, t): x / norm for t, x in w.items()})
    got = {(r.doc_id, r.term): r.weight for r in textvec.tfidf_sublinear(df, 2, 4, 150).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    vectors = textvec.fit_text_vectors(df, 2, 4, 150).transform(df).select("doc_id", "features").collect()
    terms = [t for t, _ in top]
    for r in vectors:
        mine = {terms[i]: v for i, v in zip(r.features.indices, r.features.values)}
        assert mine == pytest.approx({t: x for (d, t), x in want.items() if d == r.doc_id})


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (0,)], "has_bug int")
    assert {(r.has_bug, r.weight) for r in evaluation.balanced_weights(df).collect()} == {(1, 4 / 6), (0, 2.0)}


def test_texts_are_split_alike_inside_and_outside_python(spark):
    texts = [f"A{chr(c)}b" for c in range(0x3100)] + ["\u0130x  Y ", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = df.select("text", F.filter(N.raw_words(F.col("text")), lambda w: w != "").alias("words"), F.lower("text").alias("low")).collect()
    assert all((r.low or "").split() == (r.words or []) for r in got)


def test_vectors_are_built_in_bounded_pieces_and_keep_their_rows(spark, monkeypatch):
    texts = [(0, "ab abc ab"), (1, None), (2, ""), (3, "zz"), (4, "abc " * 40)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    whole = textvec.fit_text_vectors(df, 2, 4, 50)
    array = pa.array([t for _, t in texts])
    grams = textvec.WordGrams(2, 4, whole.stages[1].vocabulary)
    want = [np.column_stack(grams.counts(array[i:i + 1]))[:, 1:].tolist() for i in range(5)]
    monkeypatch.setattr(textvec, "PIECE", 8)
    parts = list(textvec._by_text(array))
    assert [len(p) for p in parts] != [5] and sum(map(len, parts)) == 5
    got = {r.doc_id: list(zip(r._counts.indices.tolist(), r._counts.values.tolist())) for r in whole.transform(df).collect()}
    assert [list(map(tuple, want[i])) for i in range(5)] == [got[i] for i in range(5)]
