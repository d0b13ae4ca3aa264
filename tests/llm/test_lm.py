import numpy as np

from codegauge.llm import lm as m

SHAPE = m.Shape(top=20, hashed=6, classes=4, side=2, width=5)


def naive(p, tokens, i):
    """log P of token i by plain sums."""
    around = [tokens[j] if 0 <= j < len(tokens) else SHAPE.tokens for j in (i - 2, i - 1, i + 1, i + 2)]
    mixed = sum(p["embed"][t] * p["place"][k] for k, t in enumerate(around)) / 4
    hidden = np.tanh(mixed @ p["hidden"] + p["bias"])
    cls, slot = tokens[i] % 4, tokens[i] // 4
    outer = np.exp(hidden @ p["cls"] + p["cls_bias"])
    inner = np.array([np.exp(hidden @ p["word"][cls][:, k] + p["word_bias"][cls][k]) if k * 4 + cls < SHAPE.tokens else 0 for k in range(SHAPE.per_class)])
    return float(np.log(outer[cls] / outer.sum()) + np.log(inner[slot] / inner.sum()))


def random_case(n=40):
    rng = np.random.default_rng(3)
    flat = rng.normal(0, 0.4, len(m.start(SHAPE))).astype(np.float64)
    return flat, rng.integers(0, SHAPE.tokens, n), np.zeros(n, np.int64)


def test_log_probability_equals_the_plain_formula():
    flat, tokens, number = random_case()
    p = m.split(flat, SHAPE)
    found = m.log_probability(p, tokens, m.contexts(tokens, number, SHAPE), SHAPE)
    assert np.allclose(found, [naive(p, tokens.tolist(), i) for i in range(len(tokens))], atol=1e-5)


def test_gradient_equals_differences():
    flat, tokens, number = random_case()
    around = m.contexts(tokens, number, SHAPE)
    loss = lambda x: -m.log_probability(m.split(x, SHAPE), tokens, around, SHAPE).mean()
    g = np.concatenate([x.ravel() for x in m.gradient(m.split(flat, SHAPE), tokens, around, SHAPE).values()])
    for k in np.random.default_rng(1).integers(0, len(flat), 60):
        step = np.zeros(len(flat))
        step[k] = 1e-4
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-4 - g[k]) < 1e-3


def test_training_on_all_documents_beats_token_frequencies(spark, docs, texts, empty):
    rows = [(i, " ".join(["sun moon star sky"] * 5 if i % 2 else ["red green blue"] * 7)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shape = m.Shape(top=16, hashed=4, classes=4, width=8)
    before, after = (m.train(df, shape, rounds) for rounds in (0, 2))
    low, high = (m.score(df, x).agg({"sum_log_prob": "sum"}).first()[0] for x in (before, after))
    assert high > 0.7 * low
    odd = m.score(docs, after)
    found = {r.doc_id: r for r in odd.collect()}
    assert found[texts.index(None)].n_tokens == 0 and found[texts.index("")].mean_log_prob is None
    assert all(np.isfinite(r.sum_log_prob) for r in found.values())
    assert m.pseudo_likelihood(empty, shape).collect() == []


def test_vocabulary_counts_every_document(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "A c"), (3, None)], "doc_id long, text string")
    assert sorted(r.n for r in m.word_counts(df.select("text").where("text IS NOT NULL")).collect()) == [1, 1, 3]


def test_words_of_a_shared_token_are_told_apart_by_their_counts(spark):
    shape = m.Shape(top=2, hashed=3, classes=2, side=1, width=4)
    seen = {"a": 90, "b": 60, **{f"w{i}": i + 1 for i in range(30)}}
    df = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(seen.items())], "doc_id long, text string")
    scores = []
    for common in (0, 12, 1000):  # by the join only, by both, by the model only
        model = m.train(df, shape, rounds=1, common=common)
        own = spark.createDataFrame([(w, w) for w in [*seen, "unseen1", "unseen2"]] + [("two", "w3 w3 w9 unseen1 w3")], "doc_id string, text string")
        found = {r.doc_id: r for r in m.score(own, model).collect()}
        scores.append({w: r.sum_log_prob for w, r in found.items()})
        assert len(found) == len(seen) + 3 and found["two"].n_tokens == 5
        assert abs(found["two"].mean_log_prob * 5 - found["two"].sum_log_prob) < 1e-9
    assert all(abs(x[w] - scores[0][w]) < 1e-9 for x in scores for w in x)
    one = scores[0]
    same = [w for w in seen if w not in ("a", "b")]
    tokens = {w: int(m.to_tokens(m.words(m.pa.array([w]), m.SPACES)[1], model.vocabulary, model.rank, shape)[0]) for w in [*same, "unseen1"]}
    for w in same:
        for v in same:
            if tokens[w] == tokens[v]:
                assert abs(one[w] - one[v] - np.log(seen[w] / seen[v])) < 1e-6
    # all words, and an unseen one of every shared token, share a mass of 1
    p = m.split(model.flat, shape)
    around = np.full((shape.tokens, 2), shape.tokens)
    shares = np.exp(m.log_probability(p, np.arange(shape.tokens), around, shape))
    unseen = sum(shares[shape.top + k] / (model.shared[k] + 1) for k in range(shape.hashed))
    assert abs(sum(np.exp(one[w]) for w in seen) + unseen - 1) < 1e-5
    assert model.shared.sum() == sum(seen[w] for w in same)
