import collections
import math
import random

import numpy as np
import pytest

from codegauge.llm import pieces as p, sampling as s, tokencount as t


@pytest.fixture(scope="module")
def pieces():
    return p.load_pieces()


def brute_count(word, pieces):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[b][0] + pieces.text[word[b:end]][1], best[b][1] + 1) for b in range(max(0, end - pieces.longest), end) if word[b:end] in pieces.text]
        if word[end - 1] not in pieces.text:
            options.append((best[end - 1][0] + pieces.unknown, best[end - 1][1] + len(p.char_bytes(word[end - 1]))))
        top = max(o[0] for o in options)
        best.append((top, min(n for v, n in options if abs(v - top) <= 1e-9)))
    return best[-1][1]


def test_counts_equal_plain_dynamic_programming(docs, texts, empty, pieces):
    odd = texts + ["▁ x  y\n\n\tz \x00 \U0001F600é", "nospace" * 40]
    split = p.splitter(pieces)
    rows = docs.sparkSession.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    found = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in t.count_tokens(rows).collect()}
    for i, text in enumerate(odd):
        parts = split.findall(p.escape(text or ""))
        assert "".join(parts) == p.escape(text or "")
        assert found[i] == (len(parts), sum(brute_count(w, pieces) for w in parts)), text
    assert t.count_tokens(docs).count() == len(texts) and t.count_tokens(empty).collect() == []


def test_samples_decode_to_their_text_and_differ(docs, texts, empty):
    encoded = s.sample_segmentations(docs, k=3)
    rows = s.decode_tokens(encoded).collect()
    seen = collections.defaultdict(list)
    for r in rows:
        assert r.text == (texts[r.doc_id] or "")
        seen[r.doc_id].append((r["rank"], tuple(r.ids), r.log_prob, r.log_inclusion))
    for i, text in enumerate(texts):
        own = sorted(seen[i])
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and len({x[1] for x in own}) == len(own)
        assert len(own) == 3 if text and len(text) > 5 and text.strip() else len(own) >= 1
        assert all(x[3] <= 0 for x in own)
    again = {(r.doc_id, r["rank"]): r.ids for r in s.sample_segmentations(docs.repartition(3), k=3).collect()}
    assert again == {(r.doc_id, r["rank"]): r.ids for r in rows}
    assert s.sample_segmentations(empty).collect() == []


def segmentations(text, pieces, alpha):
    if not text:
        yield (), 0.0
    for k in range(1, len(text) + 1):
        if text[:k] in pieces.text:
            i, score = pieces.text[text[:k]]
            for rest, other in segmentations(text[k:], pieces, alpha):
                yield (i, *rest), alpha * score + other


def test_samples_follow_sampling_without_replacement(pieces):
    lookup, n, text, alpha = p.Lookup(pieces), 8000, "the in", 0.3
    every = dict(segmentations(p.escape(text), pieces, alpha))
    total = sum(math.exp(v) for v in every.values())
    chance = {k: math.exp(v) / total for k, v in every.items()}
    rows = s.sample_texts([s.row_key(i, 5) for i in range(n)], [text] * n, pieces, lookup, 2, alpha)
    first, pairs, weight = collections.Counter(), collections.Counter(), collections.Counter()
    for a, b in rows:
        x, y = tuple(a[0].tolist()), tuple(b[0].tolist())
        assert math.isclose(a[1], math.log(chance[x]), abs_tol=1e-6)
        first[x] += 1
        pairs[x, y] += 1
        for ids, (_, _, inclusion) in ((x, a), (y, b)):
            weight[ids] += math.exp(-inclusion) / n
    assert 0.5 * sum(abs(first[k] / n - v) for k, v in chance.items()) < 0.03
    wanted = {(a, b): chance[a] * chance[b] / (1 - chance[a]) for a in chance for b in chance if a != b}
    assert 0.5 * sum(abs(pairs[k] / n - v) for k, v in wanted.items()) < 0.06
    likely = [k for k, v in chance.items() if v > 0.05]
    assert likely and all(abs(weight[k] - 1) < 0.1 for k in likely)  # inclusion scores make unbiased weights


def test_texts_with_few_segmentations_give_all(pieces):
    lookup = p.Lookup(pieces)
    rnd = random.Random(1)
    for text in ("a", "", "\n", "\U0001F600", "ab"):
        every = {tuple(x) for x, _ in segmentations(p.escape(text), pieces, 0.3)} if text.isalpha() and text.isascii() else None
        found = s.sample_texts([s.row_key(rnd.random(), 1)], [text], pieces, lookup, 50, 0.3)[0]
        assert all(p.decode(x[0].tolist(), pieces) == text and (x[2] == 0 or len(found) == 50) for x in found)
        if every:
            assert {tuple(x[0].tolist()) for x in found} == every and math.isclose(sum(math.exp(x[1]) for x in found), 1, rel_tol=1e-6)
    assert np.isfinite(p.load_pieces().unknown)


ODD = ["", "▁ x  y\n\n\tz \x00 \U0001F600é", "  two  blanks ", "ends ▁▁", "\n", " ", "nospace" * 40, "漢字 and words", "walking talking walking"]


def test_pretokens_are_those_of_the_splitter(pieces):
    split, texts = p.splitter(pieces), ODD + ["".join(random.Random(k).choices(" ▁a\né.", k=200)) for k in range(20)]
    flat, begin, counts = p.pretokens(texts, p.Lookup(pieces))
    joined = flat.tobytes().decode("utf-32-le", "surrogatepass")
    found = [joined[a:b] for a, b in zip(begin.tolist(), begin[1:].tolist())]
    wanted = [split.findall(p.escape(t)) for t in texts]
    assert found == sum(wanted, []) and counts.tolist() == [len(w) for w in wanted]


def test_equal_endings_share_nodes_and_a_wrong_match_changes_no_sample(pieces, monkeypatch):
    lookup = p.Lookup(pieces)
    flat, start = p.code_points(["▁walking", "▁talking", "king", "▁walking"])
    lattices = s.Lattices(flat, start, pieces, lookup, 0.3)
    endings = {w[k:] for w in ["▁walking", "▁talking"] for k in range(len(w))}
    assert lattices.end == len(endings) and lattices.base[0] == lattices.base[3]
    keys = list(range(len(ODD)))
    plain = [[(ids.tolist(), a, b) for ids, a, b in rows] for rows in s.sample_texts(keys, ODD, pieces, lookup, 3, 0.3)]
    monkeypatch.setattr(s, "stretches", lambda hashes: lambda begin, size: np.zeros(len(begin), np.uint64))  # all stretches seem equal
    again = [[(ids.tolist(), a, b) for ids, a, b in rows] for rows in s.sample_texts(keys, ODD, pieces, lookup, 3, 0.3)]
    for one, two in zip(plain, again, strict=True):
        assert [x[0] for x in one] == [x[0] for x in two]
        assert np.allclose([x[1:] for x in one], [x[1:] for x in two], atol=1e-9)
