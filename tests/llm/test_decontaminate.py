import hashlib
import random
import re

import pytest
from test_words import lower

from codegauge.llm import decontaminate as d
from codegauge.llm.queries import overlap_digest


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def brute(docs, items, window):
    out = []
    for i, text in docs:
        words, hit, found = tokens(text), set(), set()
        for item, other in items:
            own = tokens(other)
            n = min(window, len(own))
            for p in range(len(own) - n + 1) if n else []:
                for q in range(len(words) - n + 1):
                    if words[q:q + n] == own[p:p + n]:
                        hit.update(range(q, q + n))
                        found.add(item)
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(words), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture
def case():
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.choice([1, 3, 9, 10, 11, 40])))) for i in range(14)]
    items += [(20, items[5][1]), (20, "other words that no document has at all in any place"), (None, "q " * 12), (30, None), (31, ""), (32, ", ;")]
    docs = [(0, None), (1, ""), (2, items[5][1].upper()), (3, "q q " * 8)]
    for i in range(4, 60):
        parts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 30)))]
        for _ in range(rnd.randint(0, 3)):
            words = (rnd.choice(items)[1] or "").split()
            at = rnd.randint(0, max(0, len(words) - 1))
            parts.append(rnd.choice(["x ", ". ", ""]) + " ".join(words[at:at + rnd.randint(1, 45)]))
        docs.append((i, " ".join(parts)))
    return docs + [docs[2], docs[10]], items


@pytest.mark.parametrize("window", [1, 4, 10])
@pytest.mark.parametrize("block_bytes", [1 << 20, 64])
def test_equals_brute_force(spark, case, window, block_bytes):
    docs, items = case
    df = spark.createDataFrame([(i, t, "a") for i, t in docs], "doc_id long, text string, matches string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute(docs, items, window)
    found = overlap_digest(d.find_overlaps(df, bench, window, block_bytes=block_bytes))
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
    kept = d.remove_contaminated(df, bench, window, block_bytes=block_bytes)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in wanted if not w[5])


def test_matches_are_longest_and_empty_tables_work(spark, empty):
    item = [f"i{k}" for k in range(30)]
    text = "a b " + " ".join(item[5:25]) + " c " + " ".join(item[0:12])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    row = d.find_overlaps(df, bench).first()
    assert [(m.start, m.n_words, m.item_start, m.item_ids) for m in row.matches] == [(2, 20, 5, ["9"]), (23, 12, 0, ["9"])]
    none = bench.where("item_id < 0")
    assert d.find_overlaps(df, none).first().matches == [] and d.remove_contaminated(df, none).count() == 1
    assert d.find_overlaps(empty, bench).collect() == [] and d.remove_contaminated(empty, bench).collect() == []
