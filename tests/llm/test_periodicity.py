import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from codegauge.llm import periodicity as p
from codegauge.llm.queries import periods_digest, plant_periods


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, text):
    words = split(text)
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % period] for i, w in enumerate(words)]
    return words


def brute_runs(words, least=6, times=4):
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, times * q):
                found.setdefault((start, length), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute(doc_id, text):
    words = planted(doc_id, text)
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def random_text(rnd):
    letters = rnd.choice(["a", "ab", "abc", "abcdefgh"])
    out = []
    for _ in range(rnd.randint(0, 6)):
        part = [rnd.choice(letters) for _ in range(rnd.randint(1, 9))]
        out += part * rnd.choice([1, 1, 2, 3, 4, 5, 9]) + part[:rnd.randint(0, len(part))]
    return rnd.choice([" ", "\n", "\t \x0b"]).join(out)


def test_extensions_equal_comparison():
    rnd = np.random.default_rng(3)
    for n, k in [(2, 1), (5, 1), (40, 2), (300, 2), (300, 40), (900, 1)]:
        body = rnd.integers(1, k + 1, n)
        body[n // 2:] = body[:n - n // 2]
        s = np.concatenate([[k + 1], body, [k + 2]])
        x, y = rnd.integers(1, n + 1, (2, 500))
        x, y = x[x != y], y[x != y]
        levels = p.recompress(s)
        wanted = [next(i for i in range(n + 2) if s[a + i] != s[b + i]) for a, b in zip(x, y)]
        assert p.common_extension(levels, x, y).tolist() == wanted
        mirror = [level.mirrored() for level in levels]
        wanted = [next(i for i in range(n + 2) if s[a - i] != s[b - i]) for a, b in zip(x, y)]
        assert p.common_extension(mirror, n + 1 - x, n + 1 - y).tolist() == wanted


@pytest.mark.parametrize("slice_bytes", [1 << 20, 300])
def test_equals_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(p, "SLICE_BYTES", slice_bytes)
    rnd = random.Random(1)
    rows = [(i, random_text(rnd)) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "x " * 3000), (1004, "é ü " * 500 + "x" * 9000), (None, "a b " * 9), (3, rows[3][1]),
             (1005, " ".join(str(i * i % 997) for i in range(20000)))]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, id string, runs int")
    found = periods_digest(p.find_runs(plant_periods(docs)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted((brute(i, t) for i, t in rows), key=str)


def test_real_outputs_and_empty_table(spark, empty):
    docs = spark.createDataFrame([("k", "go a b  a b a b\na b a stop")], "name string, body string")
    row = p.find_runs(docs, id_col="name", text_col="body").first()
    assert (row.name, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("k", 11, [(1, 9, 2)], "go a b stop")
    assert p.find_runs(empty).collect() == [] and p.find_runs(empty).columns == ["doc_id", "n_words", "runs", "collapsed"]
