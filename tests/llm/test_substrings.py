import random
import re

import numpy as np
import pyarrow as pa
import pytest

from codegauge.llm import substrings as s
from codegauge.llm.words import SPACES, plain_words


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    """(id, words, removed words, kept text) of distinct rows; ids in order, none first."""
    out, seen = [], set()
    for i, text in rows:
        words = split(text)
        gone = set()
        for at in range(len(words) - window + 1):
            part = tuple(words[at:at + window])
            if part in seen:
                gone.update(range(at, at + window))
            seen.add(part)
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def cases(window):
    rnd = random.Random(window)
    passages = [[f"p{k}x{i}" for i in range(rnd.randint(window, 5 * window))] for k in range(6)]
    rows = [(None, " ".join(passages[0])), (0, None), (1, ""), (2, " \n\t"), (3, "a " * (3 * window)), (4, "b " * (window - 1)),
            (5, "a b " * window), (6, "Case " * window), (7, "case " * window), (8, " ".join(str(i) for i in range(4000)) + " é" * 50)]
    for i in range(10, 160):
        words = []
        for _ in range(rnd.randint(0, 6)):
            kind = rnd.random()
            if kind < 0.4:
                part = rnd.choice(passages)
                words += part[rnd.randint(0, 3):rnd.randint(window, len(part))]
            elif kind < 0.6:
                words += [rnd.choice("uv")] * rnd.randint(1, window + 4)
            else:
                words += [rnd.choice("abcdefg") for _ in range(rnd.randint(1, 30))]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(200 + k, rows[20][1]) for k in range(30)]


def found(df):
    for row in df.collect():
        assert sum(r.end - r.begin for r in row.removed) == row.n_words - len(split(row.kept))
        assert all(a.end < b.begin for a, b in zip(row.removed, row.removed[1:]))
        yield row.doc_id, row.n_words, row.n_words - len(split(row.kept)), row.kept


@pytest.mark.parametrize("window, shard_words", [(1, 200), (3, 1 << 16), (5, 400), (20, 1 << 16), (20, 300)])
def test_equals_brute_force(spark, window, shard_words):
    rows = cases(window)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, id string, hash int, place int") \
        .repartition(5)
    wanted = brute(rows, window)
    assert sorted(found(s.remove_repeats(docs, window, shard_words=shard_words)), key=str) == sorted(wanted, key=str)


def test_repeated_rows_and_empty_table(spark, empty):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text), (1, text), (2, text + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(found(s.remove_repeats(docs))) == [(1, 25, 0, text), (1, 25, 0, text), (2, 26, 25, "end")]
    assert s.remove_repeats(empty).collect() == []
    two = spark.createDataFrame([("k", text, "p"), ("k", text + " b", "q")], "name string, body string, doc_id string")
    kept = sorted(len(r.kept.split()) for r in s.remove_repeats(two, id_col="name", text_col="body").collect())
    assert kept in ([1, 25], [0, 26])  # one of two texts of one id comes first, by its hash


def test_matching_statistics_of_a_growing_automaton():
    rnd = random.Random(2)
    for letters in ("a", "ab", "abcd"):
        for window in (1, 2, 5):
            pieces = [[rnd.choice(letters) for _ in range(rnd.randint(1, 25))] for _ in range(25)]
            seen, wanted = set(), []
            for piece in pieces:
                gone = set()
                for at in range(len(piece) - window + 1):
                    part = tuple(piece[at:at + window])
                    if part in seen:
                        gone.update(range(at, at + window))
                    seen.add(part)
                wanted.append(gone)
            spans = list(s.earlier_matches(iter(pieces), window))
            assert [{k for b, e in one for k in range(b, e)} for one in spans] == wanted


def test_pieces_without_a_common_side_are_left_out():
    rnd = random.Random(3)
    for window in (1, 3, 5, 20):
        letters = [f"w{k}" for k in range(3 if window < 5 else 2)]
        texts = [" ".join(rnd.choice(letters) for _ in range(rnd.randint(window, 4 * window))) for _ in range(60)] + [" ".join(map(str, range(60)))]
        part = pa.record_batch([pa.array(texts)], names=["text"])
        number, hashes = plain_words(part.column("text"), SPACES)
        text, start, size, anchor, content = s.find_pieces(number, hashes, window)
        _, one = np.unique(content, return_index=True)
        words = " ".join(texts).split()
        pieces = [words[a:a + n] for a, n in zip(start[one], size[one])]
        offsets = np.append(0, np.cumsum(size[one]))
        last, left, right = s.sides(pa.array(sum(pieces, []), pa.string()), offsets, anchor[one].view(np.int64), window)
        kept = s.sharing(left, right)
        seen = {}
        for k, piece in enumerate(pieces):
            own = [tuple(piece[at:at + window]) for at in range(len(piece) - window + 1)]
            assert len(set(own)) == len(own)  # so an anchor with one piece is settled
            for at, w in enumerate(own):
                seen.setdefault(w, []).append((k, left[k] if at <= last[k] else right[k]))
        for found in seen.values():
            assert len({key for _, key in found}) == 1 and found[0][1] != 0
            assert len(found) == 1 or all(kept[k] for k, _ in found)
        assert not kept[[k for k, piece in enumerate(pieces) if "30" in piece]].any()


def test_a_frequent_phrase_makes_windows_only_where_a_side_repeats(spark, monkeypatch, tmp_path):
    rnd = random.Random(4)
    phrase = [f"phrase{k}" for k in range(6)]
    rows = [(i, " ".join([f"a{rnd.random()}" for _ in range(20)] + phrase + [f"b{rnd.random()}" for _ in range(20)])) for i in range(200)]
    rows += [(200 + i, " ".join([f"c{i}"] * 2 + phrase + [f"d{k}" for k in range(12)] + [f"e{i}"] * 5)) for i in range(20)]
    monkeypatch.setattr(s, "scratch_path", lambda _, name: str(tmp_path / name))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(found(s.remove_repeats(docs, shard_words=100))) == [(*row[:3], row[3]) for row in brute(rows, 20)]
    texts = {tuple(split(t)[at:at + 20]) for _, t in rows for at in range(len(split(t)) - 19)}
    assert spark.read.parquet(str(tmp_path / "substrings-windows")).count() < len(texts) / 4


def test_hashes_of_plain_words():
    pair, flip = "a", "b"
    for _ in range(12):
        pair, flip = pair + flip, flip + pair  # a sum of powers alone cannot tell these two apart
    texts = [f"{pair} x Ab ab", None, "", f"{flip}\nab", "é" * 300 + " " + "y" * (1 << 20) + "z Ab", "y" * (1 << 20) + "z"]
    number, hashes = plain_words(pa.array(texts), SPACES)
    assert number.tolist() == [0] * 4 + [3] * 2 + [4] * 3 + [5]
    words = [w for t in texts for w in split(t)]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
