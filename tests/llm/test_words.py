import re

import pyarrow as pa

from codegauge.llm import words as w


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_words_equal_the_patterns_in_any_block_size(texts, monkeypatch):
    for separators, pattern in ((w.SPACES, r"[^\x20\x09-\x0D]+"), (w.NON_WORD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        wanted = [(n, x) for n, t in enumerate(texts) for x in re.findall(pattern, lower(t or ""))]
        for block in (1 << 20, 64, 7):
            monkeypatch.setattr(w, "BLOCK", block)
            number, hashes = w.words(pa.array(texts, pa.string()), separators)
            assert number.tolist() == [n for n, _ in wanted]
            names = {}
            assert all(names.setdefault(h, x) == x for h, (_, x) in zip(hashes.tolist(), wanted))
            assert len(names) == len({x for _, x in wanted})


def test_slices_hold_every_row_once(texts):
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    parts = list(w.slices(batch, "text", 200))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts and len(parts) > 10
    assert list(w.slices(batch.slice(0, 0), "text")) == []
