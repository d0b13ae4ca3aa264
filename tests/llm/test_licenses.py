import re

import duckdb
import pytest
from test_words import lower

from codegauge.llm import licenses as l
from codegauge.llm.oracle import licenses_sql
from codegauge.llm.queries import license_digest

NOTICES = [
    "Licensed under the Apache License, Version 2.0.", "x licensed under the apache LICENSE 2.0 (the \"License\"); you may not use",
    "Released under the MIT License", "released under the terms of the MIT license", "Released under the a b c d MIT License",
    "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0", "Licensed under the GNU General Public License, version 3", "gnu general public",
    "Copyright (c) 2020 A. B. Someone. All rights reserved", "Copyright 1 2 3 4 5 6 7 8 9 all rights reserved", "mit license " * 50, "cc by cc by",
]


def test_equals_sql(spark, texts):
    rows = list(enumerate(texts + NOTICES + [f"{a}\n{b}" for a in NOTICES[:4] for b in NOTICES]))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    wanted = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({licenses_sql()})").fetchall(), key=lambda r: r[0])
    found = license_digest(l.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))).select(columns)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[0]) == wanted
    assert sum(r[-1] == 1.0 for r in wanted) > 20


def test_spans_of_optional_and_replaceable_regions(spark, empty):
    template = [("T", "Use of <<var;max=2>> is free <<beginOptional>> of charge <<beginOptional>> for all <<endOptional>> <<endOptional>> now")]
    cases = {"use of it is free now": (0, 6), "Use of this thing is free of charge now!": (0, 9), "a use of is free of charge for all now": (1, 9),
             "use of this very thing is free now": None, "use of it is free of now": None, "use of it is free for all now": None}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = {r.doc_id: [(t.start, t.n_words) for t in r.templates] for r in l.scan_licenses(df, template, []).collect()}
    assert found == {i: [span] if span else [] for i, span in enumerate(cases.values())}
    assert l.scan_licenses(empty).collect() == []
    with pytest.raises(ValueError, match="mandatory"):
        l.compile_templates([("T", "<<var;max=2>> word")])


def test_phrase_places(spark):
    text = "MIT license, mit\nLicense mit; CC-BY cc by-by"
    words = re.findall(r"[0-9a-z]+", lower(text))
    row = l.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), []).first()
    wanted = sorted((i, len(p.split()), label) for p, label in l.PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
    assert [(m.start, m.n_words, m.label) for m in row.phrases] == wanted and row.n_words == len(words)
