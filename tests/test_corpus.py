import hashlib
import math

from pyspark.sql import functions as F

from codegauge.operators import corpus, fixes
from codegauge.sources import corpus as io, files, submissions

SCHEMA = "row_no bigint, code string, language string, bug_type string, has_bug int, corrected_code string, description string"


def row(n, code, note):
    return (n, code, "python", "t", 1, "c", note)


def test_expansion_keeps_existing_rows_and_the_first_new_one(spark):
    existing = spark.createDataFrame([row(1, "a", "e1"), row(2, "a", "e2"), row(3, "b", "e3")], SCHEMA)
    extra = spark.createDataFrame([row(9, "d", "late"), row(1, "b", "x"), row(2, "c", "first"), row(3, "c", "second"),
                                   row(5, "d", "early")], SCHEMA)
    got = sorted((r.code, r.description) for r in corpus.expand_corpus(existing, extra).collect())
    assert got == [("a", "e1"), ("a", "e2"), ("b", "e3"), ("c", "first"), ("d", "early")]


def test_summary_and_blank_rows(spark):
    df = spark.createDataFrame([("x", 1), (" \n\t", 0), ("　", 0)], "code string, has_bug int")
    assert tuple(corpus.corpus_summary(df).first()) == (3, 1, 2)
    assert corpus.non_blank(df).count() == 1
    assert [r.is_blank for r in corpus.flag_blank(df).collect()] == [False, True, True]


def test_split_takes_the_exact_share_of_each_label(spark):
    rows = [(i, None if i % 50 == 0 else int(i % 3 == 0)) for i in range(5000)] + [(9999, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, has_bug int").repartition(5)
    got = {r.doc_id for r in corpus.stratified_split(df, 0.2, 42).filter("is_test").collect()}
    want = set()
    for label in {r[1] for r in rows}:
        ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, y in rows if y == label)
        want |= {i for _, i in ids[:math.floor(len(ids) * 0.2 + 0.5)]}
    assert got == want
    other = {r.doc_id for r in corpus.stratified_split(df, 0.2, 7).filter("is_test").collect()}
    assert len(other) == len(got) and other != got


def test_csv_round_trip_of_awkward_cells(spark, tmp_path):
    cells = ['a\nb', 'say "hi"', "comma, here", "  lead and trail  ", "", "back\\slash", "q\"\n\"\"", "é🔴", "\ttab"]
    df = spark.createDataFrame([(c, "python", "t", i % 2, c, c) for i, c in enumerate(cells)], io.CORPUS_SCHEMA)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        io.write_corpus(df, path, fmt)
        back = io.read_corpus(spark, path, fmt)
        assert back.columns == io.CORPUS_COLUMNS and dict(back.dtypes)["has_bug"] == "int"
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_source_tree_review(spark, tmp_path):
    src = tmp_path / "src" / "deep"
    src.mkdir(parents=True)
    (src / "a.py").write_text("x == None\n", encoding="utf-8")
    (src / "b.JS").write_text("var é = 1", encoding="utf-8")
    (src / "notes.txt").write_text("x != None", encoding="utf-8")
    read = files.read_source_files(spark, str(tmp_path / "src"))
    assert {(r.path.rsplit("/", 1)[1], r.lang) for r in read.collect()} == {
        ("a.py", "python"), ("b.JS", "javascript"), ("notes.txt", "python")}
    out = str(tmp_path / "out")
    files.write_fixed(fixes.with_fixed(read), out)
    assert {(r.out_path.rsplit("/", 1)[1], r.lang, r.fixed_code) for r in spark.read.parquet(out).collect()} == {
        ("a_fixed.py", "python", "x is None"), ("b_fixed.js", "javascript", "let é = 1"),
        ("notes_fixed.py", "python", "x is not None")}
    forced = files.read_source_files(spark, str(tmp_path / "src"), "java")
    assert {r.lang for r in forced.collect()} == {"java"}


def test_submissions_get_the_form_defaults(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"doc_id": 1, "lang": "c"}\n{"doc_id": 2, "code": "x"}\n')
    got = submissions.read_submissions(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.code, r.lang) for r in got] == [("", "c"), ("x", "python")]


def test_split_of_very_many_labels(spark):
    rows = [(i, f"label {i % 1500}") for i in range(15000)]
    df = spark.createDataFrame(rows, "doc_id bigint, kind string").repartition(4)
    got = corpus.stratified_split(df, 0.2, 42, label_col="kind")
    assert got.columns == ["doc_id", "kind", "is_test"]
    assert {r["count"] for r in got.filter("is_test").groupBy("kind").count().collect()} == {2}
    assert got.filter("is_test").select("kind").distinct().count() == 1500
    assert corpus.stratified_split(df.filter("doc_id < 0"), label_col="kind").collect() == []


def test_rows_of_files_are_numbered_in_order(spark, tmp_path):
    def line(n):
        return (f"code {n}\nsecond", "python", "t", 1, f"fix {n}", "d")

    rows = [line(n) for n in range(1, 400)]
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        # files of different sizes, written out of order, the second one empty
        for k, (a, b) in reversed(list(enumerate([(0, 150), (150, 150), (150, 153), (153, 399)]))):
            part = spark.createDataFrame(rows[a:b], io.CORPUS_SCHEMA).coalesce(1)
            io.write_corpus(part, f"{path}/{k}", fmt)
        got = io.read_ordered_corpus(spark, f"{path}/*", fmt).repartition(3)
        assert [(r.row_no, r.code) for r in got.orderBy("row_no").collect()] == [(i + 1, r[0]) for i, r in enumerate(rows)]


def test_ordered_expansion_puts_new_rows_last(spark):
    existing = spark.createDataFrame([row(1, "a", "e1"), row(9, "b", "e2")], SCHEMA)
    extra = spark.createDataFrame([row(7, "c", "x"), row(5, "c", "y"), row(3, "a", "z"), row(6, "d", "w")], SCHEMA)
    got = corpus.expand_ordered(existing, extra).orderBy("row_no").collect()
    assert [(r.code, r.description) for r in got] == [("a", "e1"), ("b", "e2"), ("c", "y"), ("d", "w")]


def test_sources_are_written_as_sparks_own_writer_does(spark, tmp_path):
    rows = [("s1-0", "a\nb"), ("s2-0", ""), ("s2-0", "c"), ("x/y:z", "d"), ("s3-0", None), (None, "e"), ("é", "ü")]
    df = spark.createDataFrame(rows, "name string, value string").coalesce(1)
    files.write_sources(df, str(tmp_path / "own"))
    df.write.partitionBy("name").text(str(tmp_path / "theirs"))
    read = lambda at: sorted((f.parent.name, f.read_text()) for f in (tmp_path / at).rglob("*.txt") if not f.name.startswith("."))
    assert read("own") == read("theirs") and len(read("own")) == 6
    assert sorted(p.name for p in (tmp_path / "own").rglob("*") if p.is_file() and p.name.startswith(".")) == []
    big = spark.range(400).selectExpr("concat('s', id) AS name", "'eval(x)' AS value").repartition(40)
    files.write_sources(big, str(tmp_path / "src"))
    found = files.read_source_files(spark, str(tmp_path / "src"), "javascript").repartition(40)
    files.write_fixed(found.withColumn("fixed_code", F.col("code")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
    assert len(list((tmp_path / "out").rglob("*.parquet"))) < 20
