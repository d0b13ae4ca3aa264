import datetime as dt
import random

from codegauge.operators import history
from codegauge.plans.analyze import analyze_corpus
from codegauge.sources.submissions import SUBMISSION_SCHEMA, read_submissions
from codegauge.streaming import jobs
from helpers import texts


def submissions(spark, n=900):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if i % 3 == 0 else rnd.randint(2, 9), start + dt.timedelta(seconds=rnd.randint(0, 400)),
             rnd.choice(["python", "javascript", None]), code * 5) for i, code in enumerate(texts(n, 31))]
    return rows, spark.createDataFrame(rows, SUBMISSION_SCHEMA)


def store(df, path, files):
    df.repartition(files).write.json(path)


def test_history_keeps_the_newest_of_each_user(spark):
    rows, df = submissions(spark)
    got = {}
    for r in history.recent_history(df, 20).orderBy("user_id", "pos").collect():
        got.setdefault(r.user_id, []).append((r.doc_id, r.code))
    for user in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0]), reverse=True)[:20]
        assert got[user] == [(r[0], r[4][:120]) for r in mine]


def test_stream_results_equal_batch_results(spark, tmp_path):
    _, df = submissions(spark)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    store(df, src, 6)
    jobs.write_analysis(read_submissions(spark, src, stream=True, max_files=2), out, str(tmp_path / "cp")).awaitTermination()
    want = analyze_corpus(read_submissions(spark, src))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_history_stream_merges_batches_and_restarts(spark, tmp_path):
    _, df = submissions(spark)
    src, out, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))

    def run():
        jobs.write_recent_history(read_submissions(spark, src, stream=True, max_files=2), out, cp, 20).awaitTermination()

    store(df.filter("doc_id % 2 = 0"), src, 4)
    run()
    # late rows arrive after a restart
    df.filter("doc_id % 2 = 1").repartition(3).write.mode("append").json(src)
    run()
    want = sorted(map(tuple, history.recent_history(read_submissions(spark, src), 20).collect()))
    assert sorted(map(tuple, jobs.read_recent_history(spark, out).collect())) == want


def folders(path):
    return sum(1 for p in path.rglob("*") if p.is_dir())


def test_history_does_not_grow_with_the_number_of_batches(spark, tmp_path):
    _, df = submissions(spark, 600)
    src, out, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))
    assert jobs.read_recent_history(spark, out).collect() == []
    store(df.filter("doc_id < 500"), src, 26)
    jobs.write_recent_history(read_submissions(spark, src, stream=True, max_files=1), out, cp, 5, buckets=4).awaitTermination()
    before = folders(tmp_path / "out")
    df.filter("doc_id >= 500").repartition(25).write.mode("append").json(src)
    jobs.write_recent_history(read_submissions(spark, src, stream=True, max_files=1), out, cp, 5, buckets=4).awaitTermination()
    assert folders(tmp_path / "out") <= max(before, 1 + 2 * 2 * 4)  # the manifest's, and two generations of four buckets
    assert len(list((tmp_path / "out" / "_manifest").glob("0*[0-9]"))) == 1
    want = sorted(map(tuple, history.recent_history(read_submissions(spark, src), 5).collect()))
    assert sorted(map(tuple, jobs.read_recent_history(spark, out, 5).collect())) == want


def test_a_batch_repeated_around_its_commit_changes_nothing(spark, tmp_path):
    from codegauge.streaming.versions import VersionedTable

    def rows(*values):
        return spark.createDataFrame([(v, v % 2) for v in values], "v int, bucket int")

    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(rows(1, 2), [0, 1], 0, table.manifest())
    first = table.manifest()
    rows(9).write.partitionBy("bucket").parquet(f"{tmp_path}/t/version=1")  # written, then lost before the commit
    assert sorted(r.v for r in table.read(table.manifest()).collect()) == [1, 2]
    table.replace(rows(3, 5), [1], 1, first)
    assert (table.manifest().batch, table.manifest().versions) == (1, {"0": 0, "1": 1})
    assert sorted(r.v for r in table.read(table.manifest()).collect()) == [2, 3, 5]
    assert sorted(r.v for r in table.read(first).collect()) == [1, 2]  # a reader of the manifest before
    table.replace(rows(), [], 2, table.manifest())
    assert sorted(r.v for r in table.read(table.manifest()).collect()) == [2, 3, 5]
    assert not (tmp_path / "t" / "version=0" / "bucket=1").exists()
