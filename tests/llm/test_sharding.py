import duckdb
import pytest
from pyspark.sql import functions as F

from codegauge.llm import sharding as s
from codegauge.llm.oracle import shards_sql


@pytest.mark.parametrize("limit", [1, 60, 400, 3000, 10_000_000])
def test_equals_sql_for_any_limit(docs, texts, limit):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    columns = ["doc_id", "bytes", "shard", "depth", "page", "shard_bytes", "shard_rows", "oversize"]
    wanted = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({shards_sql(limit)})").fetchall())
    found = s.shard(docs, limit=limit, fine_bits=2)
    assert found.columns == docs.columns + s.ADDED
    assert sorted(tuple(r) for r in found.select(columns).collect()) == wanted


def test_repeated_keys_fill_pages(spark):
    rows = [(1, "x" * 10)] * 500 + [(None, "y" * 30)] * 40 + [(2, "z" * 900), (3, None)] + [(4, "q" * 150)] * 3
    found = s.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit=200)
    assert found.count() == len(rows)
    pages = found.groupBy("shard", "page").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("oversize").alias("o")).collect()
    assert all(p.b <= 200 or p.n == 1 and p.o for p in pages) and sum(p.o for p in pages) == 1


def test_plan_is_native_and_names_are_checked(docs, empty, tmp_path):
    found = s.shard(docs, limit=400)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))
    assert s.shard(empty).collect() == []
    with pytest.raises(ValueError, match="shard"):
        s.shard(docs.withColumn("shard", F.lit(1)))
    clash = s.shard(docs.withColumn("shard", F.lit(1)), limit=400, prefix="own_")
    assert clash.where("shard = 1").count() == docs.count() and "own_shard" in clash.columns
    s.write_shards(found, str(tmp_path / "out"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_column_names_of_the_operator_pass_through(spark):
    names = ["leaves", "__h", "__salt", "__leaf", "__bytes", "__cell", "__page", "__group", "__alone", "__row", "cell"]
    rows = [(i, "x" * 40, *[i * 100 + k for k in range(len(names))]) for i in range(30)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    for limit in (100, 10_000):
        found = s.shard(docs, limit=limit)
        assert found.columns == docs.columns + s.ADDED
        assert sorted(tuple(r) for r in found.select(docs.columns).collect()) == sorted(rows)
