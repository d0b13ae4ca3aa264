"""Registered training-data queries against their SQL counterparts on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from codegauge.llm.oracle import ORACLE
from codegauge.llm.queries import QUERIES

#: Checked against brute force or on held-out labels in the other tests of this folder.
WITHOUT_SQL = {"op5_token_counts", "op6_quality", "op8_pseudo_likelihood", "op9_sampled_segmentations", "op10_toxicity",
               "op11_periodic_runs", "op12_conversation_repair"}


def test_registered():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries()) and ORACLE.items() <= entry_module.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*map(F.col, names)).collect()), key=str) == sorted(cur.fetchall(), key=str)
