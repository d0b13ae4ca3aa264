"""Every registered query against its SQL counterpart on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from workload.oracle import ORACLE
from workload.registry import QUERIES

SLOW = {"train_basic_metrics", "train_advanced_metrics", "predict_stored_model"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, df.collect()) == canonical(names, cur.fetchall())


def test_only_model_fits_lack_sql():
    assert set(QUERIES) - set(ORACLE) == SLOW


def test_entry_offers_all_of_the_library():
    assert set(QUERIES) <= set(entry_module.queries()) and ORACLE.items() <= entry_module.oracle_sql().items()


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 1000
