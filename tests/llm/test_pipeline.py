import corpus_pipeline as pipe
import pytest
from test_decontaminate import tokens
from test_neardup import brute

from codegauge.llm import pieces as p, quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipe.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_filters_keep_columns_and_follow_their_decisions(spark, stages):
    assert [n for n, _, _ in stages] == ["toxicity", "quality", "near_duplicates", "decontamination", "segmentation"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for _, before, after in stages[:4]:
        assert after.dtypes == before.dtypes and set(ids(after)) <= set(ids(before))
    (_, a, b), (_, c, d), (_, e, f), (_, g, h) = stages[:4]
    assert ids(b) == sorted(r.doc_id for r in toxicity.toxicity_scores(a, labels).collect() if r.score < 0.5)
    assert ids(d) == sorted(r.doc_id for r in quality.quality_scores(c, labels).collect() if r.score >= 0.3)
    rows = [(r.doc_id, r.text) for r in e.collect()]
    assert ids(f) == [i for i, _, least in brute(rows, 5, 80) if i == least]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = tokens(r.text)
        windows |= {tuple(own[k:k + 10]) for k in range(len(own) - 9)}
    clean = [r.doc_id for r in g.collect() if not any(tuple(w[k:k + 10]) in windows for w in [tokens(r.text)] for k in range(len(w) - 9))]
    assert ids(h) == sorted(clean) and 0 < len(clean) < g.count()


def test_encodings_decode_to_the_kept_texts(stages):
    _, before, after = stages[4]
    pieces, text = p.load_pieces(), {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(text)
    assert all(p.decode(list(r.ids), pieces) == text[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


def test_run_and_odd_rows(spark, stages, empty):
    wanted = sorted((r.doc_id, r["rank"], tuple(r.ids)) for r in stages[4][2].collect())
    assert sorted((r.doc_id, r["rank"], tuple(r.ids)) for r in pipe.run(spark, SF).collect()) == wanted
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    odd = documents.limit(5).union(spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, 0), (-2, None, "", "", 9)], documents.schema))
    for docs in (odd, documents.where("doc_id < 0")):
        for name, stage in pipe.STAGES:
            found = stage(spark, docs, SF)
            assert name == "segmentation" or found.columns == docs.columns
            assert found.count() >= 0
