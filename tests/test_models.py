import pytest
from pyspark.sql import functions as F

from codegauge.operators import models
from codegauge.plans.analyze import analyze_corpus

BUG = ["eval(x_{})", "exec(y_{})", "except:\n    pass # {}"]
CLEAN = ["value_{} = 1", "def add_{}(a):\n    return a", "total = sum(rows_{})"]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "python", (BUG if i % 2 else CLEAN)[i % 3].format(i), i % 2) for i in range(240)]
    return spark.createDataFrame(rows, "doc_id bigint, lang string, code string, has_bug int").repartition(2).persist()


@pytest.fixture(scope="module")
def trained(labelled):
    return models.train_report(labelled, trees=3)


def test_both_models_learn_and_are_reported_on_a_fifth(trained):
    rows = {(r.model, r["class"]): r for r in trained.report.collect()}
    for model in ("basic", "advanced"):
        assert rows[model, "accuracy"].f1 > 0.9 and rows[model, "accuracy"].support == 48


def test_stored_models_predict_the_same(spark, labelled, trained, tmp_path):
    path = str(tmp_path)
    models.save_models(path, basic=trained.basic, advanced=trained.advanced)
    assert models.load_model(path, "missing") is None
    for name in ("basic", "advanced"):
        again = models.load_model(path, name)
        a = models.predict_proba(labelled, **{name: getattr(trained, name)}).select("doc_id", "p_bug").collect()
        b = models.predict_proba(labelled, **{name: again}).select("doc_id", "p_bug").collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_advanced_model_wins_and_none_leaves_the_rule_score(labelled, trained):
    both = models.predict_proba(labelled, trained.advanced, trained.basic).select("doc_id", "p_bug").collect()
    one = models.predict_proba(labelled, trained.advanced).select("doc_id", "p_bug").collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, one))
    none = models.predict_proba(labelled)
    plain = {r.doc_id: r.score for r in analyze_corpus(labelled).collect()}
    assert {r.doc_id: r.score for r in analyze_corpus(none).collect()} == plain
    blended = {r.doc_id: r.score for r in analyze_corpus(
        models.predict_proba(labelled, trained.basic)).collect()}
    assert any(blended[i] < plain[i] for i in plain)


def test_half_written_models_are_told_from_absent_ones(spark, trained, tmp_path):
    path = str(tmp_path)
    assert models.load_model(path, "basic") is None
    trained.basic.stages[-1].write().save(f"{path}/basic/version-1/stages")  # a writer was lost before it was done
    with pytest.raises(models.IncompleteModel):
        models.load_model(path, "basic")
    models.save_models(path, basic=trained.basic)
    assert sorted(p.name for p in (tmp_path / "basic").iterdir() if not p.name.startswith(".")) == ["done-2", "version-2"]
    (tmp_path / "basic" / "version-3").mkdir()  # a later writer was lost: the finished version still counts
    assert len(models.load_model(path, "basic").stages) == len(trained.basic.stages)
    (tmp_path / "basic" / "version-2" / "metadata").rename(tmp_path / "elsewhere")
    with pytest.raises(Exception):
        models.load_model(path, "basic")


def test_training_rows_are_dealt_by_number_and_text(labelled, monkeypatch):
    rows = models.with_text(labelled)
    monkeypatch.setattr(models, "ROWS", 20)
    spread, n, parts = models._spread(rows)
    assert (n, parts) == (240, 12) and max(spread.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 40
    monkeypatch.setattr(models, "ROWS", 1000)
    monkeypatch.setattr(models, "TEXT_BYTES", 256)
    assert models._spread(rows)[2] > 12
    assert sorted(spread.select("doc_id").collect()) == sorted(labelled.select("doc_id").collect())
