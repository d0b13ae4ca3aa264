"""Physical plans: where shuffles happen and what the scans read."""

from types import SimpleNamespace

import pytest
from codegauge.operators import corpus, fixes, history, scan, scoring, structure
from codegauge.plans.analyze import analyze_corpus
from codegauge.session import scratch_path, shared_root, spread
from workload import inputs as I


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "snippets")
    spark.createDataFrame([(i, i % 3, None, "python", "eval(x)", "n", 1) for i in range(50)],
                          "doc_id bigint, user_id bigint, ts timestamp_ntz, lang string, code string, bug_type string, has_bug int"
                          ).write.parquet(path)
    return spark.read.parquet(path)


def test_flagship_is_one_projection_without_a_shuffle(stored):
    text = plan(analyze_corpus(stored))
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string,code:string>" in text


@pytest.mark.parametrize("op", [scan.line_findings, scan.doc_rule_hits, scan.fault_report, fixes.apply_fixes,
                                structure.unbounded_recursion_findings, structure.mutable_default_findings])
def test_row_local_operators_do_not_shuffle(stored, op):
    assert "Exchange" not in plan(op(stored))


def test_each_rule_is_matched_once(stored):
    """No optimizer rule may copy the scan: 51 whole-text tests, 3 relaxed ones, 51 line tests and
    one line-break test per pack."""
    assert optimized(scan.line_findings(stored)).count("RLIKE(") == 109
    assert optimized(scan.doc_rule_hits(stored)).count("RLIKE(") == 51


def test_findings_and_summaries_read_the_table_once(stored):
    assert plan(scoring.all_findings(stored)).count("Scan parquet") == 1
    assert plan(fixes.fix_summary(stored)).count("Scan parquet") == 1


def test_linter_join_moves_slim_rows(spark, stored):
    log = spark.createDataFrame([(1, 1, "x")], "doc_id bigint, seq int, line string")
    text = optimized(scoring.base_score(stored, log))
    left = text[text.index("Join LeftOuter"):].split("\n")[1]
    assert "code" not in left.split("AS lost")[-1] and left.count(" AS ") == 1


def test_newest_rows_are_limited_before_the_shuffle(stored):
    text = plan(history.recent_history(stored))
    before = text.split("Exchange")[-1]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_split_moves_no_rows(stored):
    """The limits, one row per label, come to the rows."""
    text = plan(corpus.stratified_split(stored))
    assert "hashpartitioning" not in text and text.count("BroadcastHashJoin") >= 1


def test_small_inputs_are_spread_and_large_ones_are_not(spark, sf_dir, monkeypatch):
    events = I.table(spark, sf_dir, "events").select("event_id")
    assert "Exchange" in plan(spread(events, "event_id"))
    monkeypatch.setattr("codegauge.session.SPLIT_BYTES", 1)
    assert "Exchange" not in plan(spread(events, "event_id"))


def test_scratch_space_follows_the_session(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(shared_root(spark))
    cluster = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared/space/"}, sparkContext=SimpleNamespace(master="yarn"))
    assert scratch_path(cluster, "x").startswith("/shared/space/x-")
    with pytest.raises(ValueError):
        shared_root(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn")))
