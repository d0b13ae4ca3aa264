import pytest
from pyspark.sql import functions as F

from codegauge.functions import score as S
from codegauge.functions.literals import needed_literals
from codegauge.functions.rulebook import PENALTY, RULES, Rule, text_precondition
from codegauge.operators import scan, scoring
from codegauge.plans.analyze import analyze_corpus
from codegauge.sources.dims import rules_df
from helpers import hits, owners, texts
from workload.templates import TEMPLATES

LANGS = ("python", "java", "javascript", "c", "ruby")


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, lang, code) for i, (lang, code) in enumerate(
        (lang, code) for lang in LANGS for code in texts(400, len(lang)))]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, code string").repartition(4).persist()
    return {r[0]: r for r in rows}, df


def test_whole_text_hits_match_python(corpus):
    rows, df = corpus
    got = {}
    for r in scan.doc_rule_hits(df).collect():
        got.setdefault(r.doc_id, []).append(r.rule_id)
    for i, (_, lang, code) in rows.items():
        assert sorted(got.get(i, [])) == sorted(hits(code, lang)), repr(code)


def expected_lines(rows):
    return {(i, n, rule, line) for i, (_, lang, code) in rows.items() for n, rule, line in owners(code, lang)}


def test_first_rule_owns_the_line(corpus):
    rows, df = corpus
    got = [(r.doc_id, r.line_no, r.rule_id, r.line) for r in scan.line_findings(df).collect()]
    assert len(got) == len({g[:2] for g in got})
    assert set(got) == expected_lines(rows)


@pytest.mark.parametrize("block_bytes", [scan.RULE_BLOCK_BYTES, 900])
def test_rule_table_gives_the_same_findings(spark, corpus, block_bytes):
    rows, df = corpus
    found = scan.line_findings_from_table(df, rules_df(spark), block_bytes)
    assert {(r.doc_id, r.line_no, r.rule_id, r.line) for r in found.collect()} == expected_lines(rows)


def test_needed_literals():
    want = {r"\bgets\s*\(": ["gets"], r"==\s*NULL|NULL\s*==": ["NULL"], r"(?:foo|bar)+x?": ["bar", "foo"], r"a{0,3}": None,
            r"(?i)eval": None, r"[ab]c": ["c"], r"x*(ab|c)(?=zzz)": ["ab", "c"], r"a.bc": ["bc"], r"(?:a|b*)": None, r"\d+": None, r"^abc$": ["abc"],
            r"(?i:q)rest": ["rest"]}
    assert {p: needed_literals(p) for p in want} == {p: w if w is None else sorted(w, key=str) for p, w in want.items()}


@pytest.mark.parametrize("n", [100, 5000])
def test_table_packs_of_any_size_share_one_plan(spark, n):
    rows = [(f"r{i:04d}", "python", i // 2, rf"\bname{i}\b" if i % 3 else rf"(?i)NAME{i}(?!\d)", 1, "m") for i in range(n)]
    rules = spark.createDataFrame(rows, "rule_id string, lang string, ord int, pattern string, severity int, message string")
    code = "\n".join(f"x = name{i}, name{n - 1 - i}" for i in range(0, n, 97)) + "\n name0 "
    df = spark.createDataFrame([(1, "python", code), (2, "python", None), (3, None, "name1"), (4, "go", "name1")],
                               "doc_id bigint, lang string, code string")
    found = scan.line_findings_from_table(df, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
    want = [(k + 1, f"r{min(i, n - 1 - i):04d}") for k, i in enumerate(range(0, n, 97))]
    want.append((len(want) + 1, "r0000"))
    assert sorted((r.line_no, r.rule_id) for r in found.collect()) == want


def test_pack_wider_than_a_word_goes_through_the_whole_chain(spark):
    rules = [Rule(f"r{i}", "python", i, rf"\bname{i}\b", 1 + i % 3, "m") for i in range(100)]
    df = spark.createDataFrame([(1, "python", "x\nname7 name99\nname99"), (2, "python", "name98\n"), (3, "python", "name"), (4, "c", "name1")],
                               "doc_id bigint, lang string, code string")
    got = {(r.doc_id, r.line_no, r.rule_id) for r in scan.line_findings(df, rules).collect()}
    assert got == {(1, 2, "r7"), (1, 3, "r99"), (2, 1, "r98")}
    assert {(r.doc_id, r.rule_id) for r in scan.doc_rule_hits(df, rules).collect()} == {(1, "r7"), (1, "r99"), (2, "r98")}
    assert {r.doc_id: r.base_score for r in scoring.base_score(df, rules=rules).collect()} == {1: 100 - 12 - 5, 2: 100 - 22, 3: 100, 4: 100}
    assert {r.doc_id: (r.critical, r.optims) for r in scoring.severity_counts(df, rules=rules).collect()} == \
        {1: (0, 2), 2: (1, 0), 3: (0, 0), 4: (0, 0)}
    whole = {r.doc_id: r for r in analyze_corpus(df, rules=rules).collect()}
    assert [whole[i].score for i in (1, 2, 3, 4)] == [83, 78, 100, 100]
    assert whole[1].old_line.startswith(f"{S.YELLOW} Line   2:  name7 name99")


def test_report_lists_rules_then_lines(corpus):
    rows, df = corpus
    icons = {3: S.RED, 2: S.YELLOW, 1: S.BLUE}
    by_id = {r.rule_id: r for r in RULES}
    got = {r.doc_id: r.report for r in scan.fault_report(df).collect()}
    for i, (_, lang, code) in rows.items():
        found = sorted((by_id[rule].ord, n, by_id[rule], line) for n, rule, line in owners(code, lang))
        want = "\n".join(f"{icons[r.severity]} Line {n:>3}:  {line}\n           =>  {r.message}"
                         for _, n, r, line in found) or S.CLEAN_REPORT
        assert got[i] == want


def test_line_numbers_beyond_three_digits(spark):
    df = spark.createDataFrame([(1, "python", "x\n" * 1233 + "eval(x)")], "doc_id bigint, lang string, code string")
    assert scan.fault_report(df).first().report.startswith(f"{S.RED} Line 1234:  eval(x)\n")


def test_base_score_counts_each_rule_once(corpus):
    rows, df = corpus
    by_id = {r.rule_id: r for r in RULES}
    other = df.filter("lang <> 'python'")
    for r in scoring.base_score(other).collect():
        _, lang, code = rows[r.doc_id]
        lost = sum(PENALTY[by_id[h].severity] for h in hits(code, lang))
        assert r.base_score == max(0, min(100, 100 - lost))


def test_template_scores(spark):
    """The worked examples: score after structure checks, blank text is zero."""
    want = [88, 100, 85, 73, 78, 88, 80, 90, 85, 78, 100, 68, 100, 83, 17, 0]
    df = spark.createDataFrame(
        [(i, t[0], t[3].replace("{k}", "7")) for i, t in enumerate(TEMPLATES[:16])],
        "doc_id bigint, lang string, code string")
    got = {r.doc_id: r for r in analyze_corpus(df).collect()}
    assert [got[i].score for i in range(16)] == want
    blank = got[15]
    assert (blank.confidence, blank.msg, blank.old_line, blank.full_code, blank.lines, blank.chars) == (
        "0%", S.PROMPT_MESSAGE, "", "", 0, 0)


def test_look_ahead_sees_the_next_line_only_in_whole_text(spark):
    df = spark.createDataFrame([(1, "c", "p = malloc(n);\nif (!p) return;")], "doc_id bigint, lang string, code string")
    assert [r.rule_id for r in scan.line_findings(df).collect()] == ["c05"]
    assert scan.doc_rule_hits(df).count() == 0


def test_text_precondition_is_conservative():
    assert text_precondition(r"open\s*\([^)]+\)(?!\s*as)") == r"open\s*\([^)]+\)"
    for unsafe in (r"^x", r"x$", r"(?<=a)b", r"(?!a)b", r"\Ax", r"(?i)x"):
        assert text_precondition(unsafe) is None
    assert text_precondition(r"a\$b[^x]") == r"a\$b[^x]"


def test_bands_and_blend(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1, 29, 30, 50, 70, 85, 95, 100)], "s int")
    rows = df.select("s", S.score_message(F.col("s")).alias("m"), S.health_band(F.col("s")).alias("h"),
                     S.file_health_band(F.col("s")).alias("f")).collect()
    assert len({r.m for r in rows}) == 7
    assert [r.h for r in rows] == ["none", "Critical", "Critical", "Critical", "Needs Work", "Needs Work",
                                   "Good Stand", "Good Stand", "Good Stand"]
    assert rows[0].f == "Critical"
    cases = spark.createDataFrame([(90, 0.25), (90, None), (0, 1.0), (100, 0.0), (51, 0.999)], "b int, p double")
    got = [r[0] for r in cases.select(S.blend(F.col("b"), F.col("p"))).collect()]
    assert got == [82, 90, 0, 100, 25]


def test_icons_and_security_words_are_counted_in_the_text(spark):
    df = spark.createDataFrame(
        [(1, "python", "s = eval('🔴 sql')\nprint('xss')\nsource = exec(x)")], "doc_id bigint, lang string, code string")
    r = analyze_corpus(df).first()
    assert (r.critical_count, r.optims_count, r.security_count) == (3, 1, 2)


def test_linter_lines_lower_python_scores_only(spark):
    df = spark.createDataFrame([(1, "python", "x"), (2, "java", "x"), (3, "python", "x")],
                               "doc_id bigint, lang string, code string")
    log = spark.createDataFrame(
        [(d, s, f"/tmp/a.py:{s}:0: W0102: text") for d in (1, 2) for s in range(12)] + [(1, 99, "no position")],
        "doc_id bigint, seq int, line string")
    got = {r.doc_id: r for r in analyze_corpus(df, log).collect()}
    assert [got[i].score for i in (1, 2, 3)] == [70, 100, 100]
    assert got[1].old_line.splitlines()[0] == f"{S.YELLOW} PYLINT:  Line 0: text"
    assert len(got[1].old_line.splitlines()) == 10
    assert scoring.all_findings(df, log).filter("source = 3").count() == 10


def test_a_batch_is_scanned_in_pieces_of_bounded_text(spark, monkeypatch):
    monkeypatch.setattr(scan, "SCAN_BYTES", 40)
    rules = spark.createDataFrame([("r", "en", 1, "word", 1, "m")], "rule_id string, lang string, ord int, pattern string, severity int, message string")
    rows = [(i, "en", f"line\nword {i}" if i % 3 else None) for i in range(60)] + [(60, None, "word"), (61, "en", "word " * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, code string").coalesce(1)
    got = [(r.doc_id, r.line_no) for r in scan.line_findings_from_table(df, rules).collect()]
    assert sorted(got) == [(i, 2) for i in range(60) if i % 3] + [(61, 1)]
