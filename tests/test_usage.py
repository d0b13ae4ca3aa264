from pyspark.sql import functions as F

from codegauge.functions import replies as R
from codegauge.operators import usage

LONG = "a reply that is long enough"


def test_fences(spark):
    edges = {"```python\n" + LONG + "\n```": LONG, "```\nshort\n```": None, LONG: LONG, f"x```{LONG}``` y": f"x```{LONG}``` y",
             f"```{LONG.split()[0]}\n{LONG}\n```\n": LONG, " " * 30: None}
    df = spark.createDataFrame([(t,) for t in edges], "t string")
    assert {r.t: r.o for r in df.select("t", R.strip_fence_edges(F.col("t")).alias("o")).collect()} == edges
    cases = [("```c\nint x;\n```", None, "c\nint x;"), ("```c\nint x;\n```", "c", "int x;"),
             ("```javascript\nlet x\n```", None, "script\nlet x"), ("```javascript\nlet x\n```", "javascript", "let x"),
             ("a ```go b``` ```ruby", "python", "a  b ruby")]
    df = spark.createDataFrame([(t, g) for t, g, _ in cases], "t string, g string")
    plain = [r[0] for r in df.select(R.strip_fences_all(F.col("t"))).collect()]
    aimed = [r[0] for r in df.select(R.strip_fences_all(F.col("t"), F.coalesce("g", F.lit("python")))).collect()]
    assert [a if g else p for p, a, (_, g, _) in zip(plain, aimed, cases)] == [w for _, _, w in cases]


def test_first_success_prefers_rank_among_accepted(spark):
    replies = spark.createDataFrame([
        (1, 0, "m0", "too short", 1, 1, 2), (1, 2, "m2", LONG + " two", 5, 5, 10), (1, 1, "m1", f"  {LONG}\n", 3, 4, 7),
        (2, 0, "m0", " " * 40, 1, 1, 2), (2, 1, "m1", None, 1, 1, 2)],
        "request_id bigint, rank int, model string, result string, prompt_tokens int, output_tokens int, total_tokens int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "request_id bigint")
    got = {r.request_id: tuple(r)[1:] for r in usage.first_success(asked, replies).collect()}
    assert got == {1: ("m1", LONG, 3, 4, 7), 2: ("", "", 0, 0, 0), 3: ("", "", 0, 0, 0)}


def test_usage_bands_and_limits(spark):
    rows = [("gemma2-9b-it", 6554), ("gemma2-9b-it", 4915), ("gemma2-9b-it", 4914), ("unlisted", 8192 * 2), ("", 0)]
    df = spark.createDataFrame(rows, "model string, total_tokens int")
    got = [(r.limit, r.limit_pct, r.band, r.bar) for r in usage.with_usage(df).orderBy("model", "total_tokens").collect()]
    assert got == [(0, 0.0, "green", 0.0), (8192, 60.0, "amber", 60.0), (8192, 60.0, "amber", 60.0),
                   (8192, 80.0, "red", 80.0), (8192, 200.0, "red", 100.0)]


def test_requests_are_checked_and_prompted(spark):
    rows = [(1, "assistant", "python", "go", " ", "x"), (2, "convert", "python", "go", None, " \n"),
            (3, "convert", "go", "go", None, "x"), (4, "convert", "python", "go", None, "x"),
            (5, "assistant", "python", "go", "do", ""), (6, "assistant", "python", "go", "do", "x"), (7, "review", "c", None, None, "y")]
    df = spark.createDataFrame(rows, "id int, task string, lang string, to_lang string, prompt string, code string")
    checked = usage.validate_request(df)
    assert [r.error for r in checked.orderBy("id").collect()] == [
        usage.NO_PROMPT, usage.NO_CODE, usage.SAME_LANG, None, None, None, None]
    got = {r.id: (r.kind, r.user) for r in usage.build_prompts(checked.filter("error is null")).collect()}
    assert [got[i][0] for i in (4, 5, 6, 7)] == ["convert", "generate", "modify", "review"]
    assert "python" in got[4][1] and "go" in got[4][1] and got[6][1].endswith("x") and "do" in got[5][1]


def test_rules_answer_where_no_model_did(spark):
    results = spark.createDataFrame([(1, "r1", "f1"), (2, "r2", "f2"), (3, "r3", "f3")],
                                    "doc_id bigint, old_line string, full_code string")
    reviews = spark.createDataFrame([(1, LONG), (2, "")], "request_id bigint, result string")
    repairs = spark.createDataFrame([(1, f"```py\n{LONG}\n```"), (3, "```\ntiny text in a fence\n```"[:20])],
                                    "request_id bigint, result string")
    got = {r.doc_id: (r.review, r.fixed) for r in usage.fallback_to_rules(results, reviews, repairs).collect()}
    assert got == {1: (LONG, LONG), 2: ("r2", "f2"), 3: ("r3", "f3")}


def test_usage_share_rounds_the_binary_value(spark):
    """As Python rounds: 0.05 is stored above one twentieth, 0.15 below three; a quarter is exact and goes to the even tenth."""
    rows = [(t, m) for m in (128000, 8192, 32768, 1000, 7, 400) for t in [*range(0, 700), 8191, 64000, 127999, 131072]]
    df = spark.createDataFrame(rows, "t int, m int").select("t", "m", R.usage_pct(F.col("t"), F.col("m")).alias("p"))
    for r in df.collect():
        assert r.p == round(r.t / r.m * 100, 1), (r.t, r.m)
    assert df.filter("t = 64 AND m = 128000").first().p == 0.1


def test_blank_snippets_keep_empty_results(spark):
    results = spark.createDataFrame([(1, "", ""), (2, "report", "code")], "doc_id bigint, old_line string, full_code string")
    replies = spark.createDataFrame([(1, "a reply"), (2, "another reply that is long")], "request_id bigint, result string")
    got = {r.doc_id: (r.review, r.fixed) for r in usage.fallback_to_rules(results, replies, replies).collect()}
    assert got == {1: ("", ""), 2: ("another reply that is long",) * 2}
