"""Request checks, prompt building and logs of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codegauge.functions import replies as R, text as T
from codegauge.sources.dims import model_limits_df

# Error labels of rejected requests.
NO_PROMPT, NO_CODE, SAME_LANG = "No prompt provided", "No code provided", "Same source and target language"

COUNTERS = ["prompt_tokens", "output_tokens", "total_tokens"]

# Prompt wording per task; {lang}, {to_lang}, {prompt} and {code} are filled from the row.
PROMPTS = {
    "review": ("You review {lang} code with care.",
               "List each fault of this {lang} code with its line and a remedy.\n\n{code}"),
    "fix": ("You repair {lang} code and answer with code only.",
            "Repair every fault of this {lang} code.\n\n{code}"),
    "convert": ("You translate {lang} code into {to_lang} and answer with code only.",
                "Translate this {lang} code into {to_lang}.\n\n{code}"),
    "modify": ("You change given code as told and answer with code only.",
               "Change the code as follows: {prompt}\n\n{code}"),
    "generate": ("You write code on request and answer with code only.",
                 "Write code for this request: {prompt}"),
}


def request_error(task: Column, prompt: Column, code: Column, lang: Column, to_lang: Column) -> Column:
    """NULL for a valid request, else its error label."""
    assistant = task == "assistant"
    no_code = T.is_blank(F.coalesce(code, F.lit("")))
    return (F.when(assistant & T.is_blank(F.coalesce(prompt, F.lit(""))), NO_PROMPT)
            .when(~assistant & no_code, NO_CODE)
            .when((task == "convert") & (lang == to_lang), SAME_LANG))


def validate_request(df: DataFrame) -> DataFrame:
    """Adds `error`; valid rows have NULL there."""
    return df.withColumn("error", request_error(*[F.col(c) for c in ("task", "prompt", "code", "lang", "to_lang")]))


def _fill(template: str) -> Column:
    """A template as one concatenation; a placeholder becomes its column."""
    parts: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            parts.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            parts.append(F.lit(rest[:start]))
        parts.append(F.coalesce(F.col(rest[start + 1:end]), F.lit("")))
        rest = rest[end + 1:]
    return F.concat(*parts)


def build_prompts(df: DataFrame) -> DataFrame:
    """Adds `kind`, `system` and `user`; an assistant request with code is a modification."""
    kind = F.when(F.col("task") != "assistant", F.col("task")).when(
        T.is_blank(F.coalesce("code", F.lit(""))), "generate").otherwise("modify")
    rows = df.withColumn("kind", kind)
    for i, name in enumerate(("system", "user")):
        value = None
        for task, texts in PROMPTS.items():
            cond, text = F.col("kind") == task, _fill(texts[i])
            value = F.when(cond, text) if value is None else value.when(cond, text)
        rows = rows.withColumn(name, value)
    return rows


def accept_response(responses: DataFrame) -> DataFrame:
    return responses.filter(R.accepted(F.col("result"))).withColumn("result", T.strip(F.col("result")))


def with_usage(df: DataFrame) -> DataFrame:
    """Adds limit, limit_pct, band and bar. The limit table is a fixed list, so it is broadcast."""
    limits = F.broadcast(model_limits_df(df.sparkSession).select("model", F.col("limit_tokens").alias("_limit")))
    joined = df.join(limits, "model", "left")
    limit = F.when(F.col("model") == "", 0).otherwise(F.coalesce("_limit", F.lit(R.DEFAULT_LIMIT)))
    rows = joined.withColumn("limit", limit.cast("int")).drop("_limit").withColumn(
        "limit_pct", R.usage_pct(F.col("total_tokens"), F.col("limit")))
    return rows.withColumn("band", R.usage_band(F.col("limit_pct"))).withColumn(
        "bar", R.usage_bar(F.col("limit_pct")))


def first_success(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per request: its accepted reply of best rank, or empty text and zero counters."""
    best = Window.partitionBy("request_id").orderBy("rank")
    won = accept_response(responses).withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    joined = requests.select("request_id").join(
        won.select("request_id", "model", "result", *COUNTERS), "request_id", "left")
    return joined.select(
        "request_id", F.coalesce("model", F.lit("")).alias("model"),
        F.coalesce("result", F.lit("")).alias("result"),
        *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in COUNTERS])


def usage_by_model(responses: DataFrame) -> DataFrame:
    """Calls, failures, token totals, mean usage and share over 80 % per model."""
    rows = with_usage(responses).withColumn("ok", R.accepted(F.col("result")))
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"),
        *[F.sum(c).cast("bigint").alias(c) for c in COUNTERS],
        F.round(F.avg("limit_pct"), 6).alias("mean_pct"),
        F.round(F.avg((F.col("limit_pct") >= R.WARN_PCT).cast("int")), 6).alias("share_near_limit"))


def fallback_to_rules(results: DataFrame, reviews: DataFrame, repairs: DataFrame) -> DataFrame:
    """(doc_id, review, fixed): a model's accepted review and repair, else the rule results. A blank snippet,
    whose rule report is empty, has empty ones.

    `results` has doc_id, old_line, full_code; the reply tables have request_id and result
    (empty when every model failed).
    """
    seen = reviews.filter("result <> ''").select(F.col("request_id").alias("doc_id"), F.col("result").alias("review"))
    mended = repairs.filter("result <> ''").select(
        F.col("request_id").alias("doc_id"), R.strip_fence_edges(F.col("result")).alias("repair"))
    return results.join(seen, "doc_id", "left").join(mended, "doc_id", "left").select(
        "doc_id", F.when(F.col("old_line") == "", "").otherwise(F.coalesce("review", "old_line")).alias("review"),
        F.when(F.col("old_line") == "", "").otherwise(F.coalesce("repair", "full_code")).alias("fixed"))
