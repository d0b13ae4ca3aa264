"""Derived inputs: snippets over events, a labelled corpus over customers, logs over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codegauge.session import spread
from codegauge.sources import dims
from workload.templates import TEMPLATES, rows

_TEMPLATE_SCHEMA = ("tid bigint, lang string, has_bug int, bug_type string, body string, "
                    "corrected string, description string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def templates(spark: SparkSession) -> DataFrame:
    """A fixed list of templates: safe to broadcast whatever the tables hold."""
    return F.broadcast(dims.fixed_table(spark, rows(), _TEMPLATE_SCHEMA))


def snippets_of(events: DataFrame) -> DataFrame:
    """Events (batch or stream) turned into snippets."""
    spark = events.sparkSession
    k = F.regexp_extract("props", r'"k": (\d+)', 1)
    joined = events.withColumn("k", k).withColumn("tid", F.col("event_id") % len(TEMPLATES)).join(
        templates(spark), "tid")
    return joined.select(
        F.col("event_id").alias("doc_id"), "user_id", "ts", "lang", "has_bug", "bug_type",
        F.replace("corrected", F.lit("{k}"), F.col("k")).alias("corrected_code"),
        F.replace("body", F.lit("{k}"), F.col("k")).alias("code"), "description")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "props")
    return snippets_of(spread(events, "event_id"))


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six corpus columns plus row_no; codes repeat under different corrections."""
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    k = F.col("c_nationkey").cast("string")
    joined = customers.withColumn("tid", F.col("c_custkey") % len(TEMPLATES)).join(templates(spark), "tid")
    fixed = F.when(F.col("corrected") == "", "").otherwise(F.concat(
        F.replace("corrected", F.lit("{k}"), k), F.lit(" # "), F.col("c_custkey").cast("string")))
    return joined.select(
        F.col("c_custkey").cast("bigint").alias("row_no"),
        F.replace("body", F.lit("{k}"), k).alias("code"), F.col("lang").alias("language"), "bug_type", "has_bug",
        fixed.alias("corrected_code"), "description")


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every script of every page, keyed by page and place; a page without one has an empty script."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", F.posexplode(F.when(F.size(scripts) > 0, scripts).otherwise(F.array(F.lit("")))).alias("n", "code")) \
        .select(F.concat_ws("-", "page_id", "n").alias("doc_id"), F.lit("javascript").alias("lang"), "code")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural text as (doc_id, code, lang): input of the text metrics and n-grams."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    return docs.select("doc_id", F.col("text").alias("code"), "lang")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model reply, whole and partly fenced; every fifth has a reply of better rank that is too short."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").withColumn(
        "n", F.col("conv_id") + F.col("turn"))
    short = turns.filter("n % 5 = 0").withColumn("text", F.concat(F.lit(" no: "), F.col("n").cast("string")))
    turns = turns.withColumn("place", F.lit(1)).unionByName(short.withColumn("place", F.lit(0)))
    rank = F.floor(F.col("turn") / 2).cast("int")
    text = F.when((F.col("n") % 3 == 0) & (F.col("place") == 1), F.concat(
        F.lit("```python\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    tokens = F.floor(F.length("text") / 4).cast("int")
    limits = F.broadcast(dims.model_limits_df(spark).select("rank", "model"))
    return turns.select(
        F.col("conv_id").alias("request_id"), rank.alias("rank"), "place", text.alias("result"),
        (tokens * 3).alias("prompt_tokens"), tokens.alias("output_tokens"), (tokens * 4).alias("total_tokens"),
    ).join(limits, "rank", "left").select(
        "request_id", (F.col("rank") * 2 + F.col("place")).alias("rank"), F.coalesce("model", F.lit("other-model")).alias("model"), "result",
        "prompt_tokens", "output_tokens", "total_tokens")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id")).distinct()


def lint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """14 linter lines per snippet, every third without a position."""
    docs = snippets(spark, sf_dir).select("doc_id")
    seqs = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("seq"))
    n = (F.col("doc_id") + F.col("seq"))
    line = F.when(n % 3 == 0, F.concat(F.lit("************* Module a"), F.col("seq").cast("string"))).otherwise(
        F.concat(F.lit("tmp/a.py:"), F.col("seq").cast("string"), F.lit(":0: W0"),
                 (n % 900 + 100).cast("string"), F.lit(": text "), F.col("doc_id").cast("string")))
    return seqs.select("doc_id", "seq", line.alias("line"))
