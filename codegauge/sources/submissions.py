"""Submitted snippets, batch or streaming, with the form defaults filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codegauge.functions import lang as L

SUBMISSION_SCHEMA = "doc_id bigint, user_id bigint, ts timestamp_ntz, lang string, code string"


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing code is empty text, a missing language is python."""
    return df.withColumn("code", F.coalesce("code", F.lit(""))).withColumn(
        "lang", F.coalesce("lang", F.lit(L.DEFAULT_LANG)))


def read_submissions(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False,
                     schema: str = SUBMISSION_SCHEMA, max_files: int | None = None) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(schema)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return with_defaults(reader.format(fmt).load(path))
