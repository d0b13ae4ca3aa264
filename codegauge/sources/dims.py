"""Fixed dimension tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codegauge.functions.rulebook import RULES

# Models by priority with their context window.
MODEL_LIMITS = [
    ("llama-3.3-70b-versatile", 128000),
    ("llama3-70b-8192", 8192),
    ("mixtral-8x7b-32768", 32768),
    ("gemma2-9b-it", 8192),
]


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table as a local relation: the JVM holds it, no Python task reads it."""
    names = [part.split()[0] for part in schema.split(",")]
    table = pa.table({name: [row[i] for row in rows] for i, name in enumerate(names)})
    return spark.createDataFrame(table, schema)


def rules_df(spark: SparkSession) -> DataFrame:
    return fixed_table(
        spark, [(r.rule_id, r.lang, r.ord, r.pattern, r.severity, r.message) for r in RULES],
        "rule_id string, lang string, ord int, pattern string, severity int, message string")


def model_limits_df(spark: SparkSession) -> DataFrame:
    return fixed_table(
        spark, [(rank, model, limit) for rank, (model, limit) in enumerate(MODEL_LIMITS)],
        "rank int, model string, limit_tokens int")
