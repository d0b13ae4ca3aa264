"""Dashboards over many documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codegauge.operators import scan


def report_by_lang(results: DataFrame) -> DataFrame:
    """Documents, mean score and severity totals per language; summed map-side, one row per language moves."""
    return results.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.sum("critical_count").cast("bigint").alias("critical"),
        F.sum("optims_count").cast("bigint").alias("optims"),
        F.sum("security_count").cast("bigint").alias("security"))


def report_by_rule(df: DataFrame) -> DataFrame:
    """Documents each rule hits."""
    return scan.doc_rule_hits(df).groupBy("lang", "rule_id").agg(F.count(F.lit(1)).alias("docs"))
