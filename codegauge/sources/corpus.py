"""The labelled corpus as CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# The columns of a corpus file, in order.
CORPUS_COLUMNS = ["code", "language", "bug_type", "has_bug", "corrected_code", "description"]
CORPUS_SCHEMA = ("code string, language string, bug_type string, has_bug int, "
                 "corrected_code string, description string")
_CSV = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_corpus(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Quoted multi-line CSV, or Parquet. Missing cells of a CSV read as empty text.

    Quoted line breaks keep a CSV file from being split: one task per file. Large corpora
    should be many files, or converted once with `write_corpus(..., fmt="parquet")`.
    """
    return _raw_corpus(spark, path, fmt).select(*CORPUS_COLUMNS)


def _raw_corpus(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(CORPUS_SCHEMA).parquet(path)
    raw = (spark.read.schema(CORPUS_SCHEMA).options(**_CSV)
           .option("multiLine", "true")
           .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
           .option("lineSep", "\n").csv(path))
    texts = [c for c in CORPUS_COLUMNS if c != "has_bug"]
    return raw.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def read_ordered_corpus(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The corpus with `row_no` from 1: files in the order of their paths, rows as they stand in them.

    A task reads stretches of files from front to back, so a row's running number less the first one of its stretch
    is its place there; the stretches' sizes, summed up in order of path and offset, give the rest. Nothing is sorted but one
    row per stretch, and the numbers do not depend on how stretches are dealt to tasks.
    """
    rows = _raw_corpus(spark, path, fmt).select(
        *CORPUS_COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).select(
        "_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(stretches, ["_file", "_start"]).select(
        (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("row_no"), *CORPUS_COLUMNS)


def write_corpus(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Full write with the fixed columns. Give a path other than the one `df` reads."""
    writer = df.select(*CORPUS_COLUMNS).write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    else:
        (writer.options(**_CSV).option("quoteAll", "true").option("lineSep", "\n")
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
