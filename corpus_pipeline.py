"""Training-data pipeline: each stage reads what its predecessor kept and keeps whole documents, the last one encodes them.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet below the session's shared
folder and reads it again, so a stage never recomputes an earlier one.

Defined results: an empty `documents` table passes through as empty; null texts are kept by the filters (they score as an empty
window, have no shingle and no benchmark word) unless the classifiers reject the empty text; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codegauge.llm import compression, decontaminate, neardup, quality, sampling, toxicity
from codegauge.session import scratch_path

TOXIC_FROM = 0.5
GOOD_FROM = quality.THRESHOLD
#: Text that shares lattices: small, since workers still hold what earlier stages took.
SLICE_BYTES = 512 << 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    return compression.keep_rows(docs, toxicity.toxicity_model(docs, _table(spark, sf_dir, "labels")), most=TOXIC_FROM)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the quality threshold."""
    return compression.keep_rows(docs, quality.quality_model(docs, _table(spark, sf_dir, "labels")), least=GOOD_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 and more."""
    return neardup.keep_first(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document: doc_id, rank, ids, log_prob, log_inclusion, n_tokens."""
    return sampling.sample_segmentations(docs, slice_bytes=SLICE_BYTES).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("segmentation", encode),
]

#: Compression, sampling and hashing of shingles have no SQL form; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
