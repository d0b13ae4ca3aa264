"""Streams of submissions: stateless analysis and per-user history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from codegauge.operators.history import newest, recent_history
from codegauge.plans.analyze import analyze_corpus
from codegauge.streaming.versions import VersionedTable

BUCKETS = 64
HISTORY_SCHEMA = "user_id bigint, doc_id bigint, ts timestamp, lang string, code string"


def analyze_stream(submissions: DataFrame) -> DataFrame:
    """The flagship projection on a stream: no state, so append mode and no watermark."""
    return analyze_corpus(submissions)


def write_analysis(submissions: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = analyze_stream(submissions).writeStream.format("parquet").outputMode("append").option(
        "path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_recent_history(submissions: DataFrame, out: str, checkpoint: str, n: int = 20,
                         once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the newest n rows per user in a versioned table: every micro-batch merges its own newest n into the buckets of its users.

    Newest-n of newest-n is newest-n, so late rows fall into place and a batch is cut map-side, which a keyed state
    operator could not do: a very active user never gathers in one task. Only touched buckets are read and replaced, and
    what is stored does not grow with the number of batches. Choose more buckets for more users; it is fixed per table.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, out)
        manifest = table.manifest()
        if batch_id <= manifest.batch:  # committed before a restart
            return
        fresh = recent_history(batch, n).drop("pos").withColumn("bucket", _bucket(buckets)).persist()
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
        old = table.read(manifest, touched)
        rows = fresh if old is None else fresh.unionByName(old.withColumn("bucket", _bucket(buckets)))
        table.replace(newest(rows, n).drop("pos").repartition("bucket"), touched, batch_id, manifest)
        fresh.unpersist()

    writer = submissions.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def read_recent_history(spark: SparkSession, out: str, n: int = 20) -> DataFrame:
    """The stored history with positions; empty before the first commit."""
    table = VersionedTable(spark, out)
    rows = table.read(table.manifest())
    if rows is None:
        rows = spark.createDataFrame([], HISTORY_SCHEMA)
    return newest(rows, n).select("user_id", "pos", "doc_id", "ts", "lang", "code")
