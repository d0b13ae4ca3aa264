"""Preparing the labelled corpus: expansion, blank rows, summary, stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codegauge.functions import text as T
from codegauge.session import scratch_path
from codegauge.sources.corpus import CORPUS_COLUMNS

#: What row numbers of added rows start from, so that they follow all existing ones.
ADDED_FROM = 1 << 48


def expand_corpus(existing: DataFrame, extra: DataFrame, order_col: str = "row_no") -> DataFrame:
    """Existing rows as they are, plus extra rows with codes not seen before (first one wins).

    The first row per code is a row_number() = 1 filter, applied in every task before the
    shuffle, and the known codes are made distinct first: a code that fills a third of either
    side shuffles as one row per task.
    """
    return existing.select(*CORPUS_COLUMNS).unionByName(_added(existing, extra, order_col).select(*CORPUS_COLUMNS))


def expand_ordered(existing: DataFrame, extra: DataFrame, order_col: str = "row_no") -> DataFrame:
    """The same with row numbers: added rows keep their order and come behind all existing ones."""
    number = (F.col(order_col) + F.lit(ADDED_FROM)).alias("row_no")
    return existing.select(F.col(order_col).alias("row_no"), *CORPUS_COLUMNS).unionByName(
        _added(existing, extra, order_col).select(number, *CORPUS_COLUMNS))


def _added(existing: DataFrame, extra: DataFrame, order_col: str) -> DataFrame:
    """Codes are told apart by a hash: a join needs no text of the existing rows."""
    code = F.sha2(F.col("code"), 256)
    first = Window.partitionBy("_hash").orderBy(order_col)
    fresh = extra.withColumn("_hash", code).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return fresh.join(existing.select(code.alias("_hash")).distinct(), "_hash", "left_anti").drop("_hash")


def flag_blank(df: DataFrame) -> DataFrame:
    return df.withColumn("is_blank", T.is_blank(F.col("code")))


def non_blank(df: DataFrame) -> DataFrame:
    return df.filter(~T.is_blank(F.col("code")))


def corpus_summary(df: DataFrame) -> DataFrame:
    bug = F.col("has_bug") != 0
    return df.agg(F.count(F.lit(1)).alias("samples"), F.count_if(bug).alias("bugs"),
                  F.count_if(~bug).alias("clean"))


def _split_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_split(df: DataFrame, fraction: float = 0.2, seed: int = 42,
                     id_col: str = "doc_id", label_col: str = "has_bug") -> DataFrame:
    """Adds `is_test`: per label, exactly round(fraction * n) rows with the least seeded hash.

    No row is ranked against its whole label. The hash space is counted in 65,536 buckets, the
    bucket holding the limit is found from those counts, and only that bucket is ranked. The
    limits, one key per label, are a table joined to the rows; any number of labels may occur.
    """
    key = _split_key(id_col, seed)
    keyed = df.select(F.col(label_col).alias("label"), F.col(id_col).alias("id"), key.alias("key"))
    bucketed = keyed.withColumn("bucket", F.substring("key", 1, 4))
    counts = bucketed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    per_label = Window.partitionBy("label")
    upto = per_label.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (  # the bucket of each label that holds its limit, and the limit's rank in it
        counts.withColumn("cum", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(per_label))
        .withColumn("want", F.floor(F.col("total") * fraction + 0.5))
        .filter((F.col("cum") >= F.col("want")) & (F.col("cum") - F.col("n") < F.col("want")))
        .select("label", "bucket", (F.col("want") - (F.col("cum") - F.col("n"))).alias("rank"))
    )
    cuts = _kept(cuts, "split-cuts").withColumnsRenamed({"label": "cut_label", "bucket": "cut_bucket"})
    in_bucket = Window.partitionBy("label").orderBy("key", "id")
    limits = _kept(
        bucketed.join(cuts, F.col("label").eqNullSafe(F.col("cut_label")) & (F.col("bucket") == F.col("cut_bucket")))
        .withColumn("n", F.row_number().over(in_bucket)).filter("n = rank")
        .select(F.struct(F.col("label"), F.col("key"), F.col("id")).alias("_limit")), "split-limits")
    below = (key < F.col("_limit.key")) | ((key == F.col("_limit.key")) & (F.col(id_col) <= F.col("_limit.id")))
    return df.join(limits, F.col(label_col).eqNullSafe(F.col("_limit.label")) & F.col("_limit").isNotNull(), "left") \
        .withColumn("is_test", F.coalesce(below, F.lit(False))).drop("_limit")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A table of one row per label, written so that joins know its true size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
