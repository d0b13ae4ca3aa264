"""Known corrections: exact lookup, most similar within a bug type, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codegauge.functions import text as T
from codegauge.operators.nearest import nearest

PREFIX = 50
#: Sizes of books, shelves and parts of the search, where they are not its own.
SIZES: dict[str, int] = {}
BLOCK = 65536


def corrections(corpus: DataFrame) -> DataFrame:
    """Bug rows with a correction."""
    return corpus.filter((F.col("has_bug") != 0) & ~T.is_blank(F.col("corrected_code")))


def _key(code: Column) -> Column:
    """What stands for the stripped text in shuffles and joins."""
    return F.sha2(T.strip(code), 256)


def _exact_keys(corr: DataFrame) -> DataFrame:
    return corr.groupBy(_key(F.col("code")).alias("key")).agg(
        F.max_by("corrected_code", "row_no").alias("exact_correction"))


def exact_lookup(snips: DataFrame, corr: DataFrame) -> DataFrame:
    """(doc_id, exact_correction): the last correction recorded for the same stripped code.

    The lookup side has one row per key, so a code shared by a third of all snippets is only
    heavy on the left, where adaptive skew joins may split it. No broadcast is forced.
    """
    return snips.select("doc_id", _key(F.col("code")).alias("key")).join(
        _exact_keys(corr), "key", "left").select("doc_id", "exact_correction")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def _matches(a: Column, b: Column) -> Column:
    """Equal characters at equal positions of two character arrays (the shorter one decides)."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda hit: hit))


def prefix_similarity(a: Column, b: Column) -> Column:
    return _matches(_chars(F.substring(a, 1, PREFIX)), _chars(F.substring(b, 1, PREFIX))).cast("int")


def _candidates(corr: DataFrame) -> DataFrame:
    """(bug_type, prefix, row_no): only the first row of equal prefixes can win."""
    return corr.groupBy("bug_type", F.substring("code", 1, PREFIX).alias("prefix")).agg(
        F.min("row_no").alias("row_no"))


def _complete_matches(cands: DataFrame) -> DataFrame:
    """(bug_type, head, hit): first candidate starting with each possible snippet head.

    A candidate that starts with the whole head reaches the highest similarity the snippet can
    have, so an equality join settles those snippets without looking at other candidates.
    """
    lengths = F.sequence(F.lit(0), F.length("prefix"))
    heads = F.transform(lengths, lambda n: F.substring(F.col("prefix"), F.lit(1), n))
    return cands.select("bug_type", "row_no", F.explode(heads).alias("head")).groupBy(
        "bug_type", "head").agg(F.min("row_no").alias("hit"))


def _closest(rest: DataFrame, cands: DataFrame) -> DataFrame:
    """(bug_type, head, row_no) for the heads no candidate starts with."""
    found = nearest(rest.select(F.col("bug_type").alias("kind"), F.col("head").alias("text")),
                    cands.select(F.col("bug_type").alias("kind"), F.col("prefix").alias("text"), "row_no"), PREFIX, **SIZES)
    return found.select(F.col("kind").alias("bug_type"), F.col("text").alias("head"), "row_no")


def _asked(snips: DataFrame) -> DataFrame:
    code = F.col("code")
    return snips.select("doc_id", "bug_type", _key(code).alias("key"), F.substring(T.strip(code), 1, PREFIX).alias("head"))


def _winners(snips: DataFrame, corr: DataFrame) -> DataFrame:
    """(bug_type, head, similar_correction): worked out once per distinct (type, head), not per snippet."""
    heads = _asked(snips).filter("bug_type <> ''").select("bug_type", "head").distinct()
    cands = _candidates(corr)
    tried = heads.join(_complete_matches(cands), ["bug_type", "head"], "left")
    settled = tried.filter("hit is not null").select("bug_type", "head", F.col("hit").alias("row_no"))
    rest = tried.filter("hit is null").select("bug_type", "head")
    return settled.unionByName(_closest(rest, cands)).join(
        corr.select("row_no", F.col("corrected_code").alias("similar_correction")), "row_no").drop("row_no")


def best_by_type(snips: DataFrame, corr: DataFrame) -> DataFrame:
    """(doc_id, similar_correction): the same-type correction with the most equal leading
    characters (first 50); ties go to the first row; NULL for an unknown or empty type."""
    return _asked(snips).select("doc_id", "bug_type", "head").join(
        _winners(snips, corr), ["bug_type", "head"], "left").select("doc_id", "similar_correction")


def suggest_correction(snips: DataFrame, corr: DataFrame) -> DataFrame:
    """(doc_id, suggestion): exact correction, else the most similar of the type, else NULL."""
    return _asked(snips).join(_exact_keys(corr), "key", "left").drop("key").join(
        _winners(snips, corr), ["bug_type", "head"], "left").select(
        "doc_id", F.coalesce("exact_correction", "similar_correction").alias("suggestion"))


def correction_stats(corr: DataFrame) -> DataFrame:
    return corr.agg(F.countDistinct(T.strip(F.col("code"))).alias("exact_entries"),
                    F.countDistinct("bug_type").alias("bug_categories"))


def corrections_by_type(corr: DataFrame) -> DataFrame:
    """(bug_type, position, code, corrected_code, description): each type's list as ordered rows.

    Positions come from counts per block of row numbers plus a rank inside the block, so a
    large type is never sorted in one task or gathered in one row.
    """
    blocks = corr.withColumn("block", F.floor(F.col("row_no") / BLOCK))
    before = Window.partitionBy("bug_type").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("bug_type", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "bug_type", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bug_type", "block").orderBy("row_no"))
    return blocks.withColumn("rank", inside).join(offsets, ["bug_type", "block"]).select(
        "bug_type", (F.col("offset") + F.col("rank")).alias("position"),
        "code", "corrected_code", "description")
