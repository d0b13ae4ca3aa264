"""Newest entries per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codegauge.functions import text as T


def newest(df: DataFrame, n: int) -> DataFrame:
    """The newest n rows per user by (ts, doc_id), with `pos` from 1.

    The limit is a row_number filter: every task keeps at most n rows per user before the
    shuffle, so a user with a third of all rows sends n rows per task.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("doc_id"))
    return df.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)


def recent_history(df: DataFrame, n: int = 20) -> DataFrame:
    """(user_id, pos, doc_id, ts, lang, code): code cut to its first 120 characters.

    The cut happens before the shuffle.
    """
    cut = df.select("user_id", "doc_id", "ts", "lang", T.history_preview(F.col("code")).alias("code"))
    return newest(cut, n).select("user_id", "pos", "doc_id", "ts", "lang", "code")


def recent_outputs(df: DataFrame, n: int = 6) -> DataFrame:
    """(user_id, pos, doc_id, prompt): prompt cut to 40 characters and an ellipsis."""
    cut = df.select("user_id", "doc_id", "ts", T.prompt_preview(F.col("prompt")).alias("prompt"))
    return newest(cut, n).select("user_id", "pos", "doc_id", "prompt")
