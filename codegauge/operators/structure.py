"""Structure findings of Python snippets and the linter log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codegauge.functions import structure as X, text as T

LINT_CAP = 10

MUTABLE_TEXT = "mutable default value; use None and build it inside"
RECURSION_TEXT = "calls itself without an if that stops it"
ZERO_TEXT = "division by the constant zero"

def structure_facts(code: str = "code", lang: str = "lang") -> Column:
    """STRUCT<mutable, recursive, zero_divs>; only Python has them.

    Each check is guarded by a necessary condition on the raw text, so most text skips the work.
    """
    skel = X.skeleton(code)
    none = f"CAST(array() AS {X.NAMES_TYPE})"

    def checked(condition: str, value: str, otherwise: str) -> str:
        return f"if({lang} = 'python' AND {condition}, {value}, {otherwise})"

    return F.expr(
        f"named_struct('mutable', {checked(X.may_have_mutable(code), X.mutable_defaults(skel), none)}, "
        f"'recursive', {checked(X.may_recurse(code), X.unguarded_recursion(skel), none)}, "
        f"'zero_divs', {checked(X.may_divide(code), X.zero_divisions(skel), '0')})")


def structure_count(facts: Column) -> Column:
    return F.size(facts["mutable"]) + F.size(facts["recursive"]) + facts["zero_divs"]


def structure_messages(facts: Column) -> Column:
    """ARRAY<STRING>: one text per finding."""
    def named(names: Column, text: str) -> Column:
        return F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit(f"': {text}")))

    return F.concat(named(facts["mutable"], MUTABLE_TEXT), named(facts["recursive"], RECURSION_TEXT),
                    F.array_repeat(F.lit(ZERO_TEXT), facts["zero_divs"]))


def with_structure(df: DataFrame) -> DataFrame:
    return df.withColumn("structure", structure_facts())


def mutable_default_findings(df: DataFrame) -> DataFrame:
    return with_structure(df.select("doc_id", "lang", "code")).select(
        "doc_id", F.explode_outer("structure.mutable").alias("function_name")).filter("function_name is not null")


def unbounded_recursion_findings(df: DataFrame) -> DataFrame:
    return with_structure(df.select("doc_id", "lang", "code")).select(
        "doc_id", F.explode_outer("structure.recursive").alias("function_name")).filter("function_name is not null")


def literal_zero_division_findings(df: DataFrame) -> DataFrame:
    """(doc_id, occurrence): one row per division, numbered from 1."""
    numbers = F.when(F.col("structure.zero_divs") > 0, F.sequence(F.lit(1), F.col("structure.zero_divs")))
    return with_structure(df.select("doc_id", "lang", "code")).select(
        "doc_id", F.explode_outer(numbers).alias("occurrence")).filter("occurrence is not null")


def lint_log_findings(log: DataFrame) -> DataFrame:
    """(doc_id, pos, text): the first 10 positioned linter lines of a document, rewritten.

    The cap is a row_number filter, so each task keeps at most 10 rows per document before the
    shuffle: a document with a very long log does not travel.
    """
    positioned = log.filter(F.col("line").rlike(r":\d+:\d+:"))
    ranked = positioned.withColumn(
        "pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")))
    return ranked.filter(F.col("pos") <= LINT_CAP).select(
        "doc_id", "pos",
        F.regexp_replace("line", T.rx(r".+\.py:(\d+):\d+: [A-Z]\d+: "), "Line $1: ").alias("text"))


def lint_by_doc(log: DataFrame) -> DataFrame:
    """(doc_id, lint): the linter texts of a document, at most 10."""
    rows = lint_log_findings(log)
    return rows.groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("lint"))
