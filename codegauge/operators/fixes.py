"""Automatic fixes of snippets and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codegauge.functions import rewrite as R, text as T


def with_fixed(df: DataFrame) -> DataFrame:
    """Adds `fixed_code`; purely row-local.

    Each stage is a column of its own: the next one reads it several times, and Catalyst keeps
    such a column apart instead of evaluating the whole chain again.
    """
    python = F.col("lang") == "python"
    return (
        df.withColumn("_kept", R.fix_in_place(T.joined_lines(F.col("code")), F.col("lang")))
        .withColumn("_body", F.when(python, R.guard_defaults(F.col("_kept"))).otherwise(F.col("_kept")))
        .withColumn("fixed_code", F.when(python, R.add_imports(F.col("_body"))).otherwise(F.col("_body")))
        .drop("_kept", "_body")
    )


def apply_fixes(df: DataFrame) -> DataFrame:
    return with_fixed(df.select("doc_id", "lang", "code")).select("doc_id", "lang", "fixed_code")


def _changed_lines(before: Column, after: Column) -> Column:
    changed = F.size(F.filter(
        F.zip_with(F.split(before, "\n", -1), F.split(after, "\n", -1), lambda a, b: a != b), lambda x: x))
    return F.when(before == after, 0).otherwise(changed)


def _sub(pattern: str, to: str, any_case: bool = False):
    flags = T.FLAGS_ANYCASE if any_case else T.FLAGS
    return lambda text: F.regexp_replace(text, flags + pattern, to)


STEPS = {
    "python": [(n, _sub(p, t)) for n, p, t in R.PYTHON_REPLACEMENTS]
    + [(n, _sub(p, t, True)) for n, p, t in R.PYTHON_SECRETS] + [("add_self", R.add_self)],
    "javascript": [(n, _sub(p, t)) for n, p, t in R.JAVASCRIPT_REPLACEMENTS],
    "java": [(n, _sub(p, t)) for n, p, t in R.JAVA_REPLACEMENTS],
}


def fix_summary(df: DataFrame) -> DataFrame:
    """(lang, fix, docs, lines): documents and lines each fix changes.

    One pass over the table: every step is a column, computed once and only for its language.
    Counts are summed map-side, so the shuffle carries one row per fix and task.
    """
    cur = df.select("lang", T.joined_lines(F.col("code")).alias("start"))
    counts = None
    for lang, steps in STEPS.items():
        mine, before, found = F.col("lang") == lang, "start", []
        for name, apply in steps:
            after = f"{lang}_{name}"
            cur = cur.withColumn(after, F.when(mine, apply(F.col(before))))
            found.append((name, _changed_lines(F.col(before), F.col(after))))
            before = after
        if lang == "python":
            cur = cur.withColumn("short", F.when(mine, R.shorten_headers(F.col(before)))).withColumn(
                "end", F.when(mine, R.guard_defaults(F.col("short"))))
            found.append(("mutable_default", F.size(
                F.regexp_extract_all(F.col(before), F.lit(T.rx(R.MUTABLE_HEAD)), F.lit(0)))))
            found.append(("imports", F.size(R.missing_imports(F.col("end")))))
        rows = F.array(*[F.struct(F.lit(n).alias("fix"), c.cast("int").alias("lines")) for n, c in found])
        counts = F.when(mine, rows) if counts is None else counts.when(mine, rows)
    applied = cur.select("lang", F.inline_outer(counts)).filter("lines > 0")
    return applied.groupBy("lang", "fix").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("lines").cast("bigint").alias("lines"))
