"""Scores and counts per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codegauge.functions import matching as M, score as S, text as T
from codegauge.functions.rulebook import LINT_PENALTY, RULES, STRUCTURE_PENALTY, Rule
from codegauge.operators import scan, structure


def points_lost(rules: list[Rule] = RULES) -> Column:
    """Over a row with `hits`, `lang` and `structure`."""
    found = structure.structure_count(F.col("structure"))
    return M.penalty(rules=rules) + found * STRUCTURE_PENALTY


def score_of(lost: Column, lint_lines: Column) -> Column:
    return S.clamp(F.lit(100) - (lost + lint_lines * LINT_PENALTY))


def with_lint(df: DataFrame, log: DataFrame | None) -> DataFrame:
    """Adds `lint` (array of texts, empty without a log; Python only)."""
    none = F.array().cast("array<string>")
    if log is None:
        return df.withColumn("lint", none)
    joined = df.join(structure.lint_by_doc(log), "doc_id", "left")
    return joined.withColumn(
        "lint", F.when(F.col("lang") == "python", F.coalesce("lint", none)).otherwise(none))


def base_score(df: DataFrame, log: DataFrame | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, lang, base_score). Text is scanned before the linter counts are joined, so the
    join moves three numbers per document and no code."""
    lost = structure.with_structure(scan.with_hits(df.select("doc_id", "lang", "code"), rules)).select(
        "doc_id", "lang", points_lost(rules).alias("lost"))
    if log is None:
        return lost.select("doc_id", "lang", score_of(F.col("lost"), F.lit(0)).alias("base_score"))
    counts = structure.lint_log_findings(log).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    lines = F.when(F.col("lang") == "python", F.coalesce("n", F.lit(0))).otherwise(0)
    return lost.join(counts, "doc_id", "left").select(
        "doc_id", "lang", score_of(F.col("lost"), lines).alias("base_score"))


def all_findings(df: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, pos, severity, line, message): rule lines, then structure, then linter findings.

    `source` ranks the three kinds; `pos` orders rows inside one kind: rule position and line
    number folded into one key, then the position in the list. The first two kinds leave one
    projection together, so the code is read once.
    """
    of_rules = F.expr(
        "transform(owned, f -> struct(1 AS source, CAST(f.ord AS bigint) * 4294967296 + f.line_no AS pos, "
        f"{M.pick_sql('lang', 'f.ord', 'severity')} AS severity, f.line AS line, "
        f"{M.pick_sql('lang', 'f.ord', 'message')} AS message))")
    of_tree = F.transform(F.col("messages"), lambda m, i: F.struct(
        F.lit(2).alias("source"), i.cast("bigint").alias("pos"), F.lit(3).alias("severity"),
        F.lit("AST").alias("line"), m.alias("message")))
    scanned = structure.with_structure(scan.with_owned_lines(df.select("doc_id", "lang", "code"))).select(
        "doc_id", "lang", "owned", structure.structure_messages(F.col("structure")).alias("messages"))
    out = scanned.select("doc_id", F.inline_outer(F.concat(of_rules, of_tree))).filter("source is not null")
    if log is not None:
        python = df.filter(F.col("lang") == "python").select("doc_id")
        out = out.unionByName(structure.lint_log_findings(log).join(python, "doc_id", "left_semi").select(
            "doc_id", F.lit(3).alias("source"), F.col("pos").cast("bigint").alias("pos"),
            F.lit(2).alias("severity"), F.lit("PYLINT").alias("line"), F.col("text").alias("message")))
    return out


def severity_counts(df: DataFrame, log: DataFrame | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, critical, optims) for every document, clean ones included. Rule and structure findings are
    counted inside the row; only the linter's counts are joined."""
    severity = M.pick_sql("lang", "f.ord", "severity", rules)
    rows = structure.with_structure(scan.with_owned_lines(df.select("doc_id", "lang", "code"), rules)).select(
        "doc_id", "lang", F.expr(f"size(filter(owned, f -> {severity} = 3))").alias("worst"),
        F.size("owned").alias("lines"), structure.structure_count(F.col("structure")).alias("tree"))
    rows = rows.withColumn("n", F.lit(0)) if log is None else rows.join(
        structure.lint_log_findings(log).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left")
    lint = F.when(F.col("lang") == "python", F.coalesce("n", F.lit(0))).otherwise(0)
    return rows.select("doc_id", (F.col("worst") + F.col("tree")).cast("bigint").alias("critical"),
                       (F.col("lines") - F.col("worst") + lint).cast("bigint").alias("optims"))


def text_counts(report: Column) -> list[Column]:
    """The counts as the report text shows them; an icon quoted in code counts as well."""
    return [
        T.occurrences(report, S.RED).alias("critical_count"),
        (T.occurrences(report, S.YELLOW) + T.occurrences(report, S.BLUE)).cast("int").alias("optims_count"),
        S.security_lines(report).alias("security_count"),
    ]
