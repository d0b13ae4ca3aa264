"""The flagship job: one result row per snippet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codegauge.functions import lang as L, matching as M, score as S, text as T
from codegauge.functions.rulebook import RULES, Rule
from codegauge.operators import fixes, scan, scoring, structure

RESULT_COLUMNS = ["doc_id", "lang", "score", "confidence", "msg", "old_line", "full_code", "lines", "chars",
                  "critical_count", "optims_count", "security_count", "lang_ext"]


def analyze_corpus(df: DataFrame, log: DataFrame | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """Score, report, fixed text and counts per document.

    Input: doc_id, lang, code and optionally p_bug (a model's bug probability). Without a linter
    log the whole job is one projection: no shuffle, and it runs unchanged on a stream.
    """
    p_bug = F.col("p_bug") if "p_bug" in df.columns else F.lit(None).cast("double")
    # the linter join comes first: nothing derived from the code has to be shuffled
    base = scoring.with_lint(df.select("doc_id", "lang", "code", p_bug.alias("p_bug")), log)
    rows = fixes.with_fixed(structure.with_structure(scan.with_owned_lines(base, rules)))
    rows = rows.withColumn("blank", T.is_blank(F.col("code")))

    tree = F.transform(structure.structure_messages(F.col("structure")),
                       lambda m: F.concat(F.lit(f"{S.RED} AST:  "), m))
    lint = F.transform(F.col("lint"), lambda m: F.concat(F.lit(f"{S.YELLOW} PYLINT:  "), m))
    rows = rows.withColumn("parts", F.concat(M.report_entries(rules=rules), tree, lint))
    base_score = scoring.score_of(scoring.points_lost(rules), F.size("lint"))
    rows = rows.withColumn("old_line", F.when(F.col("blank"), "").otherwise(scan.report_text(F.col("parts"))))
    rows = rows.withColumn(
        "score", F.when(F.col("blank"), 0).otherwise(S.blend(base_score, F.col("p_bug"))).cast("int"))

    blank = F.col("blank")
    return rows.select(
        "doc_id", "lang", "score",
        S.confidence(F.col("score")).alias("confidence"),
        S.score_message(F.col("score")).alias("msg"),
        "old_line",
        F.when(blank, "").otherwise(F.col("fixed_code")).alias("full_code"),
        F.when(blank, 0).otherwise(T.line_count(F.col("code"))).cast("int").alias("lines"),
        F.when(blank, 0).otherwise(T.char_count(F.col("code"))).cast("int").alias("chars"),
        *scoring.text_counts(F.col("old_line")),
        L.ext_of_lang(F.col("lang")).alias("lang_ext"),
    )
