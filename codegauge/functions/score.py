"""Severity icons, scores, bands and messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Report icons, score messages, band limits and security words.
RED, YELLOW, BLUE = "🔴", "🟡", "🔵"
CLEAN_REPORT = "✅ No issues found."
PROMPT_MESSAGE = "Paste code above and click Analyse."
SCORE_MESSAGES = [
    (95, "Excellent — no issues found."),
    (85, "Good quality. Minor improvements available."),
    (70, "Decent code. A few issues to address."),
    (50, "Moderate issues. Review recommended."),
    (30, "Multiple problems found. Refactoring needed."),
    (0, "Critical issues. Major revision required."),
]
HEALTH_BANDS = [(85, "Good Stand"), (50, "Needs Work"), (0, "Critical")]
SECURITY_WORDS = ["sql", "inject", "xss", "password", "hardcoded", "shell", "pickle", "rce",
                  "innerhtml", "localstorage"]

# Fixed value: the two lines of a report entry, over a finding `f` and its rule's attributes.
ENTRY_SQL = (
    "concat(CASE {severity} WHEN 3 THEN '" + RED + "' WHEN 2 THEN '" + YELLOW + "' ELSE '" + BLUE + "' END, "
    "' Line ', lpad(CAST(f.line_no AS string), greatest(3, length(CAST(f.line_no AS string))), ' '), "
    "':  ', f.line, '\n           =>  ', {message})"
)


def severity_icon(severity: Column) -> Column:
    return F.when(severity == 3, RED).when(severity == 2, YELLOW).otherwise(BLUE)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def blend(base: Column, p_bug: Column) -> Column:
    """Half rule score, half model score, truncated; the rule score where no model spoke."""
    mixed = (base * 0.5 + (1.0 - p_bug) * 100 * 0.5).cast("int")
    return clamp(F.coalesce(mixed, base))


def _banded(score: Column, zero: str | None, bands: list[tuple[int, str]]) -> Column:
    out = F.when(score == 0, zero) if zero is not None else None
    for floor, name in bands[:-1]:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.otherwise(bands[-1][1])


def score_message(score: Column) -> Column:
    return _banded(score, PROMPT_MESSAGE, SCORE_MESSAGES)


def health_band(score: Column) -> Column:
    return _banded(score, "none", HEALTH_BANDS)


def file_health_band(score: Column) -> Column:
    """The variant of the file review: a zero score is critical too."""
    return _banded(score, None, HEALTH_BANDS)


def confidence(score: Column) -> Column:
    return F.concat(score.cast("string"), F.lit("%"))


def security_lines(report: Column) -> Column:
    """Report lines that carry the red icon and a security word."""
    words = "|".join(SECURITY_WORDS)
    return F.size(F.filter(
        F.split(report, "\n", -1),
        lambda line: F.contains(line, F.lit(RED)) & F.lower(line).rlike(words),
    )).cast("int")
