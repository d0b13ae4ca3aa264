"""The 27 integer features of a snippet and the weighted rule model over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from codegauge.functions import text as T

# Feature patterns and weights (a weight of zero is left out).
PATTERNS = {
    "has_try": r"\btry\b",
    "has_except": r"\bexcept\b",
    "bare_except": r"except\s*:",
    "has_eval": r"\beval\s*\(",
    "has_exec": r"\bexec\s*\(",
    "has_global": r"\bglobal\b",
    "has_sleep": r"sleep\s*\(",
    "has_none_eq": r"==\s*None|!=\s*None",
    "has_float_eq": r"==\s*0\.\d+|0\.\d+\s*==",
    "has_loose_eq": r"(?<!=)={1}(?!=)",
    "has_var": r"\bvar\b",
    "has_innerhtml": r"innerHTML",
    "has_sql_concat": r"SELECT.*\+|INSERT.*\+|UPDATE.*\+",
    "has_shell_true": r"shell\s*=\s*True",
    "has_pickle": r"pickle\.loads",
    "has_md5": r"md5\(",
    "has_hardcoded_pw": r"password\s*=\s*[\"']",
    "has_open_no_with": r"(?<!with )open\(",
    # possessive loops: same matches, but the matcher does not recurse once per line
    "has_no_return": r"def \w+\([^)]*\):\s*\n(?:\s++(?!return)\S.*+\n)*+\s*\z",
    "has_range_len": r"range\(len\(",
    "has_assert": r"\bassert\b",
    "has_star_import": r"from .* import \*|import \*",
}
WEIGHTS = {
    "bare_except": 0.7, "has_eval": 0.9, "has_exec": 0.85, "has_global": 0.3, "has_sleep": 0.2,
    "has_none_eq": 0.5, "has_float_eq": 0.5, "has_loose_eq": 0.6, "has_var": 0.3, "has_innerhtml": 0.6,
    "has_sql_concat": 0.9, "has_shell_true": 0.8, "has_pickle": 0.8, "has_md5": 0.7,
    "has_hardcoded_pw": 0.9, "has_open_no_with": 0.6, "has_range_len": 0.3, "has_assert": 0.25,
    "has_star_import": 0.35, "has_no_return": 0.4,
}
JAVASCRIPT_ONLY = {"has_loose_eq", "has_var"}
ANY_CASE = {"has_hardcoded_pw"}
LANG_FLAGS = {"lang_py": "python", "lang_java": "java", "lang_js": "javascript"}
NAMES = ["len", "lines", *PATTERNS, *LANG_FLAGS]
BUG_LIMIT = 0.4
SCALE = 3.0


def feature(name: str, code: Column, lang: Column) -> Column:
    if name == "len":
        return T.char_count(code)
    if name == "lines":
        return T.newline_count(code)
    if name in LANG_FLAGS:
        return (lang == LANG_FLAGS[name]).cast("int")
    flags = T.FLAGS_ANYCASE if name in ANY_CASE else T.FLAGS
    hit = code.rlike(flags + PATTERNS[name])
    if name in JAVASCRIPT_ONLY:
        hit = (lang == "javascript") & hit
    return hit.cast("int")


def features(code: Column, lang: Column) -> list[Column]:
    return [feature(n, code, lang).alias(n) for n in NAMES]


def probability(of=F.col) -> Column:
    """min(1, weighted sum / 3); `of` turns a feature name into its column."""
    total = reduce(lambda a, b: a + b, [of(n) * F.lit(w) for n, w in WEIGHTS.items()])
    return F.least(F.lit(1.0), total / F.lit(SCALE))


def predicted(probability_: Column) -> Column:
    return (probability_ >= BUG_LIMIT).cast("int")
