"""Text primitives with the line and whitespace rules of Python strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters str.strip() removes and the breaks str.splitlines() knows.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ODD_BREAKS = r"\r\n|[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"

TRAILING_BREAK = r"\n\z"

# Java flags: `.` stops at \n only (d); \w, \b and \s follow Unicode (U).
FLAGS = "(?dU)"
FLAGS_ANYCASE = "(?idU)"


def rx(pattern: str) -> str:
    """A pattern written for Python's `re`, with the flags that make Java agree."""
    return FLAGS + pattern


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_sql(text: str) -> str:
    return f"btrim({text}, {quote(BLANKS)})"


def unify_breaks_sql(text: str) -> str:
    """`unify_breaks` as SQL text; text with plain newlines only, the usual case, passes through."""
    return f"if({text} RLIKE {quote(ODD_BREAKS)}, regexp_replace({text}, {quote(ODD_BREAKS)}, '\n'), {text})"


def split_lines_sql(text: str) -> str:
    """`split_lines` as SQL text, for use inside larger expressions."""
    joined = f"regexp_replace({unify_breaks_sql(text)}, {quote(TRAILING_BREAK)}, '')"
    return f"if({text} = '', CAST(array() AS array<string>), split({joined}, '\n', -1))"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def unify_breaks(text: Column) -> Column:
    """Every line break becomes a single newline."""
    return F.when(text.rlike(ODD_BREAKS), F.regexp_replace(text, ODD_BREAKS, "\n")).otherwise(text)


def joined_lines(text: Column) -> Column:
    """The lines of the text joined by newlines: one trailing break is lost."""
    return F.regexp_replace(unify_breaks(text), TRAILING_BREAK, "")


def split_lines(text: Column) -> Column:
    """ARRAY<STRING> of lines; empty text has no lines."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(joined_lines(text), "\n", -1)
    )


def newline_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int")


def line_count(text: Column) -> Column:
    unified = unify_breaks(text)
    open_end = F.when((text != "") & ~F.endswith(unified, F.lit("\n")), 1).otherwise(0)
    return (newline_count(unified) + open_end).cast("int")


def char_count(text: Column) -> Column:
    return F.length(text).cast("int")


def occurrences(text: Column, needle: str) -> Column:
    """How often a one-character needle occurs."""
    return (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))).cast("int")


def history_preview(text: Column) -> Column:
    return F.substring(text, 1, 120)


def prompt_preview(text: Column) -> Column:
    return F.when(
        F.length(text) > 40, F.concat(F.substring(text, 1, 40), F.lit("…"))
    ).otherwise(text)
