"""Clean-up of model replies and context-usage arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codegauge.functions import text as T

# Reply length limit, fence tags in removal order, usage bands.
MIN_REPLY = 20
FENCE = "```"
CONVERT_TAGS = ["python", "java", "javascript", "typescript", "cpp", "go"]
DEFAULT_LIMIT = 8192
WARN_PCT, NEAR_PCT = 80.0, 60.0


def strip_fence_edges(text: Column) -> Column:
    """One fence at the start and one at the end; NULL unless more than 20 characters remain."""
    opened = F.regexp_replace(text, T.rx(r"\A```[\w]*\n?"), "")
    cleaned = T.strip(F.regexp_replace(opened, T.rx(r"\n?```\z|\n?```(?=\n\z)"), ""))
    return F.when(F.length(cleaned) > MIN_REPLY, cleaned)


def strip_fences_all(text: Column, target: Column | None = None) -> Column:
    """Every fence goes, the target language's tag first; an unlisted tag leaves its text."""
    out = T.strip(text)
    if target is not None:
        out = F.replace(out, F.concat(F.lit(FENCE), target), F.lit(""))
    for tag in [*CONVERT_TAGS, ""]:
        out = F.replace(out, F.lit(FENCE + tag), F.lit(""))
    return T.strip(out)


def accepted(text: Column) -> Column:
    return F.coalesce(F.length(T.strip(text)) > MIN_REPLY, F.lit(False))


def usage_pct(total: Column, limit: Column) -> Column:
    """Share of the context window in percent, one decimal; the binary value is rounded, not its printed form."""
    return F.when(limit > 0, _one_decimal(total / limit * 100)).otherwise(0.0)


def _one_decimal(x: Column) -> Column:
    """The nearest tenth of the exact binary value of x >= 0; halves go to the even tenth.

    The middle between two tenths is m/20 with m odd, which a double mostly misses: 20 times the nearest
    double, taken without rounding as a sum and its error, tells on which side of it the exact middle lies.
    """
    tenths = F.floor(x * 10)
    odd = (tenths * 2 + 1).cast("double")
    middle = odd / 20
    high, low = middle * 16, middle * 4
    total = high + low
    error = (high - (total - (total - high))) + (low - (total - high))
    beyond = (total - odd) + error  # middle as a double is above (+), below (-) or at the exact middle
    up = (x > middle) | ((x == middle) & ((beyond > 0) | ((beyond == 0) & (tenths % 2 == 1))))
    return F.when(up, tenths + 1).otherwise(tenths).cast("double") / 10


def usage_band(pct: Column) -> Column:
    return F.when(pct >= WARN_PCT, "red").when(pct >= NEAR_PCT, "amber").otherwise("green")


def usage_bar(pct: Column) -> Column:
    return F.least(pct, F.lit(100.0))
