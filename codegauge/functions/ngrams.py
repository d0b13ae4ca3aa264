"""Character n-grams inside word boundaries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codegauge.functions import text as T


def model_text(code: Column, lang: Column) -> Column:
    """What the classifiers read: the code, a blank and the language."""
    return F.concat(code, F.lit(" "), lang)


def raw_words(text: Column) -> Column:
    """ARRAY<STRING>: lower-cased words; an empty one where the text begins or ends with a blank."""
    return F.split(F.lower(text), T.rx(r"[\s\x1C-\x1F]+"), -1)


def padded(word: Column) -> Column:
    return F.concat(F.lit(" "), word, F.lit(" "))


def words(text: Column) -> Column:
    """ARRAY<STRING>: lower-cased words, each with one blank on both sides."""
    return F.transform(F.filter(raw_words(text), lambda w: w != ""), padded)


def word_ngrams(word: Column, lo: int, hi: int) -> Column:
    """All n-grams of one padded word (never shorter than three), lo <= n <= hi."""
    if lo > 3:
        raise ValueError("lo must be at most 3, the shortest padded word")

    def of_size(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(word) - n + 1),
                           lambda i: F.substring(word, i, n))

    sizes = F.sequence(F.lit(lo), F.least(F.lit(hi), F.length(word)))
    return F.flatten(F.transform(sizes, of_size))


def char_wb_ngrams(text: Column, lo: int, hi: int) -> Column:
    return F.flatten(F.transform(words(text), lambda w: word_ngrams(w, lo, hi)))
