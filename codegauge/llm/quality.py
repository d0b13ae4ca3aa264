"""Quality classifier: zstandard dictionaries of good and of bad labelled text, compared by compressed size.

Every whole text is compressed window by window with either dictionary. Features of the score are the difference of the two total
sizes over their sum, and the size under the good dictionary for each byte of text (low for text that repeats itself). A logistic
curve, fitted on labelled documents that built no dictionary, makes them a probability. Bounds and defined results:
`codegauge.llm.compression`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from codegauge.llm.compression import Features, Model, compressor, fit, scored, trained, windows

WINDOW, DICTIONARY, LEVEL = 1024, 64 << 10, 3
THRESHOLD = 0.3


def size_features(good: bytes, bad: bytes) -> Callable[[], Features]:
    def make() -> Features:
        a, b = compressor(good, LEVEL, False), compressor(bad, LEVEL, False)

        def features(text: bytes) -> list[float]:
            parts = windows(text, WINDOW)
            g, q = sum(len(a.compress(w)) for w in parts), sum(len(b.compress(w)) for w in parts)
            density = math.log((g + 1) / (len(text) + 16))
            return [(q - g) / (q + g), density, density * density]

        return features

    return make


def _build(pieces: dict[int, list[bytes]]) -> Callable[[], Features]:
    parts = {label: [w for piece in texts for w in windows(piece, WINDOW)] for label, texts in pieces.items()}
    return size_features(trained(parts[1], DICTIONARY), trained(parts[0], DICTIONARY))


def quality_model(docs: DataFrame, labels: DataFrame, label_col: str = "quality", **options) -> Model:
    return fit(docs, labels, label_col, _build, lower=False, **options)


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """(id, score): the probability that a text is labelled good."""
    model = quality_model(docs, labels, label_col, id_col=id_col, text_col=text_col, **options)
    return scored(docs, model, id_col, text_col).withColumnRenamed("id", id_col)


def predicted(score: str = "score", threshold: float = THRESHOLD) -> F.Column:
    return (F.col(score) >= threshold).cast("int")
