"""Toxicity: compressed lengths of text windows under a toxic and an ordinary zstandard dictionary.

The ordinary dictionary is trained on windows of ordinary labelled text, the toxic one on the stretches of toxic labelled text that
tell it from ordinary text: byte n-grams of so many more toxic than ordinary pieces that chance hardly explains it, joined where they
overlap. The bar is a bound on false findings among all n-grams looked at, so it asks for the same evidence at every table size and
in every language. Pieces that repeat one another count once, so copies are no evidence; where no stretch tells, whole windows of
toxic text train the dictionary.

Windows are compressed under the ordinary dictionary followed by the toxic one and under the ordinary one padded to the same length:
matches in the common part cost the same, and a window gets shorter by what toxic wording saves. Letters A-Z are lower-cased.
Features of the score: the largest saving of a window, the three largest, the mean, and the share and number of windows that save
2, 3, 4 and 6 bytes. A logistic curve, fitted on labelled documents that built no dictionary, weighs them: it is the threshold's
calibration. Bounds and defined results: `codegauge.llm.compression`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from codegauge.llm.compression import LOWER, Features, Model, compressor, fit, grams, log1, scored, trained, unlike, windows

#: Matches are at least MIN_MATCH bytes, and few literals are written plainly: a saving is bytes of matched wording.
WINDOW, LEVEL, MIN_MATCH = 96, 6, 6
#: Bytes of the ordinary dictionary, and the most of the toxic one, which is as long as its stretches; it is picked in short segments.
ORDINARY, TOXIC, SEGMENT = 32_000, 1 << 16, 12
NGRAMS = (5, 6, 7, 8)
#: How much more frequent an n-gram is in toxic pieces, and how many n-grams of a length may pass by chance.
RATIO, FALSE = 5.0, 0.05
STEPS = (2, 3, 4, 6)


def _counts(pieces: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of at least two pieces, and the number of pieces of each."""
    found, count = np.unique(np.concatenate([np.unique(grams(p, n)) for p in pieces]), return_counts=True)
    return found[count > 1], count[count > 1]


def _counts_of(known: np.ndarray, pieces: list[bytes], n: int) -> np.ndarray:
    """The number of pieces that hold each of the sorted known n-grams."""
    count = np.zeros(len(known), np.int64)
    for piece in pieces:
        own = np.unique(grams(piece, n))
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        count[at[known[at] == own]] += 1
    return count


def telling(toxic: list[bytes], ordinary: list[bytes], n: int) -> np.ndarray:
    """The n-grams that mark toxic pieces: the bound on the chance of so many toxic pieces, times the n-grams, is below FALSE."""
    u, a = _counts(toxic, n)
    if not len(u):
        return u
    b = _counts_of(u, ordinary, n)
    share = len(toxic) / (len(toxic) + len(ordinary))
    p = a / (a + b)
    with np.errstate(divide="ignore", invalid="ignore"):
        divergence = p * np.log(p / share) + np.where(b > 0, (1 - p) * np.log((1 - p) / (1 - share)), 0.0)
    rare = (a + b) * divergence >= np.log(len(u) / FALSE)
    return u[(p > share) & rare & (a * len(ordinary) >= RATIO * b * len(toxic))]


def stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Maximal stretches of telling n-grams in toxic pieces, each where it occurs; those that occur once are left out."""
    marks = {n: telling(toxic, ordinary, n) for n in NGRAMS}
    found: list[bytes] = []
    for piece in toxic:
        cover = np.zeros(len(piece) + 1, np.int64)
        for n, known in marks.items():
            at = np.flatnonzero(np.isin(grams(piece, n), known))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover) > 0, [False]]).astype(np.int8)))
        found += [piece[s:e] for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())]
    count = Counter(found)
    return [part for part in found if count[part] > 1]


def saving_features(toxic: bytes, ordinary: bytes) -> Callable[[], Features]:
    def make() -> Features:
        a, b = (compressor(ordinary + d, LEVEL, True, MIN_MATCH, WINDOW) for d in (b"\0" * len(toxic), toxic))

        def features(text: bytes) -> list[float]:
            saved = sorted((len(a.compress(w)) - len(b.compress(w)) for w in windows(text, WINDOW)), reverse=True)
            counts = [sum(s >= least for s in saved) for least in STEPS]
            return [min(saved[0], 12), min(sum(saved[:3]), 30), sum(saved) / len(saved),
                    *(n / len(saved) for n in counts), *(log1(n) for n in counts)]

        return features

    return make


def toxic_dictionary(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    parts = stretches(unlike(toxic), unlike(ordinary)) or [w for p in toxic for w in windows(p, WINDOW)]
    return trained(parts, max(256, min(TOXIC, sum(map(len, set(parts))) + 200)), SEGMENT)


def _build(pieces: dict[int, list[bytes]]) -> Callable[[], Features]:
    toxic, ordinary = ([p.translate(LOWER) for p in pieces[label]] for label in (1, 0))
    parts = [w for p in ordinary for w in windows(p, WINDOW)]
    return saving_features(toxic_dictionary(toxic, ordinary), trained(parts, ORDINARY)[-ORDINARY:])


def toxicity_model(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", **options) -> Model:
    return fit(docs, labels, label_col, _build, lower=True, **options)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """(id, score): the probability that a text is labelled toxic."""
    model = toxicity_model(docs, labels, label_col, id_col=id_col, text_col=text_col, **options)
    return scored(docs, model, id_col, text_col).withColumnRenamed("id", id_col)
