"""Text classifiers by compressed size under two zstandard dictionaries.

Shared by the quality and the toxicity classifier: a bounded sample of labelled text, dictionaries, and a logistic curve that turns
size features into a probability. Labels are learned from `labels` rows outside the held-out fold only. The dictionaries and
the curve are fitted on different documents. Scoring reads every whole text in windows and is row-local.

Bounds of the fit (parameters): `per_class` labelled documents of each class for the dictionaries and as many for the curve, and
`chunks` pieces of CHUNK characters of each class; all are picked by hash from all labelled rows. Nothing else is sampled.

Defined results: null and empty texts get the score of an empty window; labels with null id or null class are ignored, an id with
several labels has the smallest; with no label, or labels of one class only, every score is the share of class 1 (0.5 without
labels); repeated documents are scored row by row; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from codegauge.llm.words import row_filter, slices, text_bytes

PER_CLASS, CHUNKS, CHUNK = 4000, 6000, 2048
FOLDS = 5
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fold(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def compressor(dictionary: bytes, level: int, raw: bool, min_match: int = 0, source: int = 0) -> zstandard.ZstdCompressor:
    """A compressor for small frames without any header that is the same for all of them."""
    kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO
    own = {"min_match": min_match} if min_match else {}
    settings = zstandard.ZstdCompressionParameters.from_level(
        level, source_size=source, dict_size=len(dictionary), write_content_size=0, write_dict_id=0, write_checksum=0, **own)
    return zstandard.ZstdCompressor(
        compression_params=settings, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind) if dictionary else None)


def trained(samples: list[bytes], size: int, segment: int = 0) -> bytes:
    """A dictionary trained on the samples; on too few of them their plain content. With `segment`, it is picked in segments of that length."""
    own = {"k": segment, "d": 6, "split_point": 1.0} if segment else {}
    try:
        return zstandard.train_dictionary(size, samples, **own).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def windows(text: bytes, size: int) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)] or [b""]


@dataclass
class Curve:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def __call__(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_curve(features: np.ndarray, label: np.ndarray, share: float, steps: int = 50) -> Curve:
    """Newton steps on the weighted log loss; weights restore the share of class 1 among all labelled rows."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([(features - mean) / scale, np.ones(len(features))])
    w = np.where(label == 1, share / max(1, (label == 1).sum()), (1 - share) / max(1, (label == 0).sum())) * len(label)
    beta, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 1.0), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (label - p)) - ridge * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return Curve(mean, scale, beta[:-1], float(beta[-1]))


def labelled_ids(labels: DataFrame, label_col: str, id_col: str, per_class: int) -> tuple[float | None, list[tuple[int, int, bool]]]:
    """Share of class 1 among the labels to learn from, and a bounded sample of (id, label, for the dictionaries)."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col) != 0)) \
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        return None, []
    picked = []
    for label in counts:
        best = rows.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(2 * per_class).collect()
        picked += [(r["id"], label, k % 2 == 0) for k, r in enumerate(best)]
    return counts.get(1, 0) / total, picked


def chunk_sample(docs: DataFrame, ids: DataFrame, chunks: int, id_col: str, text_col: str) -> dict[int, list[bytes]]:
    """Pieces of the dictionary documents, at most `chunks` of each class, picked by hash from whole texts.

    Places are picked first, so that no text is sorted or sent to the driver; then the pieces at those places are read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids.where("build")), "id")
    places = own.where(F.length("text") > 0).select(
        "id", "label", F.explode(F.sequence(F.lit(1), F.length("text"), F.lit(CHUNK))).alias("at")).distinct()
    picked = [tuple(r) for label in (0, 1)
              for r in places.where(F.col("label") == label).orderBy(F.xxhash64("id", "at"), "id", "at").limit(chunks).collect()]
    chosen = docs.sparkSession.createDataFrame(picked, places.schema)
    rows = own.drop("label").join(F.broadcast(chosen), "id").where(F.length("text") >= F.col("at")) \
        .groupBy("label", "id", "at").agg(F.min(F.substring("text", F.col("at"), F.lit(CHUNK))).alias("t")) \
        .orderBy("label", F.xxhash64("id", "at"), "id", "at").collect()
    out: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows:
        out[r["label"]].append(r["t"].encode())
    return out


def _hash24(text: bytes) -> np.ndarray:
    """Hashes of all 24-byte pieces."""
    g = grams(text, 8)
    if len(g) <= 16:
        return g[:0]
    return ((g[:-16] * np.uint64(0x9E3779B97F4A7C15) + g[8:-8]) * np.uint64(0xD1342543DE82EF95) + g[16:]) * np.uint64(0xBF58476D1CE4E5B9)


def grams(text: bytes, n: int) -> np.ndarray:
    """All pieces of n <= 8 bytes as integers."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    size = max(0, len(a) - n + 1)
    value = np.zeros(size, np.uint64)
    for k in range(n):
        value = (value << np.uint64(8)) | a[k:k + size]
    return value


def unlike(pieces: list[bytes]) -> list[bytes]:
    """Without pieces that repeat a part of an earlier one, so that copies do not pass for evidence."""
    seen: set[int] = set()
    out = []
    for piece in pieces:
        least = np.unique(_hash24(piece) >> np.uint64(8))[:8].tolist()
        if not seen.intersection(least):
            out.append(piece)
        seen.update(least)
    return out


Features = Callable[[bytes], list[float]]


@dataclass
class Model:
    """Features and curve; without a curve every text has the constant score."""

    make: Callable[[], Features] | None
    curve: Curve | None
    constant: float
    lower: bool

    def scores(self, features: Features | None, column: pa.Array) -> np.ndarray:
        """The scores of a slice of texts, or their features while there is no curve."""
        if features is None:
            return np.full(len(column), self.constant)
        data, offsets = text_bytes(column)
        raw = data.tobytes()
        raw = raw.translate(LOWER) if self.lower else raw
        rows = np.array([features(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())])
        return rows if self.curve is None else self.curve(rows)


def scored(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of every row, or (id, features) of a model that has no curve yet."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    tuning = model.make is not None and model.curve is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.make() if model.make else None
        for batch in batches:
            for part in slices(batch, "text"):
                found = model.scores(features, part.column("text"))
                out = pa.array(found.tolist(), pa.list_(pa.float64())) if tuning else pa.array(found, pa.float64())
                yield pa.record_batch([part.column("id"), out], names=["id", "score"])

    return source.mapInArrow(run, f"id {kind}, score {'array<double>' if tuning else 'double'}")


def keep_rows(docs: DataFrame, model: Model, least: float = -math.inf, most: float = math.inf, text_col: str = "text") -> DataFrame:
    """The documents with least <= score < most, all columns as they are."""
    def keep(part: pa.RecordBatch, features: Features | None) -> np.ndarray:
        found = model.scores(features, part.column("text"))
        return (found >= least) & (found < most)

    return docs.where(row_filter(keep, lambda: model.make() if model.make else None)(F.col(text_col)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, build: Callable[[dict[int, list[bytes]]], Callable[[], Features]],
        lower: bool, per_class: int = PER_CLASS, chunks: int = CHUNKS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled documents; `build` makes the features from the sampled pieces of each class."""
    share, picked = labelled_ids(labels, label_col, id_col, per_class)
    constant = Model(None, None, 0.5 if share is None else float(share), lower)
    if share is None or not 0 < share < 1:
        return constant
    ids = docs.sparkSession.createDataFrame(picked, f"id {labels.schema[id_col].dataType.simpleString()}, label int, build boolean")
    pieces = chunk_sample(docs, ids, chunks, id_col, text_col)
    if not all(pieces.values()):
        return constant
    model = Model(build(pieces), None, float(share), lower)
    tuning = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids.where("NOT build")), "id") \
        .select(F.struct("id", "label").alias("key"), "text")
    seen = scored(tuning, model, "key", "text").select("id.label", "score").collect()
    label = np.array([r["label"] for r in seen])
    if len(set(label.tolist())) < 2:
        return constant
    model.curve = fit_curve(np.array([r["score"] for r in seen]), label, float(share))
    return model


def log1(x: float) -> float:
    return math.log1p(max(0.0, x))
