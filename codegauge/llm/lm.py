"""Masked pseudo-likelihood: a bidirectional window network, trained in NumPy, predicts every token from both its sides.

Vocabulary: words of all documents are counted (partial sums, one shuffle); the TOP most frequent are tokens of their own, all others
share HASHED tokens by their hash. The network averages learned vectors of the SIDE tokens to the left and to the right, each
place with its own weights, adds a hidden layer and predicts in two steps, the class of a token and the token in its class, so a
prediction costs two small softmaxes. A token's own vector is never an input of its prediction.

Training covers the whole corpus: every task trains a copy of the same start on all its documents in mini-batches, and the copies
are averaged, weighted by their tokens, piece by piece in a shuffle. The texts are dealt to ROUNDS rounds by hash, each round starts
from the average before, so every text is trained on once. Only the average (some hundred KB, fixed by the parameters) reaches the driver. What is counted, trained on and averaged grows with the input.

Scoring is row-local up to the words of shared tokens: the network gives log P of the shared token, and log(n_word / n_token) is
added, the word's share of the occurrences of all words of that token, so a word's chance follows from its own count whatever the
number of distinct words. The counts of the COMMON most frequent words travel with the model; those of all other words are joined
from the table of all distinct words, so which words are common changes no result. Every shared token has one occurrence more for
words that were not counted. The chances of all words, and one of another word in every shared token, add up to 1.

Defined results: null and empty texts have 0 tokens, sum 0 and a null mean; repeated rows are scored row by row (and counted in
training as often); only id and text are read, so other columns cannot clash; an empty table gives an empty result; very long
texts are worked off in slices of tokens with their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codegauge.llm.words import SPACES, mix, slices, words
from codegauge.session import scratch_path

TOP, HASHED, CLASSES = 768, 256, 32
SIDE, WIDTH, ROUNDS = 2, 16, 2
#: Words whose counts are kept beside the network to spare the join; a bound of memory, not of the vocabulary.
COMMON = 1 << 18
RATE, BATCH = 0.2, 8192
#: Parameters that an averaging row carries.
CUT = 4096


@dataclass
class Shape:
    top: int = TOP
    hashed: int = HASHED
    classes: int = CLASSES
    side: int = SIDE
    width: int = WIDTH

    @property
    def tokens(self) -> int:
        return self.top + self.hashed

    @property
    def per_class(self) -> int:
        return -(-self.tokens // self.classes)

    def sizes(self) -> dict[str, tuple[int, ...]]:
        return {"embed": (self.tokens + 1, self.width), "place": (2 * self.side, self.width), "hidden": (self.width, self.width),
                "bias": (self.width,), "cls": (self.width, self.classes), "cls_bias": (self.classes,),
                "word": (self.classes, self.width, self.per_class), "word_bias": (self.classes, self.per_class)}


def split(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in shape.sizes().items():
        n = int(np.prod(size))
        out[name] = flat[at:at + n].reshape(size)
        at += n
    return out


def start(shape: Shape, seed: int = 11, counts: np.ndarray | None = None) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for name, size in shape.sizes().items():
        if name == "place":
            parts.append(np.ones(size))
        elif "bias" in name:
            parts.append(np.zeros(size))
        else:
            parts.append(rng.normal(0, 0.3 if name in ("embed", "hidden") else 0.02, size))
    flat = np.concatenate([p.ravel() for p in parts]).astype(np.float32)
    if counts is not None:  # without context the network starts at the token frequencies
        p, n = split(flat, shape), np.maximum(counts, 0.5)
        padded = np.full(shape.classes * shape.per_class, 1e-9)
        padded[:shape.tokens] = n
        by_class = padded.reshape(shape.per_class, shape.classes).T
        p["cls_bias"][:] = np.log(by_class.sum(axis=1) / n.sum())
        p["word_bias"][:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    return flat


def contexts(tokens: np.ndarray, number: np.ndarray, shape: Shape) -> np.ndarray:
    """The tokens around every token; beyond the ends of its text the padding token."""
    out = np.full((len(tokens), 2 * shape.side), shape.tokens, np.int64)
    for k in range(1, shape.side + 1):
        if len(tokens) > k:
            same = number[k:] == number[:-k]
            out[k:, shape.side - k][same] = tokens[:-k][same]
            out[:-k, shape.side + k - 1][same] = tokens[k:][same]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def forward(p: dict[str, np.ndarray], around: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    embedded = p["embed"][around]
    mixed = (embedded * p["place"]).mean(axis=1)
    hidden = np.tanh(mixed @ p["hidden"] + p["bias"])
    return embedded, mixed, hidden


def _members(p: dict[str, np.ndarray], hidden: np.ndarray, cls: np.ndarray, shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every class: the rows of that class and their chances of its words."""
    order = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(shape.classes + 1))
    room = shape.tokens - np.arange(shape.per_class) * shape.classes  # word slot k of class c is token k * classes + c
    for c in range(shape.classes):
        rows = order[cuts[c]:cuts[c + 1]]
        if len(rows):
            logits = hidden[rows] @ p["word"][c] + p["word_bias"][c]
            logits[:, room <= c] = -1e30
            yield c, rows, _softmax(logits)


def log_probability(p: dict[str, np.ndarray], tokens: np.ndarray, around: np.ndarray, shape: Shape) -> np.ndarray:
    """log P(token | both sides) of every token."""
    out = np.zeros(len(tokens))
    for at in range(0, len(tokens), 2 * BATCH):
        t, a = tokens[at:at + 2 * BATCH], around[at:at + 2 * BATCH]
        hidden = forward(p, a, shape)[2]
        cls, slot = t % shape.classes, t // shape.classes
        chance = _softmax(hidden @ p["cls"] + p["cls_bias"])[np.arange(len(t)), cls]
        inner = np.zeros(len(t), np.float32)
        for _, rows, q in _members(p, hidden, cls, shape):
            inner[rows] = q[np.arange(len(rows)), slot[rows]]
        out[at:at + 2 * BATCH] = np.log(np.maximum(chance, 1e-30)) + np.log(np.maximum(inner, 1e-30))
    return out


def gradient(p: dict[str, np.ndarray], tokens: np.ndarray, around: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability."""
    n = len(tokens)
    embedded, mixed, hidden = forward(p, around, shape)
    g = {name: np.zeros_like(x) for name, x in p.items()}
    cls, slot = tokens % shape.classes, tokens // shape.classes
    d = _softmax(hidden @ p["cls"] + p["cls_bias"])
    d[np.arange(n), cls] -= 1
    d /= n
    g["cls"], g["cls_bias"] = hidden.T @ d, d.sum(axis=0)
    back = d @ p["cls"].T
    for c, rows, q in _members(p, hidden, cls, shape):
        q[np.arange(len(rows)), slot[rows]] -= 1
        q /= n
        g["word"][c], g["word_bias"][c] = hidden[rows].T @ q, q.sum(axis=0)
        back[rows] += q @ p["word"][c].T
    back *= 1 - hidden * hidden
    g["hidden"], g["bias"] = mixed.T @ back, back.sum(axis=0)
    side = (back @ p["hidden"].T)[:, None, :] / (2 * shape.side)
    g["place"] = (embedded * side).sum(axis=0)
    parts, at = (side * p["place"]).reshape(-1, shape.width), around.ravel()
    for k in range(shape.width):
        g["embed"][:, k] = np.bincount(at, weights=parts[:, k], minlength=shape.tokens + 1)
    return g


def train_batches(flat: np.ndarray, tokens: np.ndarray, around: np.ndarray, shape: Shape, memory: np.ndarray) -> None:
    """Adagrad steps in place over all tokens, BATCH at a time."""
    p, m = split(flat, shape), split(memory, shape)
    for at in range(0, len(tokens), BATCH):
        for name, g in gradient(p, tokens[at:at + BATCH], around[at:at + BATCH], shape).items():
            m[name] += g * g
            p[name] -= RATE * g / (np.sqrt(m[name]) + 1e-6)


def to_tokens(hashes: np.ndarray, vocabulary: np.ndarray, rank: np.ndarray, shape: Shape) -> np.ndarray:
    """Token of every word: its rank in the vocabulary, or one of the hashed tokens."""
    other = shape.top + (mix(hashes) % np.uint64(shape.hashed)).astype(np.int64)
    if not len(vocabulary):
        return other
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, rank[at], other)


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, n) of every distinct word of the corpus: counted per slice in the task, then summed."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                value, n = np.unique(words(part.column("text"), SPACES)[1], return_counts=True)
                yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], names=["hash", "n"])

    return texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _trained(texts: DataFrame, flat: np.ndarray, vocabulary: np.ndarray, rank: np.ndarray, shape: Shape) -> np.ndarray:
    """One round: every task trains on all its texts from `flat`; the token-weighted average of the copies."""
    spark = texts.sparkSession
    begin = spark.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory, seen = begin.value.copy(), np.full(len(begin.value), 1e-3, np.float32), 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                number, hashes = words(part.column("text"), SPACES)
                tokens = to_tokens(hashes, vocabulary, rank, shape)
                train_batches(own, tokens, contexts(tokens, number, shape), shape, memory)
                seen += len(tokens)
        if seen:
            cuts = [own[a:a + CUT].astype(np.float64) * seen for a in range(0, len(own), CUT)]
            yield pa.record_batch([pa.array(range(len(cuts)), pa.int32()), pa.array([c.tolist() for c in cuts], pa.list_(pa.float64())),
                                   pa.array([seen] * len(cuts), pa.int64())], names=["cut", "sum", "n"])

    copies = texts.mapInArrow(run, "cut int, sum array<double>, n long")
    places = copies.select("cut", "n", F.posexplode("sum").alias("at", "x"))
    mean = places.groupBy("cut", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    rows = mean.groupBy("cut").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("cut", F.col("v.x").alias("x")).collect()
    return np.concatenate([np.array(r["x"], np.float32) for r in sorted(rows, key=lambda r: r["cut"])]) if rows else flat


@dataclass
class Model:
    """The network; its own words by hash; log counts of the common words by hash; occurrences of each shared token; the folder of all counts."""

    flat: np.ndarray
    vocabulary: np.ndarray
    rank: np.ndarray
    shape: Shape
    common: np.ndarray
    log_count: np.ndarray
    shared: np.ndarray
    counted: str


def shared_counts(counted: DataFrame, own: np.ndarray, n: np.ndarray, shape: Shape) -> np.ndarray:
    """How often the words of each shared token occur; `own` are the hashes of words with tokens of their own, `n` their counts."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape.hashed, np.int64)
        for batch in batches:
            hashes = np.asarray(batch.column("hash")).view(np.uint64)
            np.add.at(total, (mix(hashes) % np.uint64(shape.hashed)).astype(np.int64), np.asarray(batch.column("n")))
        yield pa.record_batch([pa.array(range(shape.hashed), pa.int32()), pa.array(total)], names=["k", "n"])

    out = np.zeros(shape.hashed, np.int64)
    for r in counted.mapInArrow(add, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    np.subtract.at(out, (mix(own) % np.uint64(shape.hashed)).astype(np.int64), n)
    return out


def train(docs: DataFrame, shape: Shape | None = None, rounds: int = ROUNDS, text_col: str = "text", common: int = COMMON) -> Model:
    shape = shape or Shape()
    texts = docs.select(F.col(text_col).alias("text")).where(F.length("text") > 0)
    path = scratch_path(docs.sparkSession, "words")
    word_counts(texts).write.parquet(path)
    counted = docs.sparkSession.read.parquet(path)
    often = counted.orderBy(F.desc("n"), "hash").limit(max(common, shape.top)).toArrow()
    hashes, n = np.asarray(often.column("hash")).view(np.uint64), np.asarray(often.column("n"))
    top = min(shape.top, len(n))
    shared = shared_counts(counted, hashes[:top], n[:top], shape)
    counts = np.full(shape.tokens, shared.sum() / shape.hashed)
    counts[:top] = n[:top]
    counts[top:shape.top] = 0
    by, every = np.argsort(hashes[:top]), np.argsort(hashes)
    model = Model(start(shape, counts=counts), hashes[by], by.astype(np.int64), shape, hashes[every], np.log(n[every]), shared, path)
    for turn in range(rounds):
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        model.flat = _trained(own, model.flat, model.vocabulary, model.rank, shape)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, `n_tokens`, `sum_log_prob` and `mean_log_prob`."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        p, log_total = split(m.flat, m.shape), np.log(m.shared + 1.0)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                number, hashes = words(part.column("text"), SPACES)
                tokens = to_tokens(hashes, m.vocabulary, m.rank, m.shape)
                log = log_probability(p, tokens, contexts(tokens, number, m.shape), m.shape)
                rare = np.flatnonzero(tokens >= m.shape.top)
                log[rare] -= log_total[tokens[rare] - m.shape.top]
                if len(m.common):
                    at = np.minimum(np.searchsorted(m.common, hashes[rare]), len(m.common) - 1)
                    known = m.common[at] == hashes[rare]
                    log[rare[known]] += m.log_count[at[known]]
                    rare = rare[~known]
                n = np.bincount(number, minlength=part.num_rows)
                total = np.bincount(number, weights=log, minlength=part.num_rows)
                cuts = np.searchsorted(number[rare], np.arange(part.num_rows + 1)).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes[rare].view(np.int64)))
                yield pa.record_batch([part.column("id"), pa.array(n, pa.int64()), pa.array(total, pa.float64()), others],
                                      names=["id", "n", "total", "others"])

    path = scratch_path(spark, "scores")
    source.mapInArrow(run, f"id {kind}, n long, total double, others array<long>") \
        .withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    found = rows.select("row", F.explode("others").alias("hash")).join(spark.read.parquet(model.counted), "hash") \
        .groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    total = F.col("total") + F.coalesce("more", F.lit(0.0))
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), total.alias("sum_log_prob"),
        F.when(F.col("n") > 0, total / F.col("n")).alias("mean_log_prob"))


def pseudo_likelihood(docs: DataFrame, shape: Shape | None = None, rounds: int = ROUNDS, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The documents' scores under the network trained on them."""
    return score(docs, train(docs, shape, rounds, text_col), id_col, text_col)
