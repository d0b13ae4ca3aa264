"""Character n-gram vocabulary and sublinear tf-idf vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from codegauge.functions import ngrams as N
from codegauge.operators.batches import stretches

BASIC = (2, 4, 8000)
ADVANCED = (2, 5, 12000)
#: What a task works on at a time: bytes of text, or cells of vectors.
PIECE = 1 << 16
#: n-grams of known words, and terms counted, that a task holds at most before it starts afresh.
MOST_CELLS, MOST_TERMS = 1 << 22, 1 << 18


def term_counts(texts: DataFrame, lo: int, hi: int) -> DataFrame:
    """(term, freq) over a `text` column.

    Words are counted first, and only distinct words are cut into n-grams, weighted by their
    count: the n-gram explosion grows with the vocabulary of words, not with the text.
    """
    words = texts.select(F.explode(N.raw_words(F.col("text"))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).filter("word <> ''").select(N.padded(F.col("word")).alias("word"), "n")
    return words.select(F.explode(N.word_ngrams(F.col("word"), lo, hi)).alias("term"), "n").groupBy(
        "term").agg(F.sum("n").cast("bigint").alias("freq"))


def top_vocabulary(texts: DataFrame, lo: int, hi: int, k: int) -> DataFrame:
    """(term, freq): the k most frequent terms; equal counts in term order."""
    return term_counts(texts, lo, hi).orderBy(F.desc("freq"), "term").limit(k)


class WordGrams:
    """Numbers of the n-grams of words. A word is cut once as long as it is kept, and the words kept are bounded.

    With `terms` only those are numbered, by their place; otherwise every n-gram met gets the next number.
    """

    def __init__(self, lo: int, hi: int, terms: list[str] | None = None) -> None:
        self.lo, self.hi, self.fixed = lo, hi, terms is not None
        self.number = {t: i for i, t in enumerate(terms or [])}
        self._cells: dict[str, np.ndarray] = {}
        self._held = 0

    def cells(self, word: str) -> np.ndarray:
        found = self._cells.get(word)
        if found is None:
            w = f" {word} "
            grams = [w[i:i + n] for n in range(self.lo, min(self.hi, len(w)) + 1) for i in range(len(w) - n + 1)]
            if self.fixed:
                found = np.array([self.number[g] for g in grams if g in self.number], np.int32)
            else:
                found = np.array([self.number.setdefault(g, len(self.number)) for g in grams], np.int32)
            if self._held > MOST_CELLS:
                self._cells, self._held = {}, 0
            self._cells[word] = found
            self._held += len(found) + 16
        return found

    def counts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, n) of the rows of an array of lower-cased texts, in order of row and term; a null text has none."""
        split = [text.split() if text else [] for text in texts.to_pylist()]
        lengths = np.array([len(words) for words in split], np.int64)
        place: dict[str, int] = {}
        code = np.fromiter((place.setdefault(w, len(place)) for words in split for w in words), np.int64, int(lengths.sum()))
        of_word = [self.cells(w) for w in place]
        sizes = np.array([len(c) for c in of_word], np.int64)
        cells = np.concatenate([np.zeros(0, np.int32), *of_word])
        each = sizes[code]
        shift = (np.cumsum(sizes) - sizes)[code] - (np.cumsum(each) - each)
        size = max(len(self.number), 1)
        small = np.int32 if len(texts) * size < 1 << 31 else np.int64
        base = np.repeat(np.arange(len(texts), dtype=small) * small(size), lengths)
        pairs = np.repeat(base, each) + cells[np.arange(int(each.sum())) + np.repeat(shift, each)]
        pairs.sort()
        first = np.flatnonzero(np.diff(pairs, prepend=small(-1)))
        n = np.diff(first, append=len(pairs))
        row, term = np.divmod(pairs[first], small(size))
        return row, term, n


def pieces(array: pa.Array, sizes: np.ndarray, limit: int) -> Iterator[pa.Array]:
    return (array[a:b] for a, b in stretches(sizes, limit))


def _by_text(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    return pieces(texts, pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), PIECE)


def _vocabulary_with_df(texts: DataFrame, lo: int, hi: int, k: int) -> DataFrame:
    """(term, df) of the k most frequent terms: both counts come from one pass, summed in the task before they are shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, freq, df = WordGrams(lo, hi), np.zeros(0), np.zeros(0, np.int64)

        def found() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(grams.number), pa.string()), pa.array(freq.astype(np.int64)), pa.array(df)],
                                   names=["term", "freq", "df"])

        for batch in batches:
            for part in _by_text(batch.column(0)):
                _, term, n = grams.counts(part)
                if more := len(grams.number) - len(freq):
                    freq, df = np.append(freq, np.zeros(more)), np.append(df, np.zeros(more, np.int64))
                freq += np.bincount(term, n, len(freq))
                df += np.bincount(term, minlength=len(df))
                if len(freq) > MOST_TERMS:
                    yield found()
                    grams, freq, df = WordGrams(lo, hi), np.zeros(0), np.zeros(0, np.int64)
        yield found()

    counted = texts.select(F.lower("text").alias("text")).mapInArrow(count, "term string, freq bigint, df bigint")
    return counted.groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("df").alias("df")).orderBy(
        F.desc("freq"), "term").limit(k).select("term", "df")


def tfidf_sublinear(docs: DataFrame, lo: int, hi: int, k: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf, weight) in long form: (1 + ln tf) * (ln((1+n)/(1+df)) + 1), L2 per document.

    Counting, weights and norm stay inside a document's row, in Arrow batches taken in pieces of bounded text: no text is
    shuffled, and a word is cut once per task. The vocabulary (at most k terms) is all that the driver and the plan hold. A null text has no terms.
    """
    base = docs.select(id_col, "text")
    terms, idf = _fitted(base, lo, hi, k)
    if not terms:
        return base.select(id_col, F.lit("").alias("term"), F.lit(0).cast("bigint").alias("tf"), F.lit(0.0).alias("weight")).limit(0)
    known = docs.sparkSession.createDataFrame([(terms,)], "terms array<string>")
    weigh = F.arrow_udf(_long_weights(lo, hi, terms, np.asarray(idf)), "array<struct<i:int,n:bigint,w:double>>")
    each = base.select(F.col(id_col).alias("_id"), weigh(F.lower("text")).alias("t"))
    long = each.select("_id", F.inline_outer("t")).where("i IS NOT NULL")
    return long.select(F.col("_id").alias(id_col), F.get(known.select("terms").scalar(), F.col("i")).alias("term"),
                       F.col("n").alias("tf"), F.col("w").alias("weight"))


def lists(row: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """One list per row of `n`, from values in order of their rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


def _unit_weights(row: np.ndarray, term: np.ndarray, n: np.ndarray, rows: int, idf: np.ndarray) -> np.ndarray:
    """Sublinear tf-idf weights of unit length per row."""
    w = (1.0 + np.log(n)) * idf[term]
    norm = np.sqrt(np.bincount(row, w * w, rows))
    return w / np.where(norm == 0, 1.0, norm)[row]


def _long_weights(lo: int, hi: int, terms: list[str], idf: np.ndarray):
    grams = WordGrams(lo, hi, terms)

    def weigh(texts: pa.Array) -> pa.Array:
        out = []
        for part in _by_text(texts):
            row, term, n = grams.counts(part)
            cells = pa.StructArray.from_arrays([pa.array(term, pa.int32()), pa.array(n, pa.int64()), pa.array(
                _unit_weights(row, term, n, len(part), idf))], names=["i", "n", "w"])
            out.append(lists(row, len(part), cells))
        return pa.concat_arrays(out)

    return weigh


def sparse_vectors(size: int, indices: pa.ListArray, values: pa.ListArray) -> pa.StructArray:
    """Sparse vectors as `VectorUDT` holds them."""
    n = len(indices)
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), indices, values], names=["type", "size", "indices", "values"])


def cells_of(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of an array of sparse vectors."""
    indices = vectors.field("indices")
    row = np.repeat(np.arange(len(vectors)), indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return row, indices.flatten().to_numpy(zero_copy_only=False), vectors.field("values").flatten().to_numpy(zero_copy_only=False)


def by_cells(vectors: pa.StructArray) -> Iterator[pa.StructArray]:
    return pieces(vectors, vectors.field("indices").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), PIECE)


class Lowered(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A text column in lower case."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), F.lower(self.getInputCol()))


class NgramCounter(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Lower-cased texts to sparse vectors of how often each term of the vocabulary stands among the n-grams of their words."""

    lo = Param(Params._dummy(), "lo", "shortest n-gram", typeConverter=TypeConverters.toInt)
    hi = Param(Params._dummy(), "hi", "longest n-gram", typeConverter=TypeConverters.toInt)
    terms = Param(Params._dummy(), "terms", "the vocabulary", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, lo=None, hi=None, terms=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def vocabulary(self) -> list[str]:
        return self.getOrDefault(self.terms)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size = len(self.vocabulary)
        grams = WordGrams(self.getOrDefault(self.lo), self.getOrDefault(self.hi), self.vocabulary)

        def count(texts: pa.Array) -> pa.Array:
            out = []
            for part in _by_text(texts):
                row, term, n = grams.counts(part)
                out.append(sparse_vectors(size, lists(row, len(part), pa.array(term, pa.int32())),
                                          lists(row, len(part), pa.array(n, pa.float64()))))
            return pa.concat_arrays(out)

        return dataset.withColumn(self.getOutputCol(), F.arrow_udf(count, VectorUDT())(F.col(self.getInputCol())))


class TfidfScaler(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term-count vectors to sublinear tf-idf vectors of unit length, in Arrow batches."""

    idf = Param(Params._dummy(), "idf", "weight per term", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, idf=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        idf = np.asarray(self.getOrDefault(self.idf))

        def scale(vectors: pa.Array) -> pa.Array:
            out = []
            for part in by_cells(vectors):
                row, term, n = cells_of(part)
                w = pa.array(_unit_weights(row, term, n, len(part), idf))
                out.append(sparse_vectors(len(idf), lists(row, len(part), pa.array(term, pa.int32())), lists(row, len(part), w)))
            return pa.concat_arrays(out)

        kept = [c for c in dataset.columns if c != self.getInputCol()]
        return dataset.select(*kept, self.getInputCol()).withColumn(
            self.getOutputCol(), F.arrow_udf(scale, VectorUDT())(F.col(self.getInputCol())))


def _fitted(texts: DataFrame, lo: int, hi: int, k: int) -> tuple[list[str], list[float]]:
    """The k most frequent terms and their inverse document frequencies."""
    rows = _vocabulary_with_df(texts, lo, hi, k).collect()
    n = texts.count()
    return [r.term for r in rows], [math.log((1 + n) / (1 + r.df)) + 1 for r in rows]


def fit_text_vectors(texts: DataFrame, lo: int, hi: int, k: int, output: str = "features") -> PipelineModel:
    """Vectoriser of a `text` column. The driver holds the vocabulary only: at most k terms."""
    terms, idf = _fitted(texts, lo, hi, k)
    return PipelineModel([
        Lowered(inputCol="text", outputCol="_lower"),
        NgramCounter(inputCol="_lower", outputCol="_counts", lo=lo, hi=hi, terms=terms),
        TfidfScaler(inputCol="_counts", outputCol=output, idf=idf)])
