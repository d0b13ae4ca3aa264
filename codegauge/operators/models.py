"""Training, prediction and storage of the two bug classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from codegauge.functions import ngrams as N
from codegauge.operators import boosting, bundles, corpus, evaluation, textvec
from codegauge.sources.folders import Folder

TREES, DEPTH, RATE, SEED = 120, 4, 0.1, 42
TOLERANCE = 1e-4
#: Text bytes and rows of a task that makes vectors, and cells of a task of the trees at most.
TEXT_BYTES, ROWS, CELLS = 4 << 20, 1 << 15, 1 << 26
VERSION, DONE = "version-", "done-"


def with_text(df: DataFrame, code: str = "code", lang: str = "lang") -> DataFrame:
    return df.withColumn("text", N.model_text(F.col(code), F.col(lang)))


def _spread(train: DataFrame) -> tuple[DataFrame, int, int]:
    """Training rows dealt to as many tasks as their text and number need, so that what a task holds of the vectors does not grow
    with the table; with the numbers of rows and tasks."""
    n, size = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_BYTES), -(-n // ROWS))
    return train.repartition(parts), n, parts


def train_basic(train: DataFrame, max_iter: int = 1000) -> PipelineModel:
    """Logistic regression on 2-4 grams: L2 with C = 1, balanced classes.

    The vectors are not kept here: the regression reads them twice and iterates over blocks that it keeps itself.
    """
    lo, hi, k = textvec.BASIC
    vectoriser = textvec.fit_text_vectors(train, lo, hi, k)
    rows, n, _ = _spread(evaluation.balanced_weights(train, "has_bug").select(
        "text", "weight", F.col("has_bug").cast("double").alias("label")))
    fitted = LogisticRegression(
        maxIter=max_iter, tol=TOLERANCE, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False,
        weightCol="weight").fit(vectoriser.transform(rows).select("label", "weight", "features"))
    return PipelineModel([*vectoriser.stages, fitted])


def train_advanced(train: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """Boosted trees on 2-5 grams. All terms of the vocabulary take part: terms that never meet share a
    column, which bounds the cost of a split search (`codegauge.operators.bundles`)."""
    lo, hi, k = textvec.ADVANCED
    vectoriser = textvec.fit_text_vectors(train, lo, hi, k, output="wide")
    lowered, counter, scaler = vectoriser.stages
    train, n, _ = _spread(train.select("text", F.col("has_bug").cast("double").alias("label")))
    # the scaler replaces the counts it reads, so they are kept under another name for the signatures
    counted = counter.transform(lowered.transform(train))
    rows = scaler.transform(counted.select("label", F.xxhash64("text").alias("key"), "_counts", F.col("_counts").alias("counts")))
    packed = bundles.pack(rows.select("label", "key", "counts", "wide")).persist(StorageLevel.DISK_ONLY)
    try:
        slots = min(bundles.SLOTS, n)
        bundler, usual, cells = bundles.fit_packed(packed, len(counter.vocabulary), levels=max(1, min(bundles.LEVELS, slots - 1)), slots=slots)
        shape = boosting.Shape(np.array(bundler.getOrDefault(bundler.sizes), np.int64), np.array(usual, np.int64))
        tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-cells // CELLS))
        grown = boosting.grow_trees(_binned(packed, bundler, shape).coalesce(tasks), shape, trees, depth, RATE)
    finally:
        packed.unpersist()
    fitted = boosting.to_model(train.sparkSession, grown, shape, maxIter=trees, maxDepth=depth, stepSize=RATE, seed=SEED,
                               maxBins=bundles.SLOTS)
    return PipelineModel([*vectoriser.stages, bundler, fitted])


def _binned(packed: RDD, bundler: bundles.TermBundler, shape: boosting.Shape) -> RDD:
    """Packed training rows as blocks of the trees."""
    categories = bundler.categoriser()
    return packed.map(lambda b: boosting.make_block(b.label, *categories(b.row, b.term, bundles.weights(b.weight)), shape))


def _p_bug(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    scored = model.transform(with_text(df))
    return scored.select(*keep, vector_to_array("probability")[1].alias("p_bug"))


def predict_proba(df: DataFrame, advanced: PipelineModel | None = None,
                  basic: PipelineModel | None = None) -> DataFrame:
    """Adds `p_bug` from the advanced model if there is one, else the basic one, else NULL."""
    model = advanced or basic
    if model is None:
        return df.withColumn("p_bug", F.lit(None).cast("double"))
    return _p_bug(model, df, df.columns)


class IncompleteModel(Exception):
    """A model was begun to be stored, and no version of it was finished."""


def save_models(path: str, **models: PipelineModel) -> None:
    """Every model becomes a new version, which counts once its marker stands; older versions are removed then."""
    for name, model in models.items():
        folder = Folder(_session(), f"{path}/{name}")
        number = 1 + max((int(v.removeprefix(VERSION)) for v in folder.names() if v.startswith(VERSION)), default=0)
        model.write().save(f"{path}/{name}/{VERSION}{number}")
        folder.commit_text(f"{DONE}{number}", "")
        for old in folder.names():
            if old not in (f"{VERSION}{number}", f"{DONE}{number}"):
                folder.delete(old)


def load_model(path: str, name: str) -> PipelineModel | None:
    """The newest finished version of a stored model, or None where there is none. A model that was begun and never finished
    raises; any other failure to read a finished version does as well."""
    folder = Folder(_session(), f"{path}/{name}")
    entries = folder.names()
    done = [int(entry.removeprefix(DONE)) for entry in entries if entry.startswith(DONE) and entry.removeprefix(DONE).isdigit()]
    if done:
        return PipelineModel.load(f"{path}/{name}/{VERSION}{max(done)}")
    if any(entry.startswith(VERSION) for entry in entries):
        raise IncompleteModel(f"{path}/{name}")
    return None


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@dataclass
class TrainReport:
    basic: PipelineModel
    advanced: PipelineModel
    report: DataFrame


def holdout(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): the seeded 80/20 split by label, with the model text."""
    split = with_text(corpus.stratified_split(df.select("doc_id", "lang", "code", "has_bug")))
    return split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test")


def evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    scored = predict_proba(test.drop("text"), model).select(
        F.col("has_bug").alias("label"), (F.col("p_bug") > 0.5).cast("int").alias("prediction"))
    return evaluation.classification_report(scored)


def train_report(df: DataFrame, trees: int = TREES) -> TrainReport:
    """Both models fitted on 80 % and reported on 20 %."""
    train, test = holdout(df)
    basic, advanced = train_basic(train), train_advanced(train, trees)
    name = lambda rows, model: rows.withColumn("model", F.lit(model))
    return TrainReport(basic, advanced, name(evaluate(basic, test), "basic").unionByName(
        name(evaluate(advanced, test), "advanced")))
