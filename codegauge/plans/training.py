"""From a corpus file to two stored models and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codegauge.functions import ngrams as N
from codegauge.operators import corpus, evaluation, models

MODELS = ("basic", "advanced")


def training_report(existing: DataFrame, extra: DataFrame, root: str, trees: int = models.TREES) -> DataFrame:
    """(model, class, precision, recall, f1, support, in_range, beats_majority), five rows per model.

    `existing` and `extra` are corpora with `row_no`. Stages, each stored below `root` and read again by the next: `split`
    (expanded corpus without blank codes, 80/20 by label), `models`, `predictions` (every held-out row under every model). A
    lost executor or a second look at a stage never trains again. `in_range`: all probabilities lie in 0 to 1 and none is missing;
    `beats_majority`: more held-out rows are right than the larger class has. Without held-out rows both are false and supports 0.
    """
    spark = existing.sparkSession
    rows = corpus.non_blank(corpus.expand_ordered(existing, extra)).select("row_no", F.col("language").alias("lang"), "code", "has_bug")
    corpus.stratified_split(rows, id_col="row_no").write.parquet(f"{root}/split")
    split = spark.read.parquet(f"{root}/split")
    train = split.where(~F.col("is_test")).withColumn("text", N.model_text(F.col("code"), F.col("lang")))
    models.save_models(f"{root}/models", basic=models.train_basic(train), advanced=models.train_advanced(train, trees))
    held_out = split.where("is_test").select("row_no", "lang", "code", "has_bug")
    for name in MODELS:
        models.predict_proba(held_out, models.load_model(f"{root}/models", name)).select("row_no", "has_bug", "p_bug") \
            .write.parquet(f"{root}/predictions/model={name}")
    predicted = spark.read.parquet(f"{root}/predictions")
    return _report(predicted, MODELS[0]).unionByName(_report(predicted, MODELS[1]))


def _report(predicted: DataFrame, model: str) -> DataFrame:
    """The class rows of one model; its two facts are one row, read as scalar subqueries."""
    rows = predicted.where(F.col("model") == model).select(
        F.col("has_bug").alias("label"), (F.col("p_bug") > 0.5).cast("int").alias("prediction"), "p_bug")
    right, bugs, n = F.count_if(F.col("label") == F.col("prediction")), F.count_if(F.col("label") == 1), F.count(F.lit(1))
    facts = rows.agg(F.struct(
        ((n > 0) & (F.count_if(F.col("p_bug").between(0, 1)) == n)).alias("in_range"),
        (right > F.greatest(bugs, n - bugs)).alias("beats_majority")).alias("facts")).scalar()
    return evaluation.classification_report(rows.drop("p_bug")).select(
        F.lit(model).alias("model"), "*", facts["in_range"].alias("in_range"), facts["beats_majority"].alias("beats_majority"))
