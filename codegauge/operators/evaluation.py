"""Hand-made features, the rule model and classifier reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codegauge.functions import features as X


def extract_features(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return df.select(*keep, *X.features(F.col("code"), F.col("lang")))


def rule_probability(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep.., p_bug, prediction). The features stay a projection of their own, so none is matched twice."""
    return extract_features(df, keep).select(*keep, X.probability().alias("p_bug")).withColumn(
        "prediction", X.predicted(F.col("p_bug")))


def rule_accuracy(df: DataFrame, label_col: str = "has_bug") -> DataFrame:
    scored = rule_probability(df, ("doc_id", label_col))
    hit = (F.col("prediction") == F.col(label_col)).cast("int")
    return scored.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def classification_report(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support): both classes, accuracy, macro and weighted mean.

    One partial aggregation of four counters; the rest is arithmetic on the single result row.
    """
    y, p = F.col(label_col) == 1, F.col(pred_col) == 1
    counts = pred.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                      F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def scores(hit: Column, false_hit: Column, missed: Column) -> list[Column]:
        precision, recall = _ratio(hit, hit + false_hit), _ratio(hit, hit + missed)
        return [precision, recall, _ratio(2 * precision * recall, precision + recall)]

    def row(name: str, values: list[Column], support: Column) -> Column:
        named = [v.cast("double").alias(n) for v, n in zip(values, ("precision", "recall", "f1"))]
        return F.struct(F.lit(name).alias("class"), *named, support.cast("bigint").alias("support"))

    clean, bug = scores(tn, fn, fp), scores(tp, fp, fn)
    n_clean, n_bug, total = tn + fp, tp + fn, tp + fp + fn + tn
    accuracy = _ratio(tp + tn, total)
    macro = [(a + b) / 2 for a, b in zip(clean, bug)]
    weighted = [_ratio(a * n_clean + b * n_bug, total) for a, b in zip(clean, bug)]
    return counts.select(F.inline(F.array(
        row("clean", clean, n_clean), row("bug", bug, n_bug), row("accuracy", [accuracy] * 3, total),
        row("macro avg", macro, total), row("weighted avg", weighted, total))))


def balanced_weights(df: DataFrame, label_col: str = "has_bug") -> DataFrame:
    """Adds `weight` = n / (2 * n_class) for a 0/1 label.

    The class counts are one row, read as a scalar subquery: no join, whatever the class sizes.
    """
    counts = df.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label_col) == 1).alias("ones")).alias("counts")).scalar()
    n, ones = counts["n"], counts["ones"]
    size = F.when(F.col(label_col) == 1, ones).otherwise(n - ones)
    return df.withColumn("weight", n / (size * 2))
