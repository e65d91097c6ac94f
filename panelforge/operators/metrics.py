"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import t_tail
from .ranks import running_counts


def regression_metrics(df: DataFrame, truth: str, guess: str, by: list[str] = ()) -> DataFrame:
    """rmse, mae, r2 and mape (percent, over truths above 0 only)."""
    y, p = F.col(truth), F.col(guess)
    err = y - p
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(y))).alias("r2"),
        (F.lit(100.0) * F.avg(F.when(y > 0, F.abs(err) / y))).alias("mape"),
    )


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, f1 and support of each class of truth or guess."""
    cells = confusion(df, truth, guess)
    hits = cells.where(F.col(truth) == F.col(guess)).select(F.col(truth).alias("class"), F.col("n").alias("hit"))
    actual = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"))
    said = cells.groupBy(F.col(guess).alias("class")).agg(F.sum("n").alias("said"))
    out = actual.join(said, "class", "full_outer").join(hits, "class", "left").fillna(0, ["support", "said", "hit"])
    precision, recall = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return out.select("class", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), "support")


def with_macro(classes: DataFrame) -> DataFrame:
    """class_metrics with a last row of null class: the plain means of precision, recall and f1, and all support."""
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    whole = classes.agg(*means, F.sum("support").alias("support"))
    return classes.unionByName(whole.withColumn("class", F.lit(None).cast(classes.schema["class"].dataType)))


def macro_auc(df: DataFrame, truth: str, scores: dict) -> DataFrame:
    """One-vs-rest AUC of each class from its score, with tied ranks averaged, and their mean in the row of null class.

    Rank sums come from one grouping by class and distinct score and from running counts by ranges of scores, for all
    classes at once.
    """
    labels = list(scores)
    rows = df.select(truth, *[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(scores.values())]).unpivot([truth], [f"s{i}" for i in range(len(labels))], "of", "s")
    label = F.create_map(*[F.lit(x) for i, k in enumerate(labels) for x in (f"s{i}", k)])[F.col("of")]
    by = rows.where("s is not null").groupBy(label.alias("class"), "s").agg(F.count_if(F.col(truth) == label).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = running_counts(by, ["class"], "s").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)
    p, n = F.sum("pos"), F.sum("n") - F.sum("pos")
    out = ranked.groupBy("class").agg(F.try_divide(F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2.0, (p * n).cast("double")).alias("auc"))
    return out.unionByName(out.agg(F.avg("auc").alias("auc")).select(F.lit(None).cast(out.schema["class"].dataType).alias("class"), "auc"))


def paired_t(df: DataFrame, first: str, second: str) -> DataFrame:
    """t of the mean difference of two columns, its two-sided p-value, and the count."""
    d = F.col(first) - F.col(second)
    out = df.agg(F.avg(d).alias("mean_difference"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d))).alias("t"), F.count(d).alias("n"))
    return out.withColumn("p_value", t_tail(F.col("t"), F.col("n") - 1))
