"""Feature scores against a class, and their composite ranking."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import f_tail
from .profile import melted
from .ranks import key_quantiles


def anova_f(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """F statistic of each column between the classes and its p-value: one aggregation of counts, sums and squares."""
    g = melted(df, columns, [label]).where(F.col("value").isNotNull()).groupBy("feature", label).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    n, k = F.sum("n"), F.count(F.lit(1))
    mean = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * mean * mean
    within = F.sum(F.col("n") * F.col("v"))
    out = g.groupBy("feature").agg(F.try_divide(between / (k - 1), within / (n - k)).alias("anova_f"), (k - 1).alias("between"), (n - k).alias("within"))
    return out.withColumn("p_value", f_tail(F.col("anova_f"), F.col("between"), F.col("within"))).drop("between", "within")


def mutual_information(df: DataFrame, label: str, columns: list[str], bins: int = 10) -> DataFrame:
    """Mutual information in nats of the class and each column cut at its quantiles into equal-frequency bins."""
    cuts = {r["feature"]: r["q"] for r in key_quantiles(melted(df, columns), ["feature"], "value", [i / bins for i in range(1, bins)]).collect()}  # a row a column
    coded = [F.when(F.col(c).isNotNull(), sum((F.when(F.col(c) > F.lit(float(q)), 1).otherwise(0) for q in cuts[c]), F.lit(0))).alias(c) for c in columns if c in cuts]
    rows = df.select(label, *coded).unpivot([label], [c for c in columns if c in cuts], "feature", "bin").where("bin is not null")
    cell = rows.groupBy("feature", label, "bin").agg(F.count(F.lit(1)).alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))
    cell = cell.withColumns({"total": by(), "nx": by("bin"), "ny": by(label)})
    part = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    return cell.groupBy("feature").agg(F.sum(part).alias("mutual_information"))


def forest_importance(df: DataFrame, label: str, columns: list[str], trees: int = 50, depth: int = 6, balanced: bool = False, seed: int = 42) -> DataFrame:
    """Importance of each column in a random forest; balanced: classes weigh the same."""
    rows = df.select(F.col(label).cast("double").alias("__y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    weight = None
    if balanced:
        n = rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n"))
        total, classes = (n.agg(F.sum("n"), F.count(F.lit(1))).first())
        rows = rows.join(F.broadcast(n), "__y").withColumn("__w", F.lit(float(total)) / (F.lit(float(classes)) * F.col("n")))
        weight = {"weightCol": "__w"}
    data = VectorAssembler(inputCols=columns, outputCol="__x").transform(rows)
    model = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed, **(weight or {})).fit(data)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)], "feature string, forest_importance double")


def minmax(c: str) -> Column:
    """A column of a small table scaled to 0 to 1; constants become 0."""
    w = Window.partitionBy(F.lit(0))
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)


def composite_ranking(scores: DataFrame, columns: list[str], top: int = 25, share: float = 0.75) -> DataFrame:
    """Scaled scores, their mean, the rank by it, and the selection: among the first ``top`` or at the upper quantile."""
    out = scores.withColumns({f"{c}_norm": minmax(c) for c in columns})
    out = out.withColumn("composite_score", sum((F.col(f"{c}_norm") for c in columns), F.lit(0.0)) / len(columns))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.desc("composite_score"), "feature"))
    return out.withColumns({"rank": place, "selected": ((place <= top) | (F.col("composite_score") >= F.percentile("composite_score", share).over(everything))).cast("int")})
