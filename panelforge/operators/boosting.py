"""Gradient boosting over Spark's regression trees: counts by squared error, classes jointly by softmax.

Each round fits one tree (or one for each class) to the gradients of all rows so far, weighed by the second derivatives, so
that a leaf takes a Newton step. Losses of training and validation rows are kept a round, and one stop counts for all
classes: so many rounds without a better validation loss.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage
from .together import at_once

#: Rounds between checkpoints of the scores.
EVERY = 4
LEAST_WEIGHT = 1e-6


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the vector __x of the columns; unknown values become 0 with an indicator beside them, so trees can tell."""
    filled = {f"__f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(columns)}
    known = {f"__k{i}": F.col(c).isNull().cast("double") for i, c in enumerate(columns)}
    names = [*filled, *known]
    return VectorAssembler(inputCols=names, outputCol="__x").transform(df.withColumns(filled | known)).drop(*names)


def softmax(scores: list[Column]) -> list[Column]:
    most = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - most) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


@dataclass
class Boosted:
    """columns: inputs; labels: the classes (none: counts); start: score before the first round, one a class; trees: a list a
    round; curve: (round, training loss, validation loss) of every round, also of those after the best."""

    columns: list[str]
    labels: list[int]
    start: list[float]
    step: float
    trees: list[list] = field(default_factory=list)
    curve: list[tuple[int, float, float | None]] = field(default_factory=list)

    def scores(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df with the score of each class, or of the count, under these names."""
        out = assembled(df, self.columns)
        for r, models in enumerate(self.trees):
            for k, model in enumerate(models):
                out = model.setPredictionCol(f"__t{r}_{k}").transform(out)
        sums = {n: sum((self.step * F.col(f"__t{r}_{k}") for r in range(len(self.trees))), F.lit(self.start[k])) for k, n in enumerate(names)}
        return out.withColumns(sums).drop("__x", *[f"__t{r}_{k}" for r in range(len(self.trees)) for k in range(len(self.start))])

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the predicted count, not below 0."""
        return self.scores(df, ["__s"]).withColumn(name, F.greatest(F.col("__s"), F.lit(0.0))).drop("__s")

    def probabilities(self, df: DataFrame, classes: int) -> DataFrame:
        """df with p_0, p_1 and so on, which sum to 1 as they come, and ``predicted``; classes never seen have 0."""
        names = [f"__s{k}" for k in range(len(self.labels))]
        out = self.scores(df, names)
        share = dict(zip(self.labels, softmax([F.col(n) for n in names]), strict=True))
        out = out.withColumns({f"p_{k}": share.get(k, F.lit(0.0)) for k in range(classes)})
        best = F.array_max(F.array(*[F.struct(F.col(f"p_{k}").alias("p"), F.lit(-k).alias("k")) for k in range(classes)]))["k"]
        return out.withColumn("predicted", -best).select(*df.columns, *[f"p_{k}" for k in range(classes)], "predicted")


def boost(df: DataFrame, target: str, columns: list[str], validation: Column | None = None, classes: bool = False, rounds: int = 20, patience: int = 5, depth: int = 5, step: float = 0.1, subsample: float = 0.8, least_rows: int = 1, seed: int = 42) -> Boosted:
    """Fit on the rows with a target; validation marks those that are only measured.

    Stops after ``patience`` rounds without a lower validation loss (root mean squared error, or log loss of the classes)
    and keeps the rounds up to the best one. Without validation rows all rounds are kept. Of an empty table the score is 0.
    """
    rows = assembled(df.where(F.col(target).isNotNull()), columns)
    rows = rows.select("__x", F.col(target).cast("double").alias("__y"), (F.lit(False) if validation is None else F.coalesce(validation, F.lit(False))).alias("__v"))
    own = rows.where("not __v")
    if classes:
        counts = {int(r[0]): r[1] for r in own.groupBy("__y").count().collect()}  # a row a class
        labels, total = sorted(counts), sum(counts.values())
        start = [math.log(counts[k] / total) for k in labels]
    else:
        mean = own.agg(F.avg("__y")).first()[0]
        labels, start = [], [mean or 0.0]
    fitted = Boosted(columns, labels, start, step)
    if len(labels) < 2 if classes else mean is None:
        return fitted
    names = [f"__s{k}" for k in range(len(start))]
    rows = cut_lineage(rows.withColumns({n: F.lit(s) for n, s in zip(names, start, strict=True)}))
    best, best_at = math.inf, 0
    for r in range(rounds):
        if classes:
            share = softmax([F.col(n) for n in names])
            gradient = [(F.col("__y") == k).cast("double") - p for k, p in zip(labels, share, strict=True)]
            weight = [F.greatest(p * (1 - p), F.lit(LEAST_WEIGHT)) for p in share]
        else:
            gradient, weight = [F.col("__y") - F.col(names[0])], [F.lit(1.0)]
        sample = rows.where("not __v").sample(subsample, seed + r)

        def tree(k: int, sample=sample, gradient=gradient, weight=weight, r=r):
            data = sample.select("__x", (gradient[k] / weight[k]).alias("__g"), weight[k].alias("__w"))
            return DecisionTreeRegressor(featuresCol="__x", labelCol="__g", weightCol="__w", maxDepth=depth, minInstancesPerNode=least_rows, seed=seed + r).fit(data)

        models = at_once(tree, range(len(names)))
        for k, model in enumerate(models):
            rows = model.setPredictionCol(f"__t{k}").transform(rows)
        rows = rows.withColumns({n: F.col(n) + step * F.col(f"__t{k}") for k, n in enumerate(names)}).drop(*[f"__t{k}" for k in range(len(names))])
        if (r + 1) % EVERY == 0:
            rows = cut_lineage(rows)
        fitted.trees.append(models)
        losses = dict(rows.groupBy("__v").agg(_loss(labels, names)).collect())
        fitted.curve.append((r + 1, losses.get(False), losses.get(True)))
        if losses.get(True) is not None:
            if losses[True] < best:
                best, best_at = losses[True], r + 1
            elif r + 1 - best_at >= patience:
                break
    if best_at:
        del fitted.trees[best_at:]
    return fitted


def _loss(labels: list[int], names: list[str]) -> Column:
    if not labels:
        return F.sqrt(F.avg((F.col("__y") - F.col(names[0])) ** 2))
    own = F.coalesce(*[F.when(F.col("__y") == k, p) for k, p in zip(labels, softmax([F.col(n) for n in names]), strict=True)], F.lit(0.0))
    return -F.avg(F.log(F.greatest(own, F.lit(1e-15))))
