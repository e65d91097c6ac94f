"""Forecasts of a panel: splits, boosted-tree fits, horizons, walk-forward, search, and attribution."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .boosting import Boosted, assembled, boost
from .metrics import paired_t, regression_metrics
from .sampling import hash_order
from .together import at_once
from .windows import leads

#: Last years of the training and of the validation split.
TRAIN_UNTIL, VALIDATE_UNTIL = 2019, 2022
#: Search ranges: (low, high, kind). The surveyed search draws eight parameters; Spark's trees have no penalties of leaf
#: weights, so the least gain of a split stands for the first and the number of bins takes the place of the second.
SPACE = {
    "maxDepth": (3, 8, "int"), "stepSize": (0.01, 0.3, "log"), "maxIter": (10, 60, "int"), "subsamplingRate": (0.6, 1.0, "real"),
    "featureSubsetStrategy": (0.6, 1.0, "share"), "minInstancesPerNode": (1, 20, "int"), "minInfoGain": (1e-8, 1e-1, "log"), "maxBins": (16, 64, "int"),
}


def split_by_year(year: Column, train_until: int = TRAIN_UNTIL, validate_until: int = VALIDATE_UNTIL) -> Column:
    return F.when(year <= train_until, "train").when(year <= validate_until, "validation").otherwise("test")


@dataclass
class Regressor:
    columns: list[str]
    model: object

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the prediction, not below 0."""
        out = self.model.setPredictionCol("__p").transform(assembled(df, self.columns))
        return out.withColumn(name, F.greatest(F.col("__p"), F.lit(0.0))).drop("__x", "__p")

    def importances(self) -> list[tuple[str, float]]:
        """Importance of each column, its indicator included."""
        v, n = self.model.featureImportances.toArray(), len(self.columns)
        return [(c, float(v[i] + v[n + i])) for i, c in enumerate(self.columns)]


def fit_counts(df: DataFrame, target: str, columns: list[str], validation: Column | None = None, seed: int = 42, **params) -> Regressor:
    """Spark's boosted regression trees on rows with a target; validation marks the rows that stop training early.

    They stop by Spark's tolerance; ``boosting.boost`` stops by rounds without improvement and keeps both losses.
    """
    options = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8} | params
    rows = assembled(df.where(F.col(target).isNotNull()).withColumn("__y", F.col(target).cast("double")), columns)
    trainer = GBTRegressor(featuresCol="__x", labelCol="__y", seed=seed, **options)
    if validation is not None:
        rows = rows.withColumn("__v", validation)
        trainer = trainer.setParams(validationIndicatorCol="__v")
    return Regressor(columns, trainer.fit(rows))


def training_curve(fitted: Boosted, spark: SparkSession) -> DataFrame:
    """Root mean squared errors of the training and the validation rows after each round, and whether it was kept."""
    rows = [(i, train, held, i <= len(fitted.trees)) for i, train, held in fitted.curve]
    return spark.createDataFrame(rows, "round int, train_rmse double, val_rmse double, kept boolean")


#: Parameters of ``boosting.boost`` by the names of Spark's boosting.
_OWN_NAMES = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "step", "subsamplingRate": "subsample", "minInstancesPerNode": "least_rows"}


def classify_risk(train: DataFrame, test: DataFrame, target: str, columns: list[str], validation: Column | None = None, classes: int = 4, **params) -> DataFrame:
    """test with the predicted class and the probability of each class, of one model of all classes.

    validation marks the rows of train that stop it early; params: rounds, patience and more of ``boosting.boost``, or the
    names that Spark's boosting has for them, as in ``fit_counts``. A class that train lacks has probability 0; with one
    class only, that one has 1.
    """
    fitted = boost(train, target, columns, validation, classes=True, **{_OWN_NAMES.get(k, k): v for k, v in params.items()})
    if len(fitted.labels) < 2:
        only = fitted.labels[0] if fitted.labels else 0
        return test.withColumns({f"p_{k}": F.lit(float(k in fitted.labels)) for k in range(classes)} | {"predicted": F.lit(only)})
    return fitted.probabilities(test, classes)


@dataclass
class Means:
    """The simplest forecast: the mean target of the training rows that agree in the keys."""

    keys: list[str]
    table: DataFrame

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the mean of its keys; null where the training rows had none."""
        return df.join(self.table.withColumnRenamed("__mean", name), self.keys, "left")


def fit_means(df: DataFrame, target: str, keys: list[str]) -> Means:
    return Means(keys, df.where(F.col(target).isNotNull()).groupBy(*keys).agg(F.avg(F.col(target).cast("double")).alias("__mean")))


def compared(df: DataFrame, target: str, without: str, full: str, alpha: float = 0.05) -> DataFrame:
    """Errors of two predictions of the same rows, the change in percent, and the paired t test of the squared errors."""
    errors = df.select(((F.col(target) - F.col(without)) ** 2).alias("e0"), ((F.col(target) - F.col(full)) ** 2).alias("e1")).dropna()
    scores = errors.agg(F.sqrt(F.avg("e0")).alias("rmse_without"), F.sqrt(F.avg("e1")).alias("rmse_full"))
    both = scores.crossJoin(paired_t(errors, "e0", "e1"))
    return both.withColumns({"delta_pct": F.try_divide(F.lit(100.0) * (F.col("rmse_full") - F.col("rmse_without")), F.col("rmse_without")), "improvement": ((F.col("t") > 0) & (F.col("p_value") < alpha)).cast("int")})


def ablation(df: DataFrame, target: str, columns: list[str], family: str, split: str = "split", alpha: float = 0.05, **params) -> DataFrame:
    """Errors with and without the columns of a family (by prefix), the change in percent, and t of the squared errors.

    improvement: leaving the family in lowers the squared errors, by a two-sided paired t test with p below alpha.
    """
    rest = [c for c in columns if not c.startswith(family)]
    train, test = df.where(F.col(split) == "train"), df.where(F.col(split) == "test")
    out = fit_counts(train, target, rest, **params).predict(test, "without")
    out = fit_counts(train, target, columns, **params).predict(out, "full")
    return compared(out, target, "without", "full", alpha)


def multi_horizon(df: DataFrame, value: str, entity: list[str], period: list[str], columns: list[str], year: str, horizons: tuple = (1, 2, 4, 8), train_until: int = TRAIN_UNTIL, limit: float = 2.0, fit: Callable | None = None, **params) -> DataFrame:
    """Test metrics of one fit a horizon, each rmse over that of the first, and whether that stays below ``limit``.

    fit: from training rows with ``target`` to what predicts (default: boosted trees of the columns).
    """
    make = fit or (lambda rows: fit_counts(rows, "target", columns, **params))

    def one(h: int) -> DataFrame:
        rows = leads(df, value, entity, period, h)
        fitted = make(rows.where(F.col(year) <= train_until))
        return fitted.predict(rows.where(F.col(year) > train_until)).select(F.lit(h).alias("horizon"), "target", "prediction")

    out = regression_metrics(reduce(DataFrame.unionByName, at_once(one, horizons)), "target", "prediction", ["horizon"])
    return with_ratios(out, limit)


def with_ratios(horizons: DataFrame, limit: float = 2.0) -> DataFrame:
    """A small table of horizons and rmse with each rmse over the first one's, and 1 where that is below the limit."""
    out = horizons.withColumn("rmse_ratio", F.try_divide("rmse", F.first("rmse").over(Window.partitionBy(F.lit(0)).orderBy("horizon"))))
    return out.withColumn("within_limit", (F.col("rmse_ratio") < limit).cast("int"))


def folds(years: list[int], first_after: int = 5, step: int = 3) -> list[dict]:
    """Expanding folds: every third year from the fifth after the first, and the last; the year before validates."""
    years = sorted(years)
    start = years[0] + first_after
    chosen = [y for y in years if y >= start and (y - start) % step == 0]
    if years[-1] >= start and years[-1] not in chosen:
        chosen.append(years[-1])
    return [{"test_year": y, "validation_year": y - 1, "train_until": y - 2} for y in chosen]


def fold_rows(df: DataFrame, year: str, first_after: int = 5, step: int = 3) -> DataFrame:
    """Per fold: its years, and the rows that train, validate and test it."""
    counts = df.groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    plan = df.sparkSession.createDataFrame([(f["test_year"], f["validation_year"], f["train_until"]) for f in folds([r[0] for r in counts.collect()], first_after, step)], "test_year int, validation_year int, train_until int")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    y = F.col(year)
    met = counts.join(F.broadcast(plan), y <= F.col("test_year"))  # a row a year and fold
    return met.groupBy(*plan.columns).agg(part(y <= F.col("train_until")).alias("n_train"), part(y == F.col("validation_year")).alias("n_validation"), part(y == F.col("test_year")).alias("n_test"))


def walk_forward(df: DataFrame, target: str, columns: list[str], year: str, first_after: int = 5, step: int = 3, fit: Callable | None = None, **params) -> DataFrame:
    """Metrics of each fold's test year.

    fit: from the rows up to the validation year and the condition that marks that year's rows to what predicts (default:
    boosted trees of the columns).
    """
    make = fit or (lambda rows, validation: fit_counts(rows, target, columns, validation, **params))
    years = [r[0] for r in df.select(year).distinct().collect()]

    def one(f: dict) -> DataFrame:
        fitted = make(df.where(F.col(year) <= f["validation_year"]), F.col(year) == f["validation_year"])
        return fitted.predict(df.where(F.col(year) == f["test_year"])).select(F.lit(f["test_year"]).alias("test_year"), target, "prediction")

    chosen = folds(years, first_after, step)
    if not chosen:
        raise ValueError("too few years for a fold")
    return regression_metrics(reduce(DataFrame.unionByName, at_once(one, chosen)), target, "prediction", ["test_year"])


def stability(fold_metrics: DataFrame, metric: str = "rmse", limit: float = 30.0) -> DataFrame:
    """Mean, deviation and coefficient of variation (percent) of a metric over folds, and whether it is below the limit."""
    cv = F.lit(100.0) * F.try_divide(F.stddev_pop(metric), F.avg(metric))
    return fold_metrics.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), cv.alias("cv_pct"), (cv < limit).cast("int").alias("stable"))


def draws(trials: int, space: dict = SPACE, seed: int = 42) -> list[dict]:
    """Seeded random parameter sets."""
    rng, out = random.Random(seed), []
    for _ in range(trials):
        one = {}
        for name, (low, high, kind) in space.items():
            if kind == "int":
                one[name] = rng.randint(low, high)
            elif kind == "log":
                one[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            elif kind == "share":
                one[name] = f"{rng.uniform(low, high):.4f}"
            else:
                one[name] = rng.uniform(low, high)
        out.append(one)
    return out


def search(train: DataFrame, validation: DataFrame, target: str, columns: list[str], trials: int = 20, space: dict = SPACE, seed: int = 42, base: dict | None = None) -> DataFrame:
    """Validation rmse of each drawn parameter set, best first, beside that of the base parameters and the change in percent."""

    def rmse(params: dict) -> float:
        scored = fit_counts(train, target, columns, seed=seed, **params).predict(validation)
        return regression_metrics(scored, target, "prediction").first()["rmse"]

    drawn = draws(trials, space, seed)
    first, *found = at_once(rmse, [base or {}, *drawn])
    rows = [(i, v, first, 100.0 * (first - v) / first if first else 0.0, repr(p)) for i, (v, p) in enumerate(zip(found, drawn, strict=True))]
    return train.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[1]), "trial int, rmse double, baseline_rmse double, improvement_pct double, params string")


def permutation_importance(fitted: Regressor, df: DataFrame, target: str, keys: list[str], family: str | None = None, parts: int = 64, seed: int = 42) -> DataFrame:
    """Rise of the rmse when a column's values move to other rows, ranked; family: prefix to flag.

    Rows get a partner inside their hash part (the next one in hash order, round), so no task holds all rows.
    """
    rows = df.where(F.col(target).isNotNull())
    part = F.pmod(F.crc32(hash_order(keys, seed).cast("binary")), F.lit(parts))
    w = Window.partitionBy(part).orderBy(hash_order(keys, seed + 1), *keys)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(everything)) for c in fitted.columns}
    rows = rows.withColumns({f"__moved{i}": moved[c] for i, c in enumerate(fitted.columns)})
    # Rows with every column as it is, and once for each column with that one moved: scored and measured in one job.
    each = [F.struct(F.lit(i).alias("of"), *[F.col(f"__moved{k}" if k == i else c).alias(c) for k, c in enumerate(fitted.columns)]) for i in range(-1, len(fitted.columns))]
    versions = rows.select(F.col(target).alias("__target"), F.explode(F.array(*each)).alias("v")).select("__target", "v.*")
    found = {r["of"]: r["rmse"] for r in regression_metrics(fitted.predict(versions), "__target", "prediction", ["of"]).collect()}
    out = [(c, found[i] - found[-1], bool(family and c.startswith(family))) for i, c in enumerate(fitted.columns)]
    table = df.sparkSession.createDataFrame(out, "feature string, importance double, in_family boolean")
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")))
