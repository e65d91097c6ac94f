"""k-means profiles with ordered labels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kmeans
from .profile import numeric_columns
from .ranks import key_quantiles
from .together import at_once

#: Rows of a sample that one task of a fit holds, where the sample has as many.
TASK_ROWS = 10_000


def feature_columns(df: DataFrame, without: tuple, profile: bool = False, volume: str = "notificacoes") -> list[str]:
    """Numeric columns but keys, labels and the cluster id; profile: also without the volume's own columns."""
    kept = [c for c in numeric_columns(df, without) if not c.startswith("label_") and c != "cluster_id"]
    return [c for c in kept if not c.startswith(volume)] if profile else kept


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns standardised with the population deviation; constant columns become 0. One aggregation, then a projection."""
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return df.withColumns({c: scaled(F.col(c), stats[f"m{i}"], stats[f"s{i}"]) for i, c in enumerate(columns)})


def scaled(c: Column, mean: float | None, std: float | None) -> Column:
    return (c - F.lit(float(mean))) / F.lit(float(std)) if std else F.lit(0.0)


@dataclass
class Clusters:
    """A fitted model with what it needs to score other rows."""

    columns: list[str]
    stats: dict[str, tuple]
    model: KMeansModel
    sweep: list[tuple] = field(default_factory=list)

    def vectors(self, df: DataFrame) -> DataFrame:
        rows = df.withColumns({f"__z{i}": scaled(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), *self.stats[c]) for i, c in enumerate(self.columns)})
        return VectorAssembler(inputCols=[f"__z{i}" for i in range(len(self.columns))], outputCol="__x").transform(rows).drop(*[f"__z{i}" for i in range(len(self.columns))])

    def assign(self, df: DataFrame) -> DataFrame:
        """df with cluster_id, in one pass over all of it."""
        return nearest_center(df, self.columns, self.stats, [list(map(float, c)) for c in self.model.clusterCenters()])


def nearest_center(df: DataFrame, columns: list[str], stats: dict[str, tuple], centers: list[list[float]]) -> DataFrame:
    """df with cluster_id: the nearest of given centers in standardised columns (unknown values count as 0 before), of equally
    near ones the first."""
    z = [scaled(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), *stats[c]) for c in columns]
    near = [F.struct(sum(((x - F.lit(v)) ** 2 for x, v in zip(z, center, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, center in enumerate(centers)]
    return df.withColumn("cluster_id", F.array_min(F.array(*near))["i"])


def _filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def _stats(filled: DataFrame, columns: list[str]) -> tuple[int, dict[str, tuple]]:
    """Rows, and the mean and population deviation of each column."""
    row = filled.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return row["n"], {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def _sizes(n: int, k_min: int, k_max: int) -> list[int]:
    return list(range(k_min, max(k_min, min(k_max, n - 1)) + 1))


def sweep(df: DataFrame, columns: list[str], k_min: int = 2, k_max: int = 6) -> DataFrame:
    """Silhouette and inertia of a fit on all rows for each k (capped by the rows); no rows of no rows."""
    rows = _filled(df, columns).cache()
    try:
        n, stats = _stats(rows, columns)
        found = kmeans.sweep(rows, n, list(stats.values()), _sizes(n, k_min, k_max)) if n else []
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([f[:3] for f in found], "k int, silhouette double, inertia double")


def fit(sample: DataFrame, columns: list[str], k_min: int = 2, k_max: int = 6, seed: int = 42) -> Clusters:
    """Fit for each k (capped by the rows) and keep the best silhouette, the smallest k of equals."""
    n, stats = _stats(_filled(sample, columns), columns)
    shell = Clusters(columns, stats, None)
    # Each pass of a fit is a job: its tasks go by the rows, not by the shuffle's setting.
    data = shell.vectors(sample).select("__x").coalesce(-(-max(1, n) // TASK_ROWS)).cache()

    def one(k: int) -> tuple:
        model = KMeans(featuresCol="__x", predictionCol="__cluster", k=k, seed=seed).fit(data)
        done = model.transform(data)
        found = done.select("__cluster").distinct().count()
        score = ClusteringEvaluator(featuresCol="__x", predictionCol="__cluster").evaluate(done) if found > 1 else -1.0
        return k, float(score), float(model.summary.trainingCost), model

    data.count()  # the cache is filled once, before the fits share it
    done = at_once(one, _sizes(n, k_min, k_max))
    data.unpersist()
    shell.sweep = [d[:3] for d in done]
    shell.model = max(done, key=lambda d: (d[1], -d[0]))[3]
    return shell


def ordered_labels(df: DataFrame, by: str, names: list[str], how: str = "median") -> DataFrame:
    """df with cluster_label: clusters ranked by the median (or mean) of a column; the last name serves all further ones."""
    if how == "median":
        ranks = key_quantiles(df, ["cluster_id"], by, [0.5]).select("cluster_id", F.col("q")[0].alias("__m"))
    else:
        ranks = df.groupBy("cluster_id").agg(F.avg(by).alias("__m"))
    ranks = ranks.withColumn("__r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__m", "cluster_id")))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.least(F.col("__r"), F.lit(len(names))))
    return df.join(F.broadcast(ranks.select("cluster_id", label.alias("cluster_label"))), "cluster_id")


def inertia(df: DataFrame, columns: list[str], cluster: str = "cluster_id") -> DataFrame:
    """Per cluster: rows and the summed squared distance of its rows to their mean, in one aggregation."""
    n = F.count(F.lit(1))
    return df.groupBy(cluster).agg(n.alias("n_rows"), sum((F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) * n for c in columns), F.lit(0.0)).alias("inertia"))


def labelings_attached(df: DataFrame, on: list[str], labelings: dict[str, DataFrame], label: str = "cluster_label") -> DataFrame:
    """df with the label of each labeling (of columns ``on`` and label) under the labeling's name; null where it has none."""
    out = df
    for name, rows in labelings.items():
        out = out.join(rows.select(*on, F.col(label).alias(name)), on, "left")
    return out


def sample_assigned(sample: DataFrame, assignments: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a sample with the columns of their assignments."""
    return sample.join(assignments, keys)


def cross_summary(df: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Rows and mean of a value for each pair of two labelings."""
    return df.groupBy(first, second).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("mean"))
