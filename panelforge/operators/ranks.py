"""Running counts and exact quantiles of large columns, without a task or a buffer that holds a whole column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage


#: Rows of a small table that is broadcast; beyond it the join is left to Spark.
MAX_BROADCAST_ROWS = 200_000


def attached(left: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of small, a row a key; null keys meet null keys.

    small is made once and counted; it is broadcast up to MAX_BROADCAST_ROWS rows.
    """
    other = cut_lineage(small.withColumnsRenamed({k: f"__r_{k}" for k in keys}))
    same = reduce(Column.__and__, [left[k].eqNullSafe(other[f"__r_{k}"]) for k in keys])
    few = other.count() <= MAX_BROADCAST_ROWS
    return left.join(F.broadcast(other) if few else other, same, how).drop(*[f"__r_{k}" for k in keys])


def running_counts(counts: DataFrame, keys: list[str], value: str, n: str = "n", total: str | None = None) -> DataFrame:
    """counts (one row a key and value, n rows each) with ``before``: the rows of the key with smaller values.

    total: a name for the number of all rows of the key, if wanted. Spark deals the values out by range; sums over the
    ranges come from a small table (a row for each key and range that it has values in), those inside a range from a
    window.
    """
    dealt = cut_lineage(counts.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id()))
    of_key = Window.partitionBy(*keys)
    ahead = of_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*keys, "__part").agg(F.sum(n).alias("__n")).withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    if total:
        parts = parts.withColumn(total, F.sum("__n").over(of_key))
    inside = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = attached(dealt, parts.drop("__n"), [*keys, "__part"])
    return out.withColumn("before", F.col("__ahead") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("__part", "__ahead")


def key_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys and ``q``: the linear quantiles of each key's known values, exact at any number of rows.

    Meant for few keys with many values; many keys with few values each want F.percentile.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    rows = running_counts(counts, keys, value, total="__total")

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("before") + F.col("n") > rank, F.col(value).cast("double")))

    place = [(F.col("__total") - 1) * F.lit(float(s)) for s in shares]
    ends = [x for i, h in enumerate(place) for x in (at(F.floor(h)).alias(f"__a{i}"), at(F.ceil(h)).alias(f"__b{i}"), F.max(h - F.floor(h)).alias(f"__f{i}"))]
    found = rows.groupBy(*keys).agg(*ends)
    return found.select(*keys, F.array(*[F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * F.col(f"__f{i}") for i in range(len(shares))]).alias("q"))


def with_medians(stats: DataFrame, df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """stats (a row a key) with ``median`` of a value of df; null where the key has no known value."""
    found = key_quantiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias("median"))
    return attached(stats, found, keys, "left")
