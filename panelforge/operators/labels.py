"""Alerts and risk classes from an entity's own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile_alerts(df: DataFrame, value: str, entity: list[str], shares: dict[str, float], positive: bool = True) -> DataFrame:
    """1 where the value reaches the entity's own linear quantile (and is above 0, if positive)."""
    w = Window.partitionBy(*entity)
    above = F.col(value) > 0 if positive else F.lit(True)
    return df.withColumns({name: ((F.col(value) >= F.percentile(value, p).over(w)) & above).cast("int") for name, p in shares.items()})


def growth_alert(df: DataFrame, change: str, value: str, entity: list[str], share: float = 0.75, name: str = "fast_growth") -> DataFrame:
    """1 where the relative change reaches its entity's quantile and the value is above 0."""
    limit = F.percentile(change, share).over(Window.partitionBy(*entity))
    return df.withColumn(name, ((F.col(change) >= limit) & (F.col(value) > 0)).cast("int"))


def outbreak(value: Column, mean: Column, std: Column, width: float = 2.0) -> Column:
    """1 where a value above 0 reaches its trailing mean and ``width`` standard deviations.

    Both sides are rounded to nine digits, so that a constant series does not hinge on the last bit.
    """
    return ((F.round(value, 9) >= F.round(mean + width * std, 9)) & (value > 0)).cast("int")


def critical(value: Column, alerts: list[Column], share: Column, least: float = 0.05) -> Column:
    """1 where a value above 0 has an alert or a severe share of ``least`` or more."""
    hit = F.coalesce(share, F.lit(0.0)) >= least
    for a in alerts:
        hit = hit | (a == 1)
    return (hit & (value > 0)).cast("int")


def thresholds(df: DataFrame, value: str, entity: list[str], shares: list[float]) -> DataFrame:
    """Linear quantiles of each entity: columns p50, p75 and so on."""
    names = [f"p{round(100 * s)}" for s in shares]
    out = df.groupBy(*entity).agg(F.percentile(value, shares).alias("__p"))
    return out.select(*entity, *[F.col("__p")[i].alias(n) for i, n in enumerate(names)])


def risk_class(df: DataFrame, target: str, value: str, entity: list[str], train: Column | None = None, name: str = "risk") -> DataFrame:
    """0 to 3 by the target against the entity's median, p75 and p90 of value.

    train: rows that the thresholds are taken from (default: all). An entity without any is class 0.
    """
    limits = thresholds(df if train is None else df.where(train), value, entity, [0.5, 0.75, 0.9])
    t = F.col(target)
    ladder = F.when(t > F.col("p90"), 3).when(t > F.col("p75"), 2).when(t > F.col("p50"), 1).otherwise(0)
    return df.join(limits, entity, "left").withColumn(name, ladder).drop("p50", "p75", "p90")
