"""From case records to the dense entity by week panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage


def case_panel(cases: DataFrame, keys: list[str], features: list[str], flags: list[str], first: list[str] = (), count: str = "cases") -> DataFrame:
    """One row a key: count, mean of each feature over its known values, rounded sum of each flag, first provenance.

    first: columns of which the smallest combination is kept as a whole.
    """
    aggs = [F.count(F.lit(1)).alias(count)]
    aggs += [F.avg(c).alias(c) for c in features]
    aggs += [F.coalesce(F.round(F.sum(c)), F.lit(0)).cast("long").alias(f"n_{c}") for c in flags]
    if first:
        aggs.append(F.min(F.struct(*first)).alias("__first"))
    out = cases.groupBy(*keys).agg(*aggs)
    return out.select(*[c for c in out.columns if c != "__first"], *[F.col(f"__first.{c}").alias(c) for c in first]) if first else out


def densify(panel: DataFrame, entity: list[str], period: list[str], zero: list[str], labels: dict[str, str] | None = None, copy: dict[str, str] | None = None, max_periods: int = 200_000) -> DataFrame:
    """Every entity in every period seen anywhere; missing rows get 0 in the zero columns.

    labels: text for unobserved rows by column; copy: column to fill from another. The calendar is broadcast: a row a
    period, checked against max_periods, beyond which the join is left to Spark.
    """
    calendar = cut_lineage(panel.select(*period).distinct())  # counted here, and not made again in the join
    if calendar.count() <= max_periods:
        calendar = F.broadcast(calendar)
    grid = panel.select(*entity).distinct().crossJoin(calendar)
    out = grid.join(panel, [*entity, *period], "left")
    fill = {c: F.coalesce(c, F.lit(0.0)) for c in zero}
    fill |= {c: F.coalesce(c, F.lit(v)) for c, v in (labels or {}).items()}
    fill |= {c: F.coalesce(F.col(c), F.col(v)) for c, v in (copy or {}).items()}
    return out.withColumns(fill) if fill else out


def merge_weighted(rows: DataFrame, key: str, weight: str, features: list[str], normalized: Column | None = None) -> DataFrame:
    """Merge pre-aggregated rows of a key: weights add up, a feature is its weighted mean over the rows that know it."""
    rows = rows if normalized is None else rows.withColumn(key, normalized)
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(weight))
    means = [F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(known(c))).alias(c) for c in features]
    # The check on an aggregate stays above the grouping, where the normaliser has been evaluated once.
    out = rows.groupBy(key).agg(F.sum(weight).alias(weight), *means, F.max(key).alias("__key"))
    return out.where(F.col("__key").isNotNull()).drop("__key")


def merge_losses(rows: DataFrame, normalized: Column, weight: str) -> DataFrame:
    """Rows and volume that a key's normaliser drops."""
    lost = rows.select(normalized.isNull().alias("lost"), weight)
    return lost.agg(F.count_if("lost").alias("dropped_rows"), F.coalesce(F.sum(F.when(F.col("lost"), F.col(weight))), F.lit(0)).cast("long").alias("dropped_volume"))


def classified(records: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """records with discard_reason: the first that holds, else null."""
    reason = F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in reasons])
    return records.withColumn("discard_reason", reason)


def discard_counts(rows: DataFrame, by: str = "source_year") -> DataFrame:
    return rows.where(F.col("discard_reason").isNotNull()).groupBy(by, "discard_reason").agg(F.count(F.lit(1)).alias("records"))


def discard_examples(rows: DataFrame, order: list[str], by: str = "source_year", most: int = 200) -> DataFrame:
    """Up to ``most`` discarded rows a year, the first in order."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.where(F.col("discard_reason").isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def mark_duplicates(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """rows with is_duplicate: all but the first of those that agree in the columns.

    The first of each group comes from an aggregation, so no task holds all copies of a record. Order columns that are
    among the columns are the same for a whole group and don't count; without others a plain number is aggregated.
    """
    kept = cut_lineage(rows.withColumn("__place", F.monotonically_increasing_id()))
    left = [c for c in order if c not in columns]
    first = (F.min(F.struct(*left, "__place"))["__place"] if left else F.min("__place")).alias("__first")
    several = kept.groupBy(*[F.col(c).alias(f"__r_{c}") for c in columns]).agg(first, F.count(F.lit(1)).alias("__n")).where("__n > 1")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in columns])
    out = kept.join(several, same, "left")
    return out.select(*rows.columns, F.coalesce(F.col("__place") != F.col("__first"), F.lit(False)).alias("is_duplicate"))


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def station_weeks(hourly: DataFrame, keys: list[str], day: str, rain: str, temp: str, temp_min: str, temp_max: str, means: dict[str, str], least_hours: int = 84, heavy: float = 10) -> DataFrame:
    """Per station and week: rain sum and mean, temperatures, other means, hours known, and days of rain.

    Days are summed first (partial aggregation of both levels), then weeks: one shuffle a level, no join.
    """
    parts = [F.sum(rain).alias("r"), F.count(rain).alias("rn"), F.sum(temp).alias("t"), F.count(temp).alias("tn"), F.min(temp_min).alias("lo"), F.max(temp_max).alias("hi")]
    for name, c in means.items():
        parts += [F.sum(c).alias(f"s_{name}"), F.count(c).alias(f"n_{name}")]
    daily = hourly.groupBy(*keys, day).agg(*parts)
    total = F.coalesce(F.sum("r"), F.lit(0.0))
    hours = F.sum("tn")
    return daily.groupBy(*keys).agg(
        total.alias("rain_sum"),
        F.try_divide(F.sum("r"), F.sum("rn")).alias("rain_mean"),
        F.try_divide(F.sum("t"), hours).alias("temp_mean"),
        F.min("lo").alias("temp_min"),
        F.max("hi").alias("temp_max"),
        *[F.try_divide(F.sum(f"s_{n}"), F.sum(f"n_{n}")).alias(f"{n}_mean") for n in means],
        hours.alias("n_valid_hours"),
        F.count_if(F.col("r") > 0).alias("rain_days"),
        F.count_if(F.col("r") >= heavy).alias("rain_heavy_days"),
        (F.max("hi") - F.min("lo")).alias("temp_range"),
        (hours < least_hours).alias("low_coverage"),
    )


def left_once(panel: DataFrame, other: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """panel with the columns of other's first row of the same key."""
    return panel.join(keep_one(other, keys, order), keys, "left")
