"""Queries on a finished panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def series(panel: DataFrame, entity: str, key: object, week: str, start: str | None = None, end: str | None = None, year: str | None = None, check: bool = False) -> DataFrame:
    """Rows of one entity from start to end (YYYYWW, inclusive) in order; year prunes partitions.

    check: an empty result is an error, at the cost of a look ahead.
    """
    out = panel.where(F.col(entity) == F.lit(key))
    for bound, low in ((start, True), (end, False)):
        if bound:
            out = out.where(F.col(week) >= bound) if low else out.where(F.col(week) <= bound)
            if year:
                out = out.where(F.col(year) >= int(bound[:4])) if low else out.where(F.col(year) <= int(bound[:4]))
    if check and not out.take(1):
        raise LookupError(f"no rows for {key!r}")
    return out.orderBy(week)


def top_weeks(panel: DataFrame, week: str, value: str, n: int, year: int | None = None, year_col: str = "year") -> DataFrame:
    """The n weeks (1 to 100) with the largest totals, of one year if given; ties by week."""
    if not 1 <= n <= 100:
        raise ValueError("n must be from 1 to 100")
    rows = panel if year is None else panel.where(F.col(year_col) == year)
    return rows.groupBy(week).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), week).limit(n)


def top_features(ranking: DataFrame, score: str, n: int) -> DataFrame:
    return ranking.orderBy(F.desc(score), "feature").limit(n)


def catalog_entry(catalog: DataFrame, feature: str) -> DataFrame:
    return catalog.where(F.col("feature") == feature)
