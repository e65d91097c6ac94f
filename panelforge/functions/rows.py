"""Expressions over several columns of a row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_of(columns: Iterable[Column]) -> Column:
    """Mean of the known values of a row; null if none is known."""
    known = F.filter(F.array(*[c.cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def mean_of_present(df: DataFrame, names: Iterable[str]) -> Column:
    """mean_of over those named columns that df has; null if it has none."""
    have = [F.col(n) for n in names if n in df.columns]
    return mean_of(have) if have else F.lit(None).cast("double")


def composite_indices(df: DataFrame, groups: dict[str, list[str]], total: str | None = None) -> DataFrame:
    """One index a group (mean of its columns), and a total (mean of the indices)."""
    out = df.withColumns({name: mean_of_present(df, cols) for name, cols in groups.items()})
    return out.withColumn(total, mean_of(F.col(n) for n in groups)) if total else out


def difference(a: Column, b: Column) -> Column:
    """a - b; unknown if either is."""
    return a - b


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km; degrees in."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 12742.0 * F.asin(F.least(F.sqrt(a), F.lit(1.0)))
