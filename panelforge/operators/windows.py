"""Window features of a panel, ordered by period within an entity.

fill="zero" replaces what is undefined by 0 (dense panels); fill="null" keeps it unknown (single series). All features of
one call share one partitioning and sort.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAGS = (1, 2, 3, 4, 8, 12)
SPANS = (3, 4, 8, 12)


def ordered(entity: list[str], period: list[str]):
    return Window.partitionBy(*(entity or [F.lit(0)])).orderBy(*period)


def _filled(c: Column, fill: str) -> Column:
    if fill not in ("zero", "null"):
        raise ValueError("fill must be zero or null")
    return F.coalesce(c, F.lit(0.0)) if fill == "zero" else c


def lags(df: DataFrame, value: str, entity: list[str], period: list[str], steps: Iterable[int] = LAGS, fill: str = "zero", prefix: str | None = None) -> DataFrame:
    w = ordered(entity, period)
    return df.withColumns({f"{prefix or value}_lag_{k}": _filled(F.lag(value, k).over(w), fill) for k in steps})


def leads(df: DataFrame, value: str, entity: list[str], period: list[str], horizon: int, name: str = "target") -> DataFrame:
    """The value ``horizon`` rows ahead; rows without one are dropped."""
    return df.withColumn(name, F.lead(value, horizon).over(ordered(entity, period))).where(F.col(name).isNotNull())


def trailing(df: DataFrame, value: str, entity: list[str], period: list[str], spans: Iterable[int] = SPANS, std_spans: Iterable[int] = (8,), fill: str = "zero") -> DataFrame:
    """Mean, min and max over the rows before, and their sample standard deviation from two rows on.

    With fill="zero" the row before the first is a 0 that counts.
    """
    w = ordered(entity, period)
    out = df.withColumn("__before", _filled(F.lag(value, 1).over(w), fill))
    over = lambda n: w.rowsBetween(-(n - 1), 0)
    cols = {}
    for n in spans:
        cols |= {f"{value}_mean_{n}": F.avg("__before").over(over(n)), f"{value}_min_{n}": F.min("__before").over(over(n)), f"{value}_max_{n}": F.max("__before").over(over(n))}
    cols |= {f"{value}_std_{n}": _filled(F.stddev_samp("__before").over(over(n)), fill) for n in std_spans}
    return out.withColumns(cols).drop("__before")


def changes(df: DataFrame, value: str, entity: list[str], period: list[str], steps: Iterable[int] = (1, 4), fill: str = "zero") -> DataFrame:
    """Difference and relative change (x/0 undefined) over steps, and the difference of the first step's difference."""
    w, steps = ordered(entity, period), list(steps)
    cols = {}
    for k in steps:
        before = F.lag(value, k).over(w)
        cols[f"{value}_diff_{k}"] = _filled(F.col(value) - before, fill)
        cols[f"{value}_pct_{k}"] = _filled(F.try_divide(F.col(value) - before, before), fill)
    first = f"{value}_diff_{steps[0]}"
    out = df.withColumns(cols)
    return out.withColumn(f"{value}_accel", _filled(F.col(first) - F.lag(first, 1).over(w), fill))


def ratios(df: DataFrame, value: str, spans: Iterable[int] = (4, 8), fill: str = "zero") -> DataFrame:
    """Value over its trailing means."""
    return df.withColumns({f"{value}_ratio_{n}": _filled(F.try_divide(F.col(value), F.col(f"{value}_mean_{n}")), fill) for n in spans})


def rolling_with_current(df: DataFrame, values: list[str], entity: list[str], period: list[str], span: int = 4, least: int = 2) -> DataFrame:
    """Mean over the current and the rows before, null with fewer than ``least`` known values."""
    w = ordered(entity, period).rowsBetween(-(span - 1), 0)
    return df.withColumns({f"{v}_roll_{span}": F.when(F.count(v).over(w) >= least, F.avg(v).over(w)) for v in values})


def lags_apart(df: DataFrame, value: str, entity: list[str], number: str, steps: Iterable[int] = LAGS, prefix: str | None = None) -> DataFrame:
    """The value of the period ``k`` numbers before, null where there is none: gaps don't shift it.

    number: a running number of the period, one row each.
    """
    w = ordered(entity, [number])
    return df.withColumns({f"{prefix or value}_lag_{k}": F.first(value).over(w.rangeBetween(-k, -k)) for k in steps})


def rolling_apart(df: DataFrame, values: list[str], entity: list[str], number: str, span: int = 4, least: int = 2) -> DataFrame:
    """Mean over the current and the ``span - 1`` numbers before, null with fewer than ``least`` known values there."""
    w = ordered(entity, [number]).rangeBetween(-(span - 1), 0)
    return df.withColumns({f"{v}_roll_{span}": F.when(F.count(v).over(w) >= least, F.avg(v).over(w)) for v in values})


def is_zero(c: Column) -> Column:
    return (c == 0).cast("int")
