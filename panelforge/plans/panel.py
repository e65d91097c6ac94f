"""The panel build: records to a dense, labelled panel; and its integration with climate weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weeks import season, week_number
from ..operators import labels, panel, windows


def labelled_panel(observed: DataFrame, entity: list[str], week: str, value: str, severe: str, zero: list[str] = ()) -> DataFrame:
    """Densify an observed entity-week panel and derive all window features and labels (zero fill).

    week: YYYYWW text. The grid, the windows and the quantiles are all partitioned by entity.
    """
    dense = panel.densify(observed, entity, [week], [value, severe, *zero])
    number = F.substring(week, 5, 2).cast("int")
    sine, cosine = season(number)
    out = dense.withColumns({"season_sin": sine, "season_cos": cosine, "is_zero": windows.is_zero(F.col(value))})
    out = windows.lags(out, value, entity, [week])
    out = windows.trailing(out, value, entity, [week])
    out = windows.changes(out, value, entity, [week])
    out = windows.ratios(out, value)
    out = labels.quantile_alerts(out, value, entity, {"alert_q75": 0.75, "alert_q90": 0.9})
    out = labels.growth_alert(out, f"{value}_pct_1", value, entity)
    out = out.withColumn("outbreak", labels.outbreak(F.col(value), F.col(f"{value}_mean_8"), F.col(f"{value}_std_8")))
    return out.withColumn("critical", labels.critical(F.col(value), [F.col("alert_q90"), F.col("outbreak")], F.col(severe)))


def with_climate(dense: DataFrame, climate: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """dense with the climate columns of the same entity and week; repeated climate rows count once, the first by value."""
    return panel.left_once(dense, climate.select(*keys, *values), keys, [F.col(v).asc_nulls_last() for v in values])


def climate_features(weeks: DataFrame, entity: list[str], period: list[str], by_week: bool = False) -> DataFrame:
    """Lags of rain, temperature and humidity, of heavy days and temperature range, and rolling means with the current week.

    Lags and means go by rows, so that a missing week shifts them; with by_week they go by the weeks' own distance (the
    first of period is a week YYYYWW), and a missing week leaves what would come from it unknown.
    """
    wanted = {"rain_sum": (1, 2, 4, 8), "temp_mean": (1, 2, 4, 8), "humidity_mean": (1, 2, 4, 8), "rain_heavy_days": (2, 4), "temp_range": (2,)}
    rolled = ["rain_sum", "temp_mean", "humidity_mean"]
    if by_week:
        out = weeks.withColumn("__week", week_number(F.col(period[0])).cast("int"))
        for name, steps in wanted.items():
            out = windows.lags_apart(out, name, entity, "__week", steps)
        return windows.rolling_apart(out, rolled, entity, "__week").drop("__week")
    out = weeks
    for name, steps in wanted.items():
        out = windows.lags(out, name, entity, period, steps, fill="null")
    return windows.rolling_with_current(out, rolled, entity, period)
