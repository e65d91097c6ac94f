"""A labelled panel kept by year, of which one year can be made anew.

The panel has every reference entity in every week of a calendar, so a changed year adds no rows elsewhere. Thresholds of the
quantile alerts are taken once, by the full build, and kept beside the panel: else every row of an entity would hang on
every year of it. What is left reaches back at most ``REACH`` weeks, so a year's records touch the year and the first weeks
after it. A refresh reads the year with that many weeks on either side, and writes the partitions that these weeks lie in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weeks import season
from ..operators import labels, windows
from ..sources.publish import write_panel
from ..sources.shared import cut_lineage

#: Rows that a feature looks back: the longest lag, and the longest mean of rows before.
REACH = max(*windows.LAGS, *windows.SPANS)
ALERTS, GROWTH = {"alert_q75": 0.75, "alert_q90": 0.9}, 0.75


class YearlyPanel:
    """A panel below a path: ``panel`` by year, ``limits`` by entity, ``entities`` and ``weeks``.

    Observed rows have the entity's columns, a week YYYYWW, a value and a share of severe ones, one row an entity and week.
    """

    def __init__(self, spark: SparkSession, path: str, entity: list[str], week: str, value: str, severe: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.entity, self.week, self.value, self.severe = entity, week, value, severe

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/panel")

    def build(self, observed: DataFrame, entities: DataFrame, weeks: DataFrame, limits: DataFrame | None = None) -> None:
        """Write everything. entities, weeks: what the panel covers; limits: thresholds to keep to (default: of these rows; see ``limits``)."""
        entities.select(*self.entity).distinct().write.mode("overwrite").parquet(f"{self.path}/entities")
        weeks.select(self.week).distinct().write.mode("overwrite").parquet(f"{self.path}/weeks")
        made = self._features(self._grid(observed, None))
        if limits is None:
            change = f"{self.value}_pct_1"
            shares = F.percentile(self.value, [share for share in ALERTS.values()]).alias("__q"), F.percentile(change, GROWTH).alias("growth")
            found = made.groupBy(*self.entity).agg(*shares)  # of many entities with few weeks each
            limits = found.select(*self.entity, *[F.col("__q")[i].alias(name) for i, name in enumerate(ALERTS)], "growth")
        cut_lineage(limits).write.mode("overwrite").parquet(f"{self.path}/limits")
        write_panel(self._labelled(made), f"{self.path}/panel", "year")

    def limits(self) -> DataFrame:
        """The kept thresholds by entity: of each alert, and of the growth."""
        return self.spark.read.parquet(f"{self.path}/limits")

    def refresh(self, observed: DataFrame, year: int) -> list[int]:
        """Make a year anew from observed rows (of any weeks; those around the year are read). Returns the years written."""
        weeks = sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/weeks").collect())  # a row a week
        own = [i for i, w in enumerate(weeks) if int(w[:4]) == year]
        if not own:
            raise ValueError(f"the panel has no week of {year}")
        first, last = own[0], min(own[-1] + REACH, len(weeks) - 1)
        around = weeks[max(0, first - REACH) : last + 1]
        made = self._labelled(self._features(self._grid(observed, around))).where(F.col(self.week).between(weeks[first], weeks[last]))
        years = sorted({int(w[:4]) for w in weeks[first : last + 1]})
        # Of the years that the weeks after reach into, the rest of the rows stays as it is.
        rest = self.read().where(F.col("year").isin(years[1:]) & (F.col(self.week) > weeks[last]))
        write_panel(cut_lineage(made.select(*rest.columns).unionByName(rest)), f"{self.path}/panel", "year")
        return years

    def _grid(self, observed: DataFrame, weeks: list[str] | None) -> DataFrame:
        """Every entity in every week, or in some in a row, with 0 where nothing was observed."""
        calendar = self.spark.read.parquet(f"{self.path}/weeks")
        if weeks is not None:
            calendar = calendar.where(F.col(self.week).between(weeks[0], weeks[-1]))
            observed = observed.where(F.col(self.week).between(weeks[0], weeks[-1]))
        entities = self.spark.read.parquet(f"{self.path}/entities")
        rows = observed.select(*self.entity, self.week, F.col(self.value).cast("double").alias(self.value), F.col(self.severe).cast("double").alias(self.severe))
        grid = entities.crossJoin(F.broadcast(calendar)).join(rows, [*self.entity, self.week], "left")
        return grid.fillna(0.0, [self.value, self.severe])

    def _features(self, grid: DataFrame) -> DataFrame:
        sine, cosine = season(F.substring(self.week, 5, 2).cast("int"))
        out = grid.withColumns({"season_sin": sine, "season_cos": cosine, "is_zero": windows.is_zero(F.col(self.value)), "year": F.substring(self.week, 1, 4).cast("int")})
        out = windows.lags(out, self.value, self.entity, [self.week])
        out = windows.trailing(out, self.value, self.entity, [self.week])
        out = windows.changes(out, self.value, self.entity, [self.week])
        return windows.ratios(out, self.value)

    def _labelled(self, made: DataFrame) -> DataFrame:
        value, change = F.col(self.value), F.col(f"{self.value}_pct_1")
        kept = self.limits().withColumnsRenamed({name: f"__{name}" for name in (*ALERTS, "growth")})
        out = made.join(kept, self.entity, "left")
        reached = {name: ((value >= F.col(f"__{name}")) & (value > 0)).cast("int") for name in ALERTS}
        out = out.withColumns(reached | {"fast_growth": ((change >= F.col("__growth")) & (value > 0)).cast("int")}).drop(*[f"__{name}" for name in (*ALERTS, "growth")])
        out = out.withColumn("outbreak", labels.outbreak(value, F.col(f"{self.value}_mean_8"), F.col(f"{self.value}_std_8")))
        return out.withColumn("critical", labels.critical(value, [F.col("alert_q90"), F.col("outbreak")], F.col(self.severe)))
