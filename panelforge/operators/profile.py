"""Profiles, summaries, coverage and schema documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import key_quantiles, with_medians

#: Groups of columns by prefix of their names.
FEATURE_GROUPS = (("prop_raca_", "proporcao_demografica"), ("prop_sexo_", "proporcao_demografica"), ("prop_gestante", "proporcao_demografica"), ("prop_", "proporcao_clinica"), ("qt_", "volume"), ("notificacoes_", "temporal"), ("week_of_year_", "temporal"), ("is_zero_", "temporal"), ("indice_", "indice_composto"), ("label_", "label_auxiliar"))
#: What a group holds, for the catalog.
GROUP_NOTES = {
    "identificacao": "keys and names of the row's entity and period",
    "volume": "counts of records",
    "temporal": "lags, rolling statistics, changes and seasons of the count",
    "proporcao_demografica": "shares of records by demographic attribute",
    "proporcao_clinica": "shares of records with a clinical sign",
    "indice_composto": "means of several shares",
    "label_auxiliar": "labels derived from the count",
}


def numeric_columns(df: DataFrame, without: tuple = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


def melted(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """One row a column and row: keys, feature, value (double)."""
    cast = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(list(keys), columns, "feature", "value")


def yearly_summary(df: DataFrame, year: str, value: str, entity: str) -> DataFrame:
    """Per year: total, mean, median and largest value, and the entities with a value above 0."""
    stats = df.groupBy(year).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.countDistinct(F.when(F.col(value) > 0, F.col(entity))).alias("active_entities"))
    return with_medians(stats, df, [year], value)


def period_totals(df: DataFrame, period: list[str], value: str) -> DataFrame:
    return df.groupBy(*period).agg(F.sum(value).alias("total"))


def peaks(df: DataFrame, period: list[str], value: str, n: int) -> DataFrame:
    """The n periods with the largest totals; ties by period."""
    return period_totals(df, period, value).orderBy(F.desc("total"), *period).limit(n)


def describe(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Per column: count, mean, std (n - 1), min, quartiles (linear), max, and the share of missing values.

    Quartiles are exact by ranges of values, or with approximate=True values of the column near them, in one pass.
    """
    shares = [0.25, 0.5, 0.75]
    near = [F.percentile_approx("value", shares, 10_000).alias("q")] if approximate else []
    stats = melted(df, columns).groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        *near, F.max("value").alias("max"), (F.lit(100.0) * F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("missing_pct"),
    )
    if not approximate:
        stats = stats.join(F.broadcast(key_quantiles(melted(df, columns), ["feature"], "value", shares)), "feature", "left")
    return stats.select("feature", "n", "mean", "std", "min", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "max", "missing_pct")


def correlations(df: DataFrame, target: str, columns: list[str], by_size: int | None = None) -> DataFrame:
    """Pearson correlation of each column with the target over rows that know both; undefined ones are left out.

    by_size: keep the so many largest by absolute value.
    """

    def pearson(c: str) -> Column:
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        a, b = (F.stddev_pop(F.when(both, F.col(x))) for x in (c, target))
        return F.when((a > 0) & (b > 0), F.covar_pop(c, target) / (a * b))

    as_double = {c: F.col(c).cast("double") for c in dict.fromkeys([target, *columns])}
    one = df.select(*[v.alias(c) for c, v in as_double.items()]).agg(*[pearson(c).alias(f"c{i}") for i, c in enumerate(columns)])
    names = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (f"c{i}", c)])
    out = one.unpivot([], one.columns, "place", "pearson").where("pearson is not null").select(names[F.col("place")].alias("feature"), "pearson")
    return out if by_size is None else out.orderBy(F.desc(F.abs("pearson")), "feature").limit(by_size)


def missingness(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, missing count and percentage, distinct known values.

    Exact distinct counts shuffle each column's distinct values; approximate ones are sketches of one pass over df.
    """
    if approximate:
        parts = [(F.count_if(F.col(c).isNull()).alias(f"m{i}"), F.approx_count_distinct(c).alias(f"u{i}")) for i, c in enumerate(df.columns)]
        one = df.agg(F.count(F.lit(1)).alias("n"), *[x for pair in parts for x in pair])
        each = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"), F.round(F.lit(100.0) * F.col(f"m{i}") / F.col("n"), 4).alias("missing_pct"), F.col(f"u{i}").alias("unique_values"), F.lit(t).alias("dtype")) for i, (c, t) in enumerate(df.dtypes)]
        return one.select(F.inline(F.array(*each)))
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
    distinct = F.countDistinct("value")
    out = rows.groupBy("column").agg(F.count_if(F.col("value").isNull()).alias("missing_count"), F.round(F.lit(100.0) * F.count_if(F.col("value").isNull()) / F.count(F.lit(1)), 4).alias("missing_pct"), distinct.alias("unique_values"))
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return out.withColumn("dtype", types[F.col("column")])


def quality_summary(df: DataFrame, entity: str, year: str, week: str, value: str, region: str, keys: list[str]) -> DataFrame:
    """One row: rows, entities, years, total, first and last week, regions as text, missing keys, repeated keys."""
    nulls = [F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys]
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(entity).alias("entities"), F.countDistinct(year).alias("years"), F.sum(value).alias("total"),
        F.min(week).alias("first_week"), F.max(week).alias("last_week"), F.array_join(F.array_sort(F.collect_set(region)), ",").alias("regions"), *nulls,
    )
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("repeated_keys"))
    return one.crossJoin(repeated)


def temporal_coverage(df: DataFrame, year: str, entity: str, week: str, value: str) -> DataFrame:
    return df.groupBy(year).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(entity).alias("entities"), F.sum(value).alias("total"), F.min(week).alias("first_week"), F.max(week).alias("last_week"))


def entity_coverage(reference: DataFrame, df: DataFrame, entity: str, week: str, value: str) -> DataFrame:
    """Every member of the reference with its rows, first and last week, total, and whether it was seen at all."""
    seen = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"), F.min(week).alias("first_week"), F.max(week).alias("last_week"), F.sum(value).alias("total"))
    out = reference.join(seen, entity, "left")
    return out.withColumn("observed", F.col("n_rows").isNotNull().cast("int")).fillna({"n_rows": 0, "total": 0})


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Of entity_coverage in all: members of the reference, those observed and not, and the share observed in percent (0 of none)."""
    n, seen = F.count(F.lit(1)), F.coalesce(F.sum("observed"), F.lit(0))
    share = F.coalesce(F.round(F.try_divide(100.0 * seen, n), 4), F.lit(0.0))
    return coverage.agg(n.alias("entities"), seen.alias("observed"), (n - seen).alias("unobserved"), share.alias("coverage_pct"))


def join_coverage(df: DataFrame, year: str, joined: str) -> DataFrame:
    """Per year: rows, rows where a joined column is known, and their percentage."""
    n, hit = F.count(F.lit(1)), F.count(joined)
    return df.groupBy(year).agg(n.alias("n_rows"), hit.alias("n_joined"), F.round(F.lit(100.0) * hit / n, 2).alias("joined_pct"))


def frequencies(df: DataFrame, value: Column, n: int = 20) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def group_summary(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Rows, mean, median and max of a value by group; exact over all rows."""
    stats = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return with_medians(stats, df, groups, value)


def class_shares(df: DataFrame, label: str, split: str) -> DataFrame:
    """Counts of each class in each split, and its share there."""
    out = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def dataset_summary(df: DataFrame, value: str, key: str) -> DataFrame:
    """One row: total, mean, median, std, coefficient of variation, q75, q90, and the key of the largest value (ties: smallest key).

    df is a table of periods: its quantiles hold all its distinct values in one buffer.
    """
    mean, std = F.avg(value), F.stddev_samp(value)
    return df.agg(
        F.sum(value).alias("total"), mean.alias("mean"), F.median(value).alias("median"), std.alias("std"), F.try_divide(std, mean).alias("cv"),
        F.percentile(value, 0.75).alias("q75"), F.percentile(value, 0.9).alias("q90"), F.min_by(key, F.struct(-F.col(value), F.col(key))).alias("peak"),
    )


def low_coverage_by_year(weeks: DataFrame, year: str, station: str) -> DataFrame:
    n = F.count(F.lit(1))
    return weeks.groupBy(year).agg(F.countDistinct(station).alias("stations"), n.alias("station_weeks"), F.round(F.lit(100.0) * F.count_if("low_coverage") / n, 2).alias("low_coverage_pct"))


def schema_document(df: DataFrame, keys: list[str] = (), grain: str = "") -> DataFrame:
    """Per column: place, name, type, whether nulls occur, whether it is in the key, and the grain."""
    rows = [(i, c, t, c in keys, grain) for i, (c, t) in enumerate(df.dtypes)]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).unpivot([], df.columns, "name", "nulls")
    doc = df.sparkSession.createDataFrame(rows, "position int, name string, dtype string, in_key boolean, grain string")
    return doc.join(nulls, "name").select("position", "name", "dtype", (F.col("nulls") > 0).alias("nullable"), "in_key", "grain")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after a check that no key repeats."""
    bad = repeated_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"key {keys} repeats: {bad[0].asDict()}")
    return df


def feature_group(name: str, identifiers: tuple = (), groups: tuple = FEATURE_GROUPS) -> str:
    if name in identifiers:
        return "identificacao"
    if name == "notificacoes":
        return "volume"
    return next((group for prefix, group in groups if name.startswith(prefix)), "identificacao")


def feature_catalog(df: DataFrame, identifiers: tuple = (), groups: tuple = FEATURE_GROUPS, notes: dict[str, str] = GROUP_NOTES) -> DataFrame:
    """Per column: group by name (groups: prefix and group), type, the group's description, and percentage of missing values, ordered by group and name."""
    found = [(c, feature_group(c, identifiers, groups), t) for c, t in df.dtypes]
    rows = [(c, g, t, notes.get(g, "")) for c, g, t in found]
    doc = df.sparkSession.createDataFrame(rows, "feature string, `group` string, dtype string, description string")
    share = [(F.lit(100.0) * F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(c) for c in df.columns]
    return doc.join(df.agg(*share).unpivot([], df.columns, "feature", "missing_pct"), "feature").orderBy("group", "feature")


def informative_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those columns that hold more than one distinct value."""
    stats = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if stats[f"a{i}"] is not None and stats[f"a{i}"] != stats[f"b{i}"]]


def known_columns(df: DataFrame, columns: list[str], most_missing: float = 0.99, banned: str | None = None) -> list[str]:
    """Those columns that are not missing in more than a share of rows, nor in all, nor have the banned text in their name."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    n = stats["n"]
    return [c for i, c in enumerate(columns) if stats[f"k{i}"] and (n - stats[f"k{i}"]) / n <= most_missing and not (banned and banned in c)]


def covered_columns(df: DataFrame, columns: list[str], least: int = 10, share: float = 1 / 3) -> list[str]:
    """Those columns with max(least, share of the rows) known values or more."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if stats[f"k{i}"] >= max(least, int(stats["n"] * share))]


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the column's median, or 0 where all are missing."""
    medians = {r["feature"]: r["q"][0] for r in key_quantiles(melted(df, columns), ["feature"], "value", [0.5]).collect()}  # a row a column
    return df.fillna({c: float(medians.get(c) or 0.0) for c in columns})
