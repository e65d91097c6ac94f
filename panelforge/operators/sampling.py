"""Reproducible samples: the order is a hash of key and seed.

The rows with the smallest hashes are found by histograms of hash prefixes, so that only rows around the cut are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage

#: Hex digits by which a histogram is finer than the one before, and rows around a stratum's cut that are sorted.
DIGITS, CUT_ROWS = 3, 10_000
#: Rows of a sample that tasks keep the first of in one pass.
FEW_ROWS = 100
HASH_DIGITS = 32


def hash_order(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed))).cast("binary"))


def smallest(df: DataFrame, strata: list[Column], keys: list[str], most: int, seed: int, cut_rows: int = CUT_ROWS) -> DataFrame:
    """The ``most`` rows of each stratum that come first by hash, then keys.

    A histogram of hash prefixes has at most 4,096 bars a stratum; the bar that holds the last row wanted is cut into
    finer ones until it has few rows. Rows of bars before it are taken without sorting.
    """
    if most < 1:
        return df.limit(0)
    names = [f"__s{i}" for i in range(len(strata))]
    rows = df.withColumns(dict(zip(names, strata, strict=True)) | {"__h": hash_order(keys, seed)})
    same = lambda left, right: reduce(Column.__and__, [left[c].eqNullSafe(right[f"r{c}"]) for c in names], F.lit(True))
    renamed = lambda t: t.withColumnsRenamed({c: f"r{c}" for c in names})

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """left with the cuts of its stratum; the one cut of all rows is a literal, by which Spark can filter before it aggregates or joins."""
        if names:
            return left.join(right, same(left, right))
        row = right.first()
        return (left if row else left.where("false")).withColumns({c: F.lit(row[c] if row else None).cast(right.schema[c].dataType) for c in right.columns})

    # cut: the prefix of the bar with the last row wanted; ahead: rows before it; bar: rows in it.
    cuts, depth = None, 0
    while depth < HASH_DIGITS:
        depth = min(depth + DIGITS, HASH_DIGITS)
        bars = rows.select(*names, F.substring("__h", 1, depth).alias("__bar"), "__h")
        if cuts is not None:
            open_ = renamed(cuts.where(F.col("__n") > cut_rows))
            bars = met(bars, open_).where(F.col("__h").startswith(F.col("__cut"))).select(*names, "__bar", F.col("__ahead").alias("__base"))
        else:
            bars = bars.select(*names, "__bar", F.lit(0).cast("long").alias("__base"))
        bars = bars.groupBy(*names, "__bar").agg(F.count(F.lit(1)).alias("__n"), F.first("__base").alias("__base"))
        ahead = Window.partitionBy(*names).orderBy("__bar").rowsBetween(Window.unboundedPreceding, -1)
        bars = bars.withColumn("__ahead", F.col("__base") + F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
        found = bars.where(F.col("__ahead") < most).groupBy(*names).agg(F.max_by(F.struct("__bar", "__ahead", "__n"), F.col("__bar")).alias("c"))
        found = found.select(*names, F.col("c.__bar").alias("__cut"), F.col("c.__ahead").alias("__ahead"), F.col("c.__n").alias("__n"))
        cuts = cut_lineage(found if cuts is None else cuts.where(F.col("__n") <= cut_rows).unionByName(found))
        if not cuts.where(F.col("__n") > cut_rows).limit(1).count():
            break
    cuts = renamed(cuts.withColumnsRenamed({"__n": "__bar_rows"}))
    at = F.substr(F.col("__h"), F.lit(1), F.length("__cut"))
    near = cut_lineage(met(rows, cuts).where(at <= F.col("__cut")).withColumn("__before", at < F.col("__cut")))
    # Only bars that hold more rows than are wanted have to be sorted.
    whole = F.col("__before") | (F.col("__ahead") + F.col("__bar_rows") <= most)
    place = F.row_number().over(Window.partitionBy(*names).orderBy("__h", *keys))
    sorted_ = near.where(~whole).withColumn("__place", place).where(F.col("__place") <= most - F.col("__ahead"))
    return near.where(whole).select(*df.columns).unionByName(sorted_.select(*df.columns))


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows, spread evenly over the keys, in hash order."""
    order = [hash_order(keys, seed), *keys]
    return df.orderBy(*order).limit(max(0, n)) if n <= FEW_ROWS else smallest(df, [], keys, n, seed).orderBy(*order)


def stratified_cap(df: DataFrame, strata: list[Column | str], keys: list[str], most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each stratum."""
    return smallest(df, [F.col(s) if isinstance(s, str) else s for s in strata], keys, most, seed)


def active_sample(df: DataFrame, value: str, entity: str, keys: list[str], buckets: int, most: int, seed: int = 42) -> DataFrame:
    """Rows with a value above 0, at most ``most`` of each hash bucket of entities."""
    bucket = F.conv(F.substring(F.md5(F.col(entity).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % buckets
    return stratified_cap(df.where(F.col(value) > 0), [bucket], keys, most, seed)
