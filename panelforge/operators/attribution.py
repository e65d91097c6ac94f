"""Additive attribution of a model's predictions to its columns, row by row."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage
from .sampling import hash_sample


def shapley_values(predict: Callable[[DataFrame], DataFrame], df: DataFrame, columns: list[str], keys: list[str], background: DataFrame | None = None, permutations: int = 4, references: int = 8, seed: int = 42) -> DataFrame:
    """keys, feature, value, attribution, prediction and base: a row for each row of df and column.

    predict adds ``prediction`` to rows that have the columns. A permutation of the columns turns a reference row into the
    row to explain, column by column; what a column's turn changes is its share. Each seeded permutation is also walked
    backwards (antithetic), and meets every one of the ``references`` rows drawn from background (default: df). The
    average over walks is unbiased, and its shares add up to prediction less base, the mean prediction of the references,
    whatever the number of walks: a walk's changes are a telescoping sum.

    Walks share what they score: each set of columns that some walk has taken from the row meets each reference once and
    counts for a column as often as walks come to the set by it, less as often as they leave it by it. The set of none is
    scored for the references alone, that of all columns once a row.

    keys name a row of df; columns are numbers. df times at most references * 2 * permutations * (columns - 1) + 1 rows are
    scored, dealt out by Spark; the references are a bounded sample that is broadcast. Empty tables give no rows.
    """
    rng = random.Random(seed)
    orders = []
    for _ in range(permutations):
        order = list(range(len(columns)))
        rng.shuffle(order)
        orders += [order, order[::-1]]
    # Of each set of columns: how often walks come to it by a column, less how often they leave it by one.
    counts: dict[frozenset, list[int]] = {}
    for order in orders:
        for step, c in enumerate(order):
            for taken, sign in ((order[:step], -1), (order[: step + 1], 1)):
                counts.setdefault(frozenset(taken), [0] * len(columns))[c] += sign
    none, every = counts.pop(frozenset(), [0] * len(columns)), counts.pop(frozenset(range(len(columns))), [0] * len(columns))
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    # References in hash order of their own values, so that they don't depend on the table's layout.
    drawn = cut_lineage(hash_sample((df if background is None else background).select(*numbers), columns, references, seed))
    met = drawn.count()
    n, at = range(len(columns)), [f"__sv_k{i}" for i in range(len(keys))]
    own = [f"__sv_v{i}" for i in n]
    alone = predict(drawn).agg(F.avg("prediction").alias("__sv_base"), F.sum("prediction").alias("__sv_bases"), F.count(F.lit(1)).alias("__sv_met")).where("__sv_met > 0")
    # A small table of what a row meets: of each column whether it comes from the row, the reference's value and the count.
    sets = [F.struct(*[F.lit(i in taken).alias(f"__sv_t{i}") for i in n], *[F.lit(float(w[i])).alias(f"__sv_w{i}") for i in n], F.lit(False).alias("__sv_full")) for taken, w in counts.items()]
    whole = F.struct(*[F.lit(True).alias(f"__sv_t{i}") for i in n], *[F.lit(float(every[i] * met)).alias(f"__sv_w{i}") for i in n], F.lit(True).alias("__sv_full"))
    mixes = drawn.sparkSession.range(1).select(F.inline(F.array(whole)), *[F.lit(None).cast("double").alias(f"__sv_b{i}") for i in n])
    if sets:
        mixes = mixes.unionByName(drawn.select(*[F.col(c).alias(f"__sv_b{i}") for i, c in enumerate(columns)], F.inline(F.array(*sets))))
    mixes = mixes.crossJoin(F.broadcast(alone))
    # Flat keys, so that rows that already lie by key are summed where they are.
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, at, strict=True)], *[F.col(c).cast("double").alias(v) for c, v in zip(columns, own, strict=True)])
    mixed = [F.when(F.col(f"__sv_t{i}"), F.col(own[i])).otherwise(F.col(f"__sv_b{i}")).alias(c) for i, c in enumerate(columns)]
    kept = [*at, *own, *[f"__sv_w{i}" for i in n], "__sv_full", "__sv_base", "__sv_bases"]
    scored = predict(rows.crossJoin(F.broadcast(cut_lineage(mixes))).select(*kept, *mixed)).select(*kept, "prediction")
    sums = [F.sum(F.when(F.col(f"__sv_w{i}") != 0, F.col(f"__sv_w{i}") * F.col("prediction"))).alias(f"__sv_d{i}") for i in n]
    by = scored.groupBy(*at, *own).agg(*sums, F.max(F.when(F.col("__sv_full"), F.col("prediction"))).alias("prediction"), F.max("__sv_base").alias("base"), F.max("__sv_bases").alias("__sv_bases"))

    def share(i: int) -> Column:
        first = F.col("__sv_bases") * float(none[i]) if none[i] else F.lit(None).cast("double")
        total = F.coalesce(F.col(f"__sv_d{i}") + first, F.col(f"__sv_d{i}"), first)
        return (total / F.lit(float(max(1, len(orders) * met)))).alias("attribution")

    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(own[i]).alias("value"), share(i)) for i, c in enumerate(columns)])
    out = by.select(*[F.col(a).alias(k) for k, a in zip(keys, at, strict=True)], F.inline(parts), "prediction", "base")
    return out.select(*keys, "feature", "value", "attribution", "prediction", "base")


def attribution_ranking(values: DataFrame, family: list[str]) -> DataFrame:
    """Per feature: mean |attribution|, rank, whether its name starts with a prefix of the family, and its rank there."""
    inside = F.lit(False)
    for prefix in family:
        inside = inside | F.col("feature").startswith(prefix)
    out = values.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"), F.count(F.lit(1)).alias("n_rows")).withColumn("in_family", inside)
    order = [F.desc("mean_abs"), F.col("feature")]
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # a row a column
    own = F.row_number().over(Window.partitionBy("in_family").orderBy(*order))
    return out.withColumns({"rank": place, "family_rank": F.when(F.col("in_family"), own)})


def attribution_report(ranking: DataFrame, top: int = 20, few: int = 5, lags: list[int] = (2, 4, 8)) -> DataFrame:
    """One row: the family's features in the top ``few`` of their own and in the top of all, how many, and the ranks of its
    features of these lags."""
    member = F.col("in_family")
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "feature")))), lambda x: x["feature"])
    lagged = F.lit(False)
    for k in lags:
        lagged = lagged | F.col("feature").contains(f"lag_{k}")
    return ranking.agg(
        listed(member & (F.col("family_rank") <= few)).alias("top_of_family"),
        listed(member & (F.col("rank") <= top)).alias("family_in_top"),
        F.count_if(member & (F.col("rank") <= top)).alias("n_family_in_top"),
        F.array_sort(F.collect_list(F.when(member & lagged, F.concat_ws("=", "feature", F.col("rank").cast("string"))))).alias("lag_ranks"),
    )
