"""Mixing sources to target weights by capped water-filling.

Each source asks for a share of the total by its weight. Sources over their cap (a number of passes over their own size)
are clamped to it and the excess is shared out again by weight, until none is above. A source's documents then repeat in
whole passes, and a last fractional pass takes documents in the order of a seeded hash until the target is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut_lineage, unused

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: Hash ranges that a source is cut into for the running sum of its sizes; a power of 16.
RANGES = 4096


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space); null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def with_running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with sums over all rows before in an order, which Spark deals out by range; the ranges' own sums, a row for
    each partition, are added up by the driver."""
    (part,) = unused(rows, "part")
    dealt = cut_lineage(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(part).agg(*[F.sum(c).alias(name) for name, c in sums.items()]).orderBy(part).collect()
    kinds = [dealt.select(F.sum(c).alias(name)).schema[name].dataType.simpleString() for name, c in sums.items()]
    ahead, at = [], {name: 0.0 if kind == "double" else 0 for name, kind in zip(sums, kinds, strict=True)}
    for r in totals:
        ahead.append((r[part], *at.values()))
        at = {name: v + r[name] for name, v in at.items()}
    own, names = unused(rows, "of"), [f"ahead_{name}" for name in sums]
    table = rows.sparkSession.createDataFrame(ahead, ", ".join([f"`{own[0]}` int", *[f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)]]))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(table), F.col(part) == F.col(own[0]))
    return out.withColumns({name: F.col(f"ahead_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}).drop(part, *own, *names)


def water_fill(sizes: DataFrame, weights: tuple = WEIGHTS, max_passes: float = MAX_PASSES, total: float | None = None) -> DataFrame:
    """sizes: source, source_size. Adds ``target``.

    Sources take the weights in turn, by code point and null last. total: what to share out (all sizes by default).
    A source is clamped exactly if its cap over its weight is below the water level; in that order the level after
    each source comes from running sums of caps and weights, so one pass over the table of sources replaces the rounds of
    clamping. Sources are dealt out by range in either order; no task holds them all.
    """
    null_last = [F.col("source").isNull(), F.col("source")]
    t = with_running_sums(sizes, null_last, {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    t = t.withColumn("weight", weight).withColumn("cap", F.lit(float(max_passes)) * F.col("source_size"))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight")).drop("place")
    t = with_running_sums(t, [F.col("ratio"), *null_last], {"caps": F.col("cap"), "heavy": F.col("weight")})
    whole = t.agg(F.sum("source_size").cast("double").alias("want"), F.sum("weight").alias("weights")).first()
    want = float(total) if total is not None else whole["want"] or 0.0
    t = t.withColumn("level", (F.lit(want) - F.col("caps")) / (F.lit(whole["weights"] or 0.0) - F.col("heavy")))
    # The first source that its level does not clamp, and all after it, share what is left at that level.
    first = t.where(F.col("cap") > F.col("level") * F.col("weight")).agg(F.min(F.struct("ratio", *[c.alias(f"o{i}") for i, c in enumerate(null_last)], "level"))["level"].alias("level")).first()
    fair = F.col("cap") if first["level"] is None else F.lit(first["level"]) * F.col("weight")
    return t.select("source", "source_size", F.least(F.col("cap"), fair).alias("target"))


def text_mark(text: Column) -> Column:
    """What tells the texts of one id apart."""
    return F.coalesce(F.xxhash64(text.cast("string")), F.lit(0))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_passes: float = MAX_PASSES, total: float | None = None, seed: int = 9, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: id, source, size, source_size, target, passes (times the mix takes the row), taken (its words).

    A row is in the last pass if less than half of its words lie beyond the target, its source's rows standing in hash
    order (of the id, or where it is null of the text). Rows that share an id stand in the order of their texts' hashes.
    Rows without words take part with size 0. Reruns give the same rows; rows that repeat in id and text may swap places
    only. Empty tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), text_mark(F.col(text_col)).alias("mark"))
    named = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("|"), F.col("mark").cast("string")))
    rows = rows.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), named).cast("binary")))
    rows = cut_lineage(rows)  # ids, sizes and hashes: the texts are read once
    rows = rows.withColumn("range", F.substring("h", 1, len(f"{RANGES - 1:x}")))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("range_size").over(ahead), F.lit(0))).drop("range_size")
    plan = ranges.join(water_fill(sizes, weights, max_passes, total).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumnsRenamed({"source": "s", "range": "r"})
    within = Window.partitionBy("source", "range").orderBy("h", "id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = rows.join(plan, rows["source"].eqNullSafe(plan["s"]) & (rows["range"] == plan["r"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    extra = (F.col("ahead") + F.col("inside") + F.col("size") / 2.0 <= rest) & (F.col("whole") < max_passes) & (F.col("source_size") > 0)
    out = out.withColumn("whole", whole.cast("int")).withColumn("passes", F.col("whole") + extra.cast("int"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).cast("long").alias("taken"), "mark")


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it does, with all columns of docs. Same cases as mix.

    Rows that repeat in id and text share their passes evenly.
    """
    id_col, text = options.get("id_col", "doc_id"), F.col(options.get("text_col", "text"))
    key, mark, n, rows, own, nth, k = unused(docs, "key", "mark", "n", "rows", "own", "nth", "k")
    times = mix(docs, **options).groupBy(F.col(id_col).alias(key), F.col("mark").alias(mark)).agg(F.sum("passes").alias(n), F.count(F.lit(1)).alias(rows)).where(F.col(n) > 0)
    times = cut_lineage(times)
    marked = docs.withColumn(own, text_mark(text))
    met = marked.join(times, marked[id_col].eqNullSafe(times[key]) & (marked[own] == times[mark]))
    passes = F.col(n)
    if times.where(F.col(rows) > 1).limit(1).count():
        met = met.withColumn(nth, F.row_number().over(Window.partitionBy(key, mark).orderBy(own)))
        passes = F.floor(F.col(n) / F.col(rows)) + (F.col(nth) <= F.col(n) % F.col(rows)).cast("long")
    met = met.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.when(passes > 0, passes))))
    return met.select(*docs.columns)
