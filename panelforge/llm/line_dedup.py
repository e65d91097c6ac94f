"""Removal of boilerplate lines that many sites share.

Per line hash, HyperLogLog sketches of the sites are built beside the data and merge by aggregation. Lines whose estimate
is near the threshold get an exact distinct count; the others are decided by the sketch. Texts lose the lines that reach
the threshold. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, unused

MIN_SITES = 5
LG_K = 12
#: Lines whose estimate is within this share of the threshold, or this number of sites, are counted exactly. A sketch
#: of this size is off by 1.6 percent as a rule, and by less than one site below 200.
NEAR_SHARE, NEAR_SITES = 0.15, 2
#: Parts that each line's rows are split into for the exact counts, so that a very common line is many tasks' work.
PARTS = 64


def lines_of(text: Column) -> Column:
    """Hashes of a text's lines, null for blank ones."""
    return F.transform(F.split(text.cast("string"), "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(x)))


def distinct_lines(text: Column) -> Column:
    return F.array_compact(F.array_distinct(lines_of(text)))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", id_col: str | None = None) -> DataFrame:
    """``line``: xxhash64 of each line that is not blank and occurs on min_sites sites or more (null: a site of its own)."""
    if min_sites < 2:
        raise ValueError("min_sites must be 2 or more")
    site = F.coalesce(F.xxhash64(F.col(site_col).cast("string")), F.lit(0)).alias("site")
    lines = docs.select(site, F.explode(distinct_lines(F.col(text_col))).alias("line"))
    # Lines of one site are told by their least and largest site hash, which take no sketch.
    ends = lines.groupBy("line").agg(F.min("site").alias("least"), F.max("site").alias("most"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    spread = cut_lineage(ends.where("least <> most").select("line", "sites"))
    margin = max(NEAR_SITES, min_sites * NEAR_SHARE)
    clear = spread.where(F.col("sites") >= min_sites + margin).select("line")
    near = spread.where(F.abs(F.col("sites") - min_sites) < margin).select("line", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    part = F.pmod(F.xxhash64(*([id_col] if id_col else []), text_col), F.lit(PARTS)).cast("int").alias("part")  # by document, so that copies are dealt out too
    parted = docs.select(site, part, F.explode(distinct_lines(F.col(text_col))).alias("line"))
    exact = parted.join(near, ["line", "part"], "left_semi").groupBy("line").agg(F.countDistinct("site").alias("sites"))
    return clear.unionByName(exact.where(F.col("sites") >= min_sites).select("line"))


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with ``n_lines`` and ``n_removed``, and the text without its spread lines.

    Null texts stay null with 0 lines; blank lines are kept. Repeated rows are treated alike, as are rows that share an id;
    a null id has its lines removed too. Existing columns named n_lines and n_removed are replaced. A text is handled in the
    row it stands in, in time that grows with its lines.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    key, tag, own, own_tag, gone, every, places, left = unused(docs, "key", "tag", "own", "own_tag", "gone", "every", "places", "left")
    found = cut_lineage(spread_lines(docs, min_sites, text_col, site_col, id_col))  # a table of its own, so that Spark can split the join at a very common line
    mark = F.xxhash64(F.col(text_col).cast("string"))
    lines = docs.select(F.col(id_col).alias(key), mark.alias(tag), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line")).where("line is not null")
    hits = lines.join(found, "line").groupBy(key, tag).agg(F.collect_set("pos").alias(gone))  # at most a document's lines
    out = docs.withColumns({own: F.col(id_col), own_tag: mark})
    out = out.join(hits, F.col(own).eqNullSafe(F.col(key)) & (F.col(own_tag) == F.col(tag)), "left")
    out = out.withColumn(every, F.split(F.col(text_col).cast("string"), "\n"))
    # Places that stay, by one set lookup each.
    out = out.withColumn(places, F.when(F.col(gone).isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(gone))))
    out = out.withColumn(left, F.transform(places, lambda i: F.get(F.col(every), i)))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    removed = F.when(F.col(gone).isNull(), 0).otherwise(size(every) - size(places))
    counts = [size(every).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed")]
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in kept], *counts)
