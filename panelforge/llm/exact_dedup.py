"""Exact duplicates by deterministic block naming.

Equal texts get equal integers and different texts different ones, without trusting a hash:

1. Length and head tell most texts apart. Only texts that share both with another one are named.
2. These are cut into fixed-size blocks. The distinct blocks are sorted within hash partitions; a block's place, counted
   over all partitions, is its name.
3. Adjacent names pair up, the distinct pairs are sorted and named in turn, until each text has one name; a text leaves as
   soon as it has one.

A level's names are checkpointed as soon as they are given, so a lost executor can't change them. DataFrame operations
only; the largest group of copies passes through partial aggregation and skew-splittable joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, lower_ascii, unused

HEAD_CHARS = 256
BLOCK_CHARS = 4096


def named(keys: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct keys, each with an integer name: its place in the sorted order of its hash partition.

    The aggregation that removes repeats has dealt the keys out already; a sort by range would send samples of whole
    blocks to the driver.
    """
    ordered = keys.select(*columns).distinct().sortWithinPartitions(*columns)
    return cut_lineage(ordered.withColumn("name", F.monotonically_increasing_id()))


def same(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join on columns where null equals null, keeping the left ones."""
    other = right.withColumnsRenamed({c: f"r_{c}" for c in columns})
    on = None
    for c in columns:
        equal = left[c].eqNullSafe(other[f"r_{c}"])
        on = equal if on is None else on & equal
    return left.join(other, on, how).drop(*[f"r_{c}" for c in columns])


def block_names(texts: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """texts: id, sha, norm. Returns id, sha and ``name``: equal for rows of equal norm, else different.

    A text leaves at the level where it is one block; its name is that level and the block's name there.
    """
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    blocks = texts.select("id", "sha", F.greatest(F.size(cut), F.lit(1)).cast("long").alias("parts"), F.posexplode_outer(cut).alias("pos", "block"))
    blocks = cut_lineage(blocks.select("id", "sha", "parts", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), F.coalesce("block", F.lit("")).alias("block")))
    level = same(blocks, named(blocks, ["block"]), ["block"]).select("id", "sha", "parts", "pos", "name")
    longest, depth, out = blocks.agg(F.max("parts")).first()[0] or 1, 0, []
    while True:
        out.append(level.where("parts = 1").select("id", "sha", F.struct(F.lit(depth).alias("level"), "name").alias("name")))
        if longest == 1:
            return reduce(DataFrame.unionByName, out)
        first = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a")
        second = F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        half = F.ceil(F.col("parts") / 2).alias("parts"), F.floor(F.col("pos") / 2).alias("pos")
        pairs = cut_lineage(level.where("parts > 1").groupBy("id", "sha", *half).agg(first, second))
        level = same(pairs, named(pairs, ["a", "b"]), ["a", "b"]).select("id", "sha", "parts", "pos", "name")
        longest, depth = (longest + 1) // 2, depth + 1


def find_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z (null counts as empty). Of equal texts
    the row with the largest id stays; null ids come before all others, and of rows with the same id and text one is
    kept. text_sha256 is of the normalised text in UTF-8. Empty tables give no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Length and head hash only rule texts out: the same for equal texts, and cheap to compute twice.
    n, head = F.length(text).alias("n"), F.xxhash64(lower_ascii(F.substring(text, 1, HEAD_CHARS))).alias("head")
    base = cut_lineage(docs.select(F.col(id_col).alias("id"), F.sha2(lower_ascii(text).cast("binary"), 256).alias("sha"), n, head))
    # A table of its own, so that the join deals out both sides anew and Spark can split a large group of copies.
    shared = cut_lineage(base.groupBy("n", "head").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("n", "head"))
    alike = docs.select(F.col(id_col).alias("id"), text.alias("text"), n, head).join(shared, ["n", "head"], "left_semi")
    alike = alike.select("id", lower_ascii(F.col("text")).alias("norm")).select("id", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "norm")
    names = cut_lineage(block_names(alike, block_chars).distinct())
    sizes = base.select("id", "sha").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("rows"))
    listed = same(sizes, names, ["id", "sha"])
    groups = cut_lineage(listed.groupBy("name").agg(F.max("id").alias("keep_id"), F.sum("rows").alias("group_size")).where("group_size > 1"))
    members = names.join(groups, "name").select("id", "sha", "keep_id", "group_size")
    out = same(base.select("id", "sha"), members, ["id", "sha"], "left")
    single = F.col("group_size").isNull()
    repeat = F.expr("row_number() over (partition by id, sha order by id)")
    out = out.withColumn("nth", repeat).select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return out


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that find_duplicates drops, all columns. Same cases as there.

    Rows that repeat in id and text keep one row, any of them where their other columns differ.
    """
    sha, key, r_sha, r_key, drop, rows = unused(docs, "sha", "key", "r_sha", "r_key", "drop", "rows")
    found = find_duplicates(docs, text_col=text_col, id_col=id_col)
    gone = found.groupBy(F.col(id_col).alias(r_key), F.col("text_sha256").alias(r_sha)).agg(F.count_if(~F.col("kept")).alias(drop), F.count(F.lit(1)).alias(rows))
    gone = cut_lineage(gone.where(F.col(drop) > 0))
    text = F.coalesce(lower_ascii(F.col(text_col).cast("string")), F.lit(""))
    keyed = docs.withColumns({sha: F.sha2(text.cast("binary"), 256), key: F.col(id_col)})

    def met(left: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return left.join(some, left[key].eqNullSafe(some[r_key]) & (left[sha] == some[r_sha]), how)

    out = met(keyed, gone.where(F.col(drop) == F.col(rows)), "left_anti")
    # Of rows that repeat in id and text as the one that stays, one stays; most tables have none of these.
    some = gone.where(F.col(drop) < F.col(rows))
    if some.limit(1).count():
        out = met(out, some, "left_anti").unionByName(met(keyed, some, "left_semi").dropDuplicates([key, sha]))
    return out.select(*docs.columns)
