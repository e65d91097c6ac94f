"""Document fingerprints: a digest of the quartiles of hashed byte-triplet counts.

All triplets of neighbouring bytes are hashed into buckets; each bucket is coded 0 to 3 by the quartile of bucket counts
that its own lies in, and a length code leads. The difference of two digests is bounded; their likeness is 1 less the
difference over its bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512
#: Steps of the length code: this many to a doubling.
LENGTH_STEPS = 4
#: What a difference of 1, 2 and 3 quartiles counts, and of one length step, up to a bound.
BUCKET_COST = np.array([0, 1, 2.5, 6])
LENGTH_COST, LENGTH_BOUND = 4, 200
DIGEST_BYTES = 1 + BUCKETS // 4
#: Rows of a range of ids, and the most ranges: 8 MB of cuts. Tables of over MAX_RANGES * ROWS_PER_RANGE rows have more
#: rows to a range, in proportion.
ROWS_PER_RANGE = 4000
MAX_RANGES = 1 << 20
#: Ranges that one aggregation cuts; each of them is cut anew where there are to be more.
CUTS = 1024


def digest(data: bytes) -> str:
    """Lower-case hex of the length code and of two bits a bucket. Texts under three bytes have all buckets at 0."""
    length = min(255, round(LENGTH_STEPS * np.log2(len(data) + 1)))
    codes = np.zeros(BUCKETS, np.uint8)
    if len(data) > 2:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        key = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        key ^= key >> np.uint32(15)
        counts = np.bincount((key * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
        codes = np.searchsorted(np.sort(counts)[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]], counts, side="left").astype(np.uint8)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    return bytes([length]).hex() + packed.tobytes().hex()


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal digests, falling to 0 with the difference, which is bounded by that of unrelated random digests."""
    x, y = (np.frombuffer(bytes.fromhex("".join(d)), np.uint8).reshape(-1, DIGEST_BYTES) for d in (a, b))
    unpack = lambda m: np.stack([m[:, 1:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(m), -1).astype(np.int8)
    apart = BUCKET_COST[np.abs(unpack(x) - unpack(y))].sum(axis=1)
    steps = np.abs(x[:, 0].astype(int) - y[:, 0].astype(int))
    apart += np.minimum(LENGTH_COST * np.maximum(steps - 1, 0), LENGTH_BOUND)
    most = BUCKETS * BUCKET_COST[np.abs(np.subtract.outer(range(4), range(4)))].mean()
    return 1 - np.minimum(apart, most) / most


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: id and ``fingerprint``. Null counts as empty; repeated rows and null ids stay."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: digest((t or "").encode()))

    return docs.select(id_col, run(F.col(text_col).cast("string")).alias("fingerprint"))


def compare(left: str, right: str) -> Column:
    """Likeness of two columns of digests."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(likeness(a.tolist(), b.tolist()) if len(a) else [], dtype=float)

    return run(left, right)


def id_bounds(ids: DataFrame, ranges: int) -> np.ndarray:
    """First ids of all ranges but the first, at percentiles of column id: in one level, or in two of about equal size."""
    if ranges < 2:
        return np.zeros(0, np.int64)
    coarse = min(CUTS, ranges)
    cuts = ids.agg(F.percentile_approx("id", [i / coarse for i in range(1, coarse)], 10 * coarse)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))
    if ranges <= CUTS:
        return cuts
    fine = -(-ranges // CUTS)
    place = F.pandas_udf(lambda x: pd.Series(np.searchsorted(cuts, x.to_numpy(), side="right")), "int")
    within = ids.where("id is not null").groupBy(place("id").alias("range")).agg(F.percentile_approx("id", [i / fine for i in range(1, fine)], 10 * fine).alias("cuts"))
    return np.unique(np.concatenate([cuts, *[np.array(r["cuts"], np.int64) for r in within.collect()]]))


def with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """id, text, fingerprint, and the text and fingerprint of the next row by ascending id (after the last: the first).

    Ids are cut into ranges at percentiles of the ids themselves (MAX_RANGES numbers on the driver at most); the first
    row of a range also goes to the range before, so that one shuffle by range gives every row its successor. Ids are
    integers, others raise TypeError. Null ids come first; rows of equal id stand in the order of their texts, all in
    one range. A single row is its own successor. Other columns are not read.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("ids must be integers")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    found = ids.agg(F.count("id").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("id").alias("least")).first()
    bounds = id_bounds(ids, min(MAX_RANGES, max(1, found["n"] // rows_per_range)))
    bounds = bounds[bounds > found["least"]] if len(bounds) else bounds
    nulls, least, last = found["rows"] > found["n"], found["least"], len(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, text = batch.column(0), batch.column(1)
            prints = pa.array([digest(t.as_py().encode()) for t in text])
            null = np.asarray(pa.compute.is_null(key))
            value = np.asarray(pa.compute.fill_null(key, 0))
            place = np.where(null, 0, np.searchsorted(bounds, value, side="right"))
            yield pa.RecordBatch.from_arrays([key, text, prints, pa.array(place.astype(np.int32)), pa.array(np.zeros(len(key), np.int32))], names=names)
            first = null if nulls else value == least
            for again, to, kind in ((np.isin(value, bounds) & ~null, place - 1, 1), (first, np.full(len(key), last), 2)):
                if again.any():
                    at = pa.array(np.flatnonzero(again))
                    yield pa.RecordBatch.from_arrays([key.take(at), text.take(at), prints.take(at), pa.array(to[again].astype(np.int32)), pa.array(np.full(len(at), kind, np.int32))], names=names)

    names = ["id", "text", "fingerprint", "range", "kind"]
    placed = rows.mapInArrow(run, "id bigint, text string, fingerprint string, range int, kind int")
    order = Window.partitionBy("range").orderBy("kind", F.col("id").asc_nulls_first(), "text")
    out = placed.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint")).where("kind = 0")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "fingerprint", F.coalesce("next_text", "text").alias("next_text"), F.coalesce("next_fingerprint", "fingerprint").alias("next_fingerprint"))


def edited(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_chars, ``edited`` (the last quarter of code points replaced by the first as many of next_text), its fingerprint and likenesses."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: digest(t.encode()))

    n = F.length(text_col)
    cut = F.floor(n / 4).cast("int")
    out = docs.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col(text_col), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))})
    out = out.drop(text_col, "next_text").withColumn("edited_fingerprint", run("edited"))
    return out.withColumns({"near_edited": compare("fingerprint", "edited_fingerprint"), "near_next": compare("fingerprint", "next_fingerprint")})
