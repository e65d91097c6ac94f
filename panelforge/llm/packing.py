"""Packing documents into sequences by vector best-fit.

Items differ only in their length, and each length fixes the three demands: tokens, one document, and attention cost
(length squared). So the histogram of lengths (a row a length, at most the capacity) is all that the packing decides on:
bins are filled by best fit over residual tokens, documents and attention cost, and a filled bin repeats as a pattern
while its lengths last. Pieces then find their place by their rank within their length, ranked per length and hash
bucket with offsets, so that a common length is spread over many tasks. The result equals packing all items on one
machine, at the cost of one small shuffle.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, unused

RULES = ("dot", "norm")
#: What residual tokens, documents and attention cost weigh in the choice.
WEIGHTS = (1.0, 0.5, 0.5)
ROWS_PER_BUCKET = 20_000
MAX_BROADCAST_ROWS = 100_000


class ByteTokenizer:
    """Ids of a byte-level vocabulary file as little-endian 32-bit bytes."""

    def __init__(self, spec: str) -> None:
        import tiktoken

        from .token_count import byte_symbols

        conf = json.loads(spec)
        vocab, merges = conf["model"]["vocab"], conf["model"]["merges"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if made != sorted(made) or conf["normalizer"] or conf["pre_tokenizer"]["type"] != "ByteLevel" or conf["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level vocabulary whose ids follow its merges")
        special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        back = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}
        import public_tokenizers

        self.plain = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.mark = os.path.commonprefix(list(special))  # a cheap test that rules most texts out
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.spec, self.library = spec, None

    def words(self, text: str) -> bytes:
        try:
            return self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # a run of blanks too long for the pattern's matcher
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.spec)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        parts = self.split.split(text) if self.split and self.mark in text else [text]
        return b"".join(self.special[p] if i % 2 else self.words(p) for i, p in enumerate(parts))


_loaded: dict[int, ByteTokenizer] = {}


def tokenizer(spec: str) -> ByteTokenizer:
    """One tokenizer a worker process."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteTokenizer(spec)
    return _loaded[key]


def cut_pieces(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece: full ones, but for the first, which takes the remainder."""
    first = total % capacity or capacity
    for start in [0, *range(first, total, capacity)] if total > capacity else [0]:
        yield start, min(total, first) if start == 0 else capacity


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per piece of each row: id, piece, start, length, ids_crc32. A text's ids end with end_id; null counts as empty."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(spec.value).encode
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    rows.append((i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            at, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan_bins(counts: dict[int, int], tokens: int, documents: int | None = None, attention: float | None = None, weights: tuple = WEIGHTS, rule: str = "norm") -> list[tuple[list[tuple[int, int]], int]]:
    """Fill bins from counts (items by length). Returns patterns: [(length, items of it)], and how many bins have it.

    A bin opens with the item of the largest weighted demand and takes, while any fits all residual capacities, the item
    with the largest weighted dot product of demand and residual ("dot"), or the one that leaves the smallest weighted
    residual norm ("norm"). Demands and residuals are shares of the capacities.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    documents, attention = documents or tokens, attention or float(tokens) ** 2
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    left = np.array([counts[int(x)] for x in lengths], np.int64)
    if len(lengths) and (lengths[0] > tokens or float(lengths[0]) ** 2 > attention or lengths[-1] < 1):
        raise ValueError("an item fits no bin")
    caps, w = np.array([tokens, documents, attention], float), np.array(weights, float)
    need = np.column_stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2]) / caps
    patterns = []
    while left.any():
        room, bin_left, taken = np.ones(3), left.copy(), np.zeros(len(lengths), np.int64)
        while True:
            fits = np.flatnonzero((bin_left > 0) & (need <= room + 1e-12).all(axis=1))
            if not len(fits):
                break
            if not taken.any():
                best = fits[np.argmax(need[fits] @ w)]
            elif rule == "dot":
                best = fits[np.argmax(need[fits] @ (w * room))]
            else:
                best = fits[np.argmin(((room - need[fits]) ** 2) @ w)]
            taken[best] += 1
            bin_left[best] -= 1
            room = room - need[best]
        used = np.flatnonzero(taken)
        times = int((left[used] // taken[used]).min())
        left[used] -= times * taken[used]
        patterns.append(([(int(lengths[i]), int(taken[i])) for i in used], times))
    return patterns


def pack(pieces: DataFrame, tokens: int = 2048, documents: int | None = None, attention: float | None = None, weights: tuple = WEIGHTS, rule: str = "norm", id_col: str = "doc_id") -> DataFrame:
    """pieces with ``sequence_id`` and ``offset``: their bin and place in it, gapless from 0.

    No bin holds more than ``tokens`` tokens, ``documents`` pieces and ``attention`` summed squared lengths. pieces must
    stay the same when read again (cut_lineage). Equal lengths are interchangeable, so repeated rows each get a place.
    Columns of pieces named sequence_id and offset are not allowed. By default documents and attention bind no bin (a
    piece has one token or more, a sum of squares is at most the square of the sum); their weights count in the choice.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `tokens` rows
    rows, base, used = [], 0, {}
    for pattern, times in plan_bins(counts, tokens, documents, attention, weights, rule):
        offset = 0
        for length, each in pattern:
            first = used.get(length, 0)
            used[length] = first + each * times
            rows.append((length, first, used[length], each, base, offset))
            offset += length * each
        base += times
    spark = pieces.sparkSession
    own, start, after, every, bin_at, bin_offset = unused(pieces, "p_length", "first", "after", "each", "base", "p_offset")
    plan = spark.createDataFrame(rows, f"`{own}` bigint, `{start}` bigint, `{after}` bigint, `{every}` bigint, `{bin_at}` bigint, `{bin_offset}` bigint")
    if len(rows) <= MAX_BROADCAST_ROWS:
        plan = F.broadcast(plan)
    bucket, ahead, rank = unused(pieces, "bucket", "ahead", "rank")
    buckets = max(8, sum(counts.values()) // ROWS_PER_BUCKET)
    placed = pieces.withColumn(bucket, F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(ahead))
    sizes = sizes.select("length", bucket, F.coalesce(F.sum(ahead).over(earlier), F.lit(0)).alias(ahead))
    within = Window.partitionBy("length", bucket).orderBy(id_col, "piece", "ids_crc32")
    ranked = placed.join(sizes, ["length", bucket]).withColumn(rank, F.col(ahead) + F.row_number().over(within) - 1)
    out = ranked.join(plan, (F.col("length") == F.col(own)) & (F.col(rank) >= F.col(start)) & (F.col(rank) < F.col(after)))
    at = F.col(rank) - F.col(start)
    return out.select(*pieces.columns, (F.col(bin_at) + F.floor(at / F.col(every))).alias("sequence_id"), (F.col(bin_offset) + (at % F.col(every)) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, tokens: int = 2048, **options) -> DataFrame:
    """Tokenise, cut and pack docs: one row a piece. Null and empty texts take one token; empty tables give no rows."""
    columns = {k: options.pop(k) for k in ("text_col",) if k in options}
    id_col = options.get("id_col", "doc_id")
    pieces = cut_lineage(tokenized_pieces(docs, tokenizer_path, tokens, id_col=id_col, **columns))
    return pack(pieces, tokens, **options)
