"""Removal of repeated passages by prefix-partitioned suffix trees.

A passage of ``min_words`` words (a window) repeats if some document with a smaller id has it too. Suffixes start at
anchors: of the five-word prefixes that begin inside a window, the one with the least hash. Equal windows have equal
anchors at the same place, so every window belongs to the subtree of its anchor's prefix, and one suffix in about five
stands for all. The prefixes split the suffixes into groups of bounded size; a prefix that a sample shows to be frequent
is extended to the whole window, so that its suffixes spread over all groups. Each task builds the part of its subtrees
that matters: the nodes at a depth of min_words, told apart by fingerprints within their prefix, with the smallest
document below each. A node with several leaves is a deep internal node, and its leaves in later documents go.

Leaves that a task already knows to be repeated, as most of a very common passage or of a large group of copies, are
settled beside the data; only the smallest document of each passage is sent on from there.

Equal windows always meet. Two different windows are confused if they share the prefix's 48-bit hash and the 48-bit
fingerprint of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, unit_hash, unused

MIN_WORDS = 13
PREFIX_WORDS = 5
#: Words that are cut into windows at once, and windows whose subtrees are built at once, if groups allow.
BLOCK_WORDS, GROUP_WINDOWS = 400_000, 400_000
MAX_CACHED = 200_000
#: Documents sampled for frequent prefixes, and the number of times that makes one frequent there. These only lay out the
#: groups; results don't depend on them. At most 2 * 10^5 prefixes (1.6 MB) are broadcast.
SAMPLE_DOCS, FREQUENT, MAX_FREQUENT = 20_000, 200, 200_000
#: Ids that are null come after all others.
LAST_ID = (1 << 63) - 1
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << 48) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _P2
    x = (x ^ x >> np.uint64(27)) * _P3
    return x ^ x >> np.uint64(31)


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k codes in a row."""
    n = max(0, len(codes) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * _P1 + codes[i : i + n])
    return out


class WordCodes:
    """64-bit codes of words, remembered from text to text."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words, cache = (text or "").encode().split(), self.cache
        if len(cache) > MAX_CACHED:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def windows(codes: list[np.ndarray], size: int) -> tuple[np.ndarray, ...]:
    """Of the texts' windows, in order: text, start, place of the anchor (counted over all texts), prefix hash, fingerprint."""
    lengths = np.array([len(c) for c in codes])
    flat, ends = np.concatenate(codes), np.cumsum(lengths)
    owner = np.repeat(np.arange(len(codes)), lengths)
    k = min(PREFIX_WORDS, size)
    prefix = grams(flat, k)
    n = max(0, len(flat) - size + 1)
    least, at = prefix[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, size - k + 1):
        better = prefix[i : i + n] < least
        least[better], at[better] = prefix[i : i + n][better], i
    whole = np.flatnonzero(owner[:n] == owner[size - 1 :])
    text = owner[whole]
    return text, whole - (ends - lengths)[text], whole + at[whole], least[whole] & _LOW, grams(flat, size)[whole]


def later(prefix: np.ndarray, print_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which leaves (a prefix, a fingerprint and a document each) hang from a node that a smaller document hangs from too."""
    order = np.lexsort((ids, print_, prefix))
    p, f, d = prefix[order], print_[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (p[1:] != p[:-1]) | (f[1:] != f[:-1])
    out = np.empty(len(order), bool)
    out[order] = d > d[new][np.cumsum(new) - 1]
    return out


def planes(x: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of integers, one row a number."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)[:, :size]


def unplanes(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view(np.uint64).ravel()


def starts_table(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """One row a document: id, tag, and the starts of its windows."""
    order = np.lexsort((starts, tags, ids))
    i, t, s = ids[order], tags[order], starts[order]
    new = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1]))) if len(i) else np.zeros(0, np.int64)
    return pa.array(i[new]), pa.array(t[new]), pa.ListArray.from_arrays(pa.array(np.append(new, len(i)).astype(np.int32)), pa.array(s.astype(np.int32)))


def packed_marks(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Windows to remove, packed by part (a hash of the document's id): numbers of documents and windows, the documents'
    ids, tags and counts, and the windows' starts, as columns of bytes, whose many equal high ones compress."""
    part = (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((starts, tags, ids, part))
    part, ids, tags, starts = part[order], ids[order], tags[order], starts[order].astype(np.uint32)
    changes = np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])) if len(ids) else np.zeros(0, bool)
    doc = np.flatnonzero(changes)
    count = np.diff(np.append(doc, len(ids))).astype(np.uint32)
    cut = np.flatnonzero(np.append(True, part[doc][1:] != part[doc][:-1])) if len(doc) else doc
    out = []
    for a, b in zip(cut, [*cut[1:], len(doc)], strict=False):
        own, first = doc[a:b], doc[a]
        windows_ = starts[first : doc[b] if b < len(doc) else len(starts)]
        columns = (ids[own], tags[own], count[a:b], windows_)
        out.append((int(part[first]), np.array([b - a, len(windows_)], "<u4").tobytes() + b"".join(planes(x, x.itemsize).T.tobytes() for x in columns)))
    return out


def unpacked_marks(data: bytes) -> tuple[np.ndarray, ...]:
    """Id, tag and start of each window."""
    docs, n = np.frombuffer(data, "<u4", 2).tolist()
    at, out = 8, []
    for kind, rows in ((np.int64, docs), (np.int32, docs), (np.uint32, docs), (np.uint32, n)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, rows * size, at).reshape(size, rows).T).view(kind).ravel())
        at += rows * size
    ids, tags, count, starts = out
    return np.repeat(ids, count), np.repeat(tags, count), starts


#: A group's part from one block of texts (docs, runs and prints are packed), or (group below 0) packed marks of a part.
_PACKED = [("group", pa.int32()), ("docs", pa.binary()), ("runs", pa.binary()), ("prints", pa.binary()), ("part", pa.int32()), ("marks", pa.binary())]


def marks_batch(found: list[tuple[int, bytes]], more: bool) -> pa.RecordBatch:
    part, marks = pa.array([p for p, _ in found], pa.int32()), pa.array([m for _, m in found], pa.binary())
    if not more:
        return pa.RecordBatch.from_arrays([part, marks], names=["part", "marks"])
    none = pa.nulls(len(found), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([-1 - p for p, _ in found], pa.int32()), none, none, none, part, marks], schema=pa.schema(_PACKED))


def packed(ids: np.ndarray, tags: np.ndarray, codes: list[np.ndarray], size: int, groups: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a block of texts tells the groups: runs of windows that share an anchor, with their fingerprints."""
    text, start, anchor, prefix, print_ = windows(codes, size)
    print_ &= _LOW
    if not len(text):
        return
    gone = later(prefix, print_, ids[text])
    if gone.any():
        yield marks_batch(packed_marks(ids[text[gone]], tags[text[gone]], start[gone], groups), more=True)
    left = ~gone
    text, start, anchor, prefix, print_ = (x[left] for x in (text, start, anchor, prefix, print_))
    hot = np.isin(prefix, frequent)
    first = np.ones(len(text), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1]) | hot[1:]
    head = np.flatnonzero(first)
    group = (mix(np.where(hot[head], print_[head], prefix[head])) % np.uint64(groups)).astype(np.int32)
    order = np.argsort(group, kind="stable")
    length = np.diff(np.append(head, len(text)))
    places = np.argsort(np.repeat(group, length), kind="stable")  # windows, run by run in the order of their groups
    runs = np.hstack([planes(prefix[head], 6), planes(start[head].astype(np.uint32), 4), planes(length.astype(np.uint8), 1)])[order]
    prints, who, group = planes(print_[places], 6), text[head][order], group[order]
    bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    to = np.cumsum(length[order])
    out: list[list] = [[], [], [], []]
    for a, b in zip(bounds, np.append(bounds[1:], len(group)), strict=True):
        docs, index = np.unique(who[a:b], return_inverse=True)
        table = np.hstack([planes(ids[docs], 8), planes(tags[docs], 4)]).tobytes()
        out[0].append(group[a])
        out[1].append(len(docs).to_bytes(4, "little") + table + index.astype(np.uint32).tobytes())
        out[2].append(runs[a:b].tobytes())
        out[3].append(prints[to[a - 1] if a else 0 : to[b - 1]].tobytes())
    n = len(out[0])
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]], pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=pa.schema(_PACKED))


def unpacked(docs: bytes, runs: bytes, prints: bytes) -> tuple[np.ndarray, ...]:
    """The windows of a group's part: prefix, fingerprint, id, tag, start."""
    n = int.from_bytes(docs[:4], "little")
    table = np.frombuffer(docs, np.uint8, 12 * n, 4).reshape(n, 12)
    who = np.frombuffer(docs, np.uint32, offset=4 + 12 * n)
    rows = np.frombuffer(runs, np.uint8).reshape(-1, 11)
    length = rows[:, 10].astype(np.int64)
    of = np.repeat(np.arange(len(rows)), length)
    ids, tags = np.ascontiguousarray(table[:, :8]).view(np.int64).ravel()[who], np.ascontiguousarray(table[:, 8:]).view(np.int32).ravel()[who]
    start = np.ascontiguousarray(rows[:, 6:10]).view(np.uint32).ravel().astype(np.int64)[of] + np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
    return unplanes(rows[:, :6].tobytes(), 6)[of], unplanes(prints, 6), ids[of], tags[of], start


def text_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Ids, tags and word codes of the texts that have a window, a bounded number of words (or one text) at a time."""
    coder = WordCodes()
    for batch in batches:
        ids, tags, codes, held = [], [], [], 0
        for i, tag, text in zip(*[batch.column(k) for k in range(3)], strict=True):
            found = coder.of(text.as_py())
            if len(found) >= size:
                ids.append(i.as_py())
                tags.append(tag.as_py())
                codes.append(found)
                held += len(found)
            if held >= BLOCK_WORDS:
                yield np.array(ids, np.int64), np.array(tags, np.int32), codes
                ids, tags, codes, held = [], [], [], 0
        if codes:
            yield np.array(ids, np.int64), np.array(tags, np.int32), codes


def keyed(docs: DataFrame, text_col: str, id_col: str) -> list[Column]:
    """id (null: the last), a tag that tells texts of one id apart, and the text."""
    text = F.col(text_col).cast("string")
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tag"), text.alias("text")]


def frequent_prefixes(docs: DataFrame, size: int, n: int, text_col: str, id_col: str) -> np.ndarray:
    """Prefixes that occur often in a sample of about SAMPLE_DOCS of the n documents; only the layout depends on them."""
    sample = docs.where(unit_hash(F.col(id_col), seed=11) < F.lit(min(1.0, SAMPLE_DOCS / max(1, n)))).select(*keyed(docs, text_col, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, codes in text_blocks(batches, size):
            _, _, anchor, prefix, _ = windows(codes, size)
            new = np.append(True, anchor[1:] != anchor[:-1]) if len(anchor) else np.zeros(0, bool)
            found, times = np.unique(prefix[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(times)], names=["prefix", "n"])

    counts = sample.mapInArrow(run, "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return np.array([r[0] for r in counts.orderBy(F.desc("n"), "prefix").limit(MAX_FREQUENT).collect()], np.uint64)


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, tag, starts: the windows of each document that also start in a document with a smaller id; a row a document."""
    if not 1 <= min_words <= 255:
        raise ValueError("min_words must be 1 to 255")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = 2 * partitions
    frequent = spark.sparkContext.broadcast(frequent_prefixes(docs, min_words, docs.count(), text_col, id_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, codes in text_blocks(batches, min_words):
            yield from packed(ids, tags, codes, min_words, groups, frequent.value)

    def settled(parts: list[tuple]) -> pa.RecordBatch:
        prefix, print_, ids, tags, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        gone = later(prefix, print_, ids)
        return marks_batch(packed_marks(ids[gone], tags[gone], start[gone], groups), more=False)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, group = [], 0, None
        for batch in batches:
            known = batch.column("group").to_numpy()
            if (known < 0).any():
                yield batch.filter(pa.array(known < 0)).select(["part", "marks"])
            for i in np.flatnonzero(known >= 0):
                if known[i] != group and held >= GROUP_WINDOWS:
                    yield settled(parts)
                    parts, held = [], 0
                group = known[i]
                parts.append(unpacked(*[batch.column(k)[int(i)].as_py() for k in ("docs", "runs", "prints")]))
                held += len(parts[-1][0])
        if parts:
            yield settled(parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(starts_table(*(np.concatenate(x) for x in zip(*held, strict=True)))), names=["id", "tag", "starts"])

        for batch in batches:
            for p, marks in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and p != part:
                    yield whole()
                    held = []
                part = p
                held.append(unpacked_marks(marks.as_py()))
        if held:
            yield whole()

    rows = docs.select(*keyed(docs, text_col, id_col)).mapInArrow(cut, "group int, docs binary, runs binary, prints binary, part int, marks binary")
    marks = rows.repartition(partitions, "group").sortWithinPartitions("group").mapInArrow(grow, "part int, marks binary")
    return marks.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(gather, "id bigint, tag int, starts array<int>")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with ``n_words``, ``n_removed``, ``removed_spans`` and the kept words, joined by one space, as text.

    A word goes if it lies in a window of min_words words (runs of anything but ASCII white space, unchanged) that also
    starts in a document with a smaller id; windows are judged on the input. removed_spans: start and length, in words,
    of each maximal stretch that goes. Null and empty texts have no words (null stays null), texts shorter than a window
    lose none. Null ids come after all others; rows with equal ids are one document, which removes nothing from itself.
    Repeated rows are treated alike. Empty tables give no rows. Ids are integers. Existing columns of the new names are
    replaced; texts of any length are handled in the row they stand in.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("ids must be integers")
    added = ("n_words", "n_removed", "removed_spans")
    kept = [c for c in docs.columns if c.lower() not in added]
    key, mark, r_key, r_mark, starts = unused(docs, "key", "mark", "r_key", "r_mark", "starts")
    # A table of its own, so that Spark can split the join at ids that repeat.
    found = cut_lineage(repeated_windows(docs, min_words, text_col, id_col)).withColumnsRenamed({"id": r_key, "tag": r_mark, "starts": starts})
    own_id, tag, _ = keyed(docs, text_col, id_col)
    rows = docs.select(*kept, own_id.alias(key), tag.alias(mark))
    rows = rows.join(found, (rows[key] == found[r_key]) & (rows[mark] == found[r_mark]), "left").select(*kept, starts)
    at = kept.index(next(c for c in kept if c.lower() == text_col.lower()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, spans = [], [], []
            for text, marks in zip(batch.column(at), batch.column(len(kept)), strict=True):
                words = (text.as_py() or "").encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                if marks.is_valid:
                    s = np.unique(marks.values.to_numpy())
                    cover[s] += 1
                    np.add.at(cover, s + min_words, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()])
                counts.append((len(words), int(gone.sum())))
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans[-1] else words).decode() if text.is_valid else None)
            span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)], pa.array(spans, span)], names=[*kept, *added])

    rows = rows.withColumn(kept[at], F.col(kept[at]).cast("string"))
    long = T.LongType()
    spans = T.ArrayType(T.StructType([T.StructField("start", long), T.StructField("length", long)]))
    schema = T.StructType([*rows.drop(starts).schema.fields, T.StructField("n_words", long), T.StructField("n_removed", long), T.StructField("removed_spans", spans)])
    return rows.mapInArrow(run, schema)
