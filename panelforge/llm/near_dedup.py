"""Near duplicates of word shingles: SuperMinHash signatures, banding, verification and union-find grouping.

Signatures come from correlated permutation ranks: each element walks a pseudo-random permutation of the signature's
places and offers rank plus a uniform number; a text stops as soon as no later rank can improve any place. Texts whose
signatures agree on a band of places meet in a bucket. Links are confirmed on the full shingle sets, in two rounds:

1. each text with the heads (smallest ids) of its buckets,
2. in buckets that still hold several components, what may link across components, compared block by block inside tasks:
   the bucket's largest component against the rest, and the rest among itself (only links that join components become
   rows). A bucket whose rest is too large for that is dealt out anew by further places of the signatures, which a pair
   at the threshold shares somewhere with all but certainty, so that no text is sent to more than about MAX_BLOCKS blocks.

Components come from alternating large-star and small-star rounds with union-find inside each task. Nothing that grows
with the corpus reaches the driver. Tables between the steps are written to the shared checkpoint folder and removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut_lineage, unused

PLACES = 128
BANDS = 32
ROWS = PLACES // BANDS
#: Standard errors below the threshold at which a signature estimate rules a pair out.
SLACK = 6.0
BLOCK_ELEMENTS = 200_000
BLOCK_MEMBERS = 512
#: Most blocks that the rest of a bucket may fill before the bucket is dealt out anew.
MAX_BLOCKS = 32
#: Places of a key by which a large bucket is dealt out anew.
UNIT = 3
UNITS = PLACES // UNIT
#: Nodes that union-find holds in a task before it passes on what it has.
MAX_NODES = 500_000
MAX_CACHED = 500_000
#: Shingles whose sets a task holds at once to confirm links, or those of two texts: 64 MB. Blocks that a block is cut into.
GROUP_SHINGLES, SUBS = 1 << 23, 1024
MAX_BROADCAST_IDS = 200_000
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ x >> np.uint64(30)) * _P2
    x = (x ^ x >> np.uint64(27)) * _P3
    return x ^ x >> np.uint64(31)


class Shingler:
    """Distinct hashes of word shingles; words are hashed once and remembered."""

    def __init__(self, words: int) -> None:
        self.words, self.cache = words, {}

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle; none without words."""
        found, cache = (text or "").encode().lower().split(), self.cache
        if not found:
            return np.zeros(0, np.uint64)
        if len(cache) > MAX_CACHED:
            cache.clear()
        for w in found:
            if w not in cache:
                cache[w] = int.from_bytes(xxhash.xxh3_64_digest(w), "big", signed=True)
        h = np.fromiter(map(cache.__getitem__, found), np.int64, len(found)).view(np.uint64)
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * _P1 + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each set (not empty), 16 bits a place."""
    sizes = np.array([len(s) for s in sets])
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    best = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    walked: list[np.ndarray] = []
    rank_bits = np.uint64(48)
    for rank in range(places):
        if rank:
            # A text goes on while some place holds a value of this rank or above.
            going = (best >> rank_bits).max(axis=1) >= rank
            keep = going[owner]
            if not keep.all():
                element, owner, walked = element[keep], owner[keep], [w[keep] for w in walked]
            if not len(element):
                break
        draw = mix(element + np.uint64((rank + 1) * int(_P1) % (1 << 64)))
        step = (np.uint64(rank) + ((draw >> np.uint64(40)) * np.uint64(places - rank) >> np.uint64(24))).astype(np.int16)
        place = step.copy()
        for i in range(rank - 1, -1, -1):  # where the swaps so far have put the drawn place
            place[place == walked[i]] = i
        walked.append(step)
        value = (draw ^ draw << np.uint64(9)) >> np.uint64(16) | np.uint64(rank) << rank_bits
        np.minimum.at(best.ravel(), owner * places + place, value)
    return (mix(best) >> np.uint64(48)).astype("<u2")


def sketch(docs: DataFrame, words: int, text_col: str, id_col: str) -> DataFrame:
    """Per row: id, n (distinct shingles), ``same`` (digest of the whole set) and ``sig``; both null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, sets, held = 0, [], 0
            for i in range(batch.num_rows):
                sets.append(shingler.hashes(texts[i].as_py()))
                held += len(sets[-1])
                if held < BLOCK_ELEMENTS and i + 1 < batch.num_rows:
                    continue
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full) if full else [])
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())], names=["id", "n", "same", "sig"])
                at, sets, held = i + 1, [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n bigint, same binary, sig binary")


def full_sets(docs: DataFrame, ids: DataFrame, words: int, text_col: str, id_col: str) -> DataFrame:
    """id, ``same`` and ``items`` (all shingle hashes, sorted) of the rows of docs with these ids."""
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            items = [shingler.hashes(t.as_py()).tobytes() for t in batch.column(1)]
            same = [hashlib.blake2b(s, digest_size=16).digest() for s in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(items, pa.binary())], names=["id", "same", "items"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, same binary, items binary")


def single_sets(keep: Callable, sets: DataFrame) -> DataFrame:
    """id and items of sets, once for each id and text; only repeated rows call for the shuffle of whole sets."""
    sets = keep(sets)
    if sets.groupBy("id", "same").count().where("count > 1").limit(1).count():
        sets = keep(sets.dropDuplicates(["id", "same"]))
    return sets.select("id", "items")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in pairs]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def close_enough(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures (places on the last axis) may be those of sets at the threshold."""
    p = percent / 100
    return (x == y).mean(axis=-1) >= p - SLACK * np.sqrt(p * (1 - p) / x.shape[-1])


def plausible(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs that their signatures and sizes don't rule out."""
    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("x"), F.col("n").alias("n1"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("y"), F.col("n").alias("n2"))
    both = pairs.join(left, "a").join(right, "b").where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, PLACES) for k in (2, 3))
                mask = pa.array(close_enough(x, y, percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def contracted(edges: DataFrame) -> DataFrame:
    """Union-find inside each task: edges (a, b) become (node, smallest node that the task connects it with)."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def stars(kinds: pa.DataType) -> pa.RecordBatch:
            rows = [(x, root(x)) for x in list(parent)]
            rows = [(x, r) for x, r in rows if x != r]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], kinds), pa.array([r for _, r in rows], kinds)], names=["a", "b"])

        held = None
        for batch in batches:
            held = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > MAX_NODES:
                yield stars(held)
        if parent:
            yield stars(held)

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame, keep: Callable = cut_lineage) -> DataFrame:
    """edges (a, b) to rows (id, component): each node but the components' smallest, and its component's smallest node.

    keep: how to store the tables of a round.
    """
    stars = keep(contracted(edges).distinct())
    while True:
        ends = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, down = F.count(F.when(F.col("b") < F.col("a"), 1)), F.count(F.when(F.col("b") > F.col("a"), 1))
        least = keep(ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), up.alias("up"), down.alias("down")))
        # Done when every node has one smaller neighbour and no larger one, or the other way round.
        if not least.where("up > 1 or (up = 1 and down > 0)").limit(1).count():
            return stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour.
        large = ends.join(least.select("a", "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every smaller neighbour, and the node itself, is tied to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        stars = keep(contracted(keep(small.distinct())).distinct())


def with_component(rows: DataFrame, groups: DataFrame, id_col: str, name: str) -> DataFrame:
    """rows with the component of an id column; an id outside all groups is its own."""
    found = groups.select(F.col("id").alias("__id"), F.col("component").alias("__c"))
    return rows.join(found, rows[id_col] == found["__id"], "left").withColumn(name, F.coalesce("__c", id_col)).drop("__id", "__c")


def mixed_buckets(members: DataFrame) -> DataFrame:
    """Buckets (key) of several components: the largest one, and the blocks that it and the rest of the members fill."""
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    stats = parts.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("largest"), F.sum("size").alias("size"))
    blocks = lambda c: F.ceil(c / BLOCK_MEMBERS).cast("int")
    return stats.where("size > largest").select("key", "main", blocks(F.col("largest")).alias("main_blocks"), blocks(F.col("size") - F.col("largest")).alias("rest_blocks"))


def blocks_of(members: DataFrame, buckets: DataFrame, sigs: DataFrame) -> DataFrame:
    """Rows (key, i, j) to compare: block i is of the bucket's rest, block j of the rest too or of the largest component.

    Members of the largest component go to as many rows as the rest has blocks, the others to one for each block.
    """
    rows = members.join(buckets, "key").join(sigs.select("id", "sig", "n"), "id")
    rest, main = F.col("rest_blocks"), F.col("main_blocks")
    is_main, spread = F.col("component") == F.col("main"), F.xxhash64("id")
    own = F.when(is_main, rest + F.pmod(spread, main)).otherwise(F.pmod(spread, rest)).cast("int")
    rows = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.when(is_main, rest).otherwise(rest + main) - 1))})
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "unit", "id", "component", "n", "sig")


def dealt_anew(members: DataFrame, buckets: DataFrame, sigs: DataFrame) -> DataFrame:
    """Members of large buckets once for each unit of places outside the bucket's band, under a key of both.

    A pair at the threshold shares one of the 38 units or more with a probability short of 1 by (1 - 0.8 ** 3) ** 38.
    """
    piece = lambda u: F.substring(F.col("sig"), u * 2 * UNIT + 1, F.lit(2 * UNIT))
    apart = lambda u: (u * UNIT + (UNIT - 1) < F.col("band") * ROWS) | (u * UNIT > F.col("band") * ROWS + (ROWS - 1))
    units = F.transform(F.filter(F.sequence(F.lit(0), F.lit(UNITS - 1)), apart), lambda u: F.struct(u.alias("unit"), F.xxhash64("key", u, piece(u)).alias("key")))
    rows = members.join(buckets.select("key"), "key").join(sigs.select("id", "sig"), "id").select("band", "id", "component", F.explode(units).alias("u"))
    return rows.select("u.key", "band", "u.unit", "id", "component")


def by_weight(blocks: DataFrame, most: int) -> DataFrame:
    """Block pairs whose sets are together larger than ``most`` shingles, cut into pairs of lighter blocks.

    Block b becomes blocks b * SUBS, b * SUBS + 1 and so on, each of about half of most; a pair of blocks becomes all pairs of
    theirs, so every two rows that met meet once again. Groups have at most 2 * BLOCK_MEMBERS rows.
    """
    order = ["key", "i", "j"]
    heavy = blocks.groupBy(*order).agg(F.sum("n").alias("weight")).where(F.col("weight") > most)
    if not heavy.limit(1).count():
        return blocks
    ahead = Window.partitionBy(*order, "own").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    sub = F.floor(F.coalesce(F.sum("n").over(ahead), F.lit(0)) / (most // 2)).cast("int")
    rows = blocks.join(heavy.select(*order), order).withColumn("sub", F.least(sub, F.lit(SUBS - 1)))
    subs = rows.groupBy(*order).agg(F.max(F.when(F.col("own") == F.col("i"), F.col("sub"))).alias("subs_i"), F.max(F.when(F.col("own") == F.col("j"), F.col("sub"))).alias("subs_j"))
    rows = rows.join(subs, order)
    other = F.when(F.col("own") == F.col("i"), F.col("subs_j")).otherwise(F.col("subs_i"))
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(0)))))
    first, same = F.col("own") == F.col("i"), F.col("i") == F.col("j")
    i = F.when(same, F.least("sub", "met")).when(first, F.col("sub")).otherwise(F.col("met"))
    j = F.when(same, F.greatest("sub", "met")).when(first, F.col("met")).otherwise(F.col("sub"))
    cut = rows.withColumns({"own": F.col("own") * SUBS + F.col("sub"), "i": F.col("i") * SUBS + i, "j": F.col("j") * SUBS + j}).select(*blocks.columns)
    return blocks.join(heavy.select(*order), order, "left_anti").unionByName(cut)


def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first three columns (key, i, j), from batches sorted by them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = np.column_stack([table.column(k).to_numpy() for k in range(3)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield table.slice(start, end - start)
        held = table.slice(cuts[-1])
    if held is not None:
        yield held


def close_partners(g: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of the first block: rows of the second that may link with it, and how alike the signatures are.

    Only pairs of different components and fitting sizes count, and of these those that share no earlier band (nor an
    earlier unit of a bucket dealt out anew), so that a pair is compared once.
    """
    i, j, band, unit = (g.column(k)[0].as_py() for k in ("i", "j", "band", "unit"))
    sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), "<u2").reshape(-1, PLACES)
    part, n, own = g.column("component").to_numpy(), g.column("n").to_numpy(), g.column("own").to_numpy()
    right = np.flatnonzero(own == j)
    earlier = [u for u in range(unit) if u * UNIT + UNIT - 1 < band * ROWS or u * UNIT > band * ROWS + ROWS - 1]
    for r in np.flatnonzero(own == i):
        to = right[right > r] if i == j else right
        to = to[(part[to] != part[r]) & (np.minimum(n[to], n[r]) * 100 >= np.maximum(n[to], n[r]) * percent)]
        to = to[close_enough(sig[to], sig[r], percent)] if len(to) else to
        if band and len(to):
            to = to[~(sig[to, : band * ROWS] == sig[r, : band * ROWS]).reshape(len(to), band, ROWS).all(axis=2).any(axis=1)]
        if earlier and len(to):
            to = to[~(sig[to, : UNITS * UNIT] == sig[r, : UNITS * UNIT]).reshape(len(to), UNITS, UNIT).all(axis=2)[:, earlier].any(axis=1)]
        if len(to):
            yield int(r), to, (sig[to] == sig[r]).mean(axis=1)


def similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    small, large = (u, v) if len(u) <= len(v) else (v, u)
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(u) + len(v) - shared)


def close_members(blocks: DataFrame, percent: int) -> DataFrame:
    """The rows of blocks that have a close partner in another component there."""
    order = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in in_groups(batches):
            found = [np.append(to, r) for r, to, _ in close_partners(g, percent)]
            if found:
                yield from g.take(pa.array(np.unique(np.concatenate(found)))).combine_chunks().to_batches()

    return blocks.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, blocks.schema)


def links_within(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between the components of a block pair, as few as connect what is linked there.

    Full sets join the rows; each task confirms its close pairs, the closest first, until their components are joined.
    Rows out are at most rows in.
    """
    kind, order = blocks.schema["id"].dataType.simpleString(), ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in in_groups(batches):
            part, ids = g.column("component").to_pylist(), g.column("id").to_pylist()
            items = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column("items")]
            parent = {p: p for p in part}
            links = []

            def root(x, parent=parent):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for r, to, likeness in close_partners(g, percent):
                for t in to[np.argsort(-likeness)].tolist():
                    a, b = root(part[r]), root(part[t])
                    if a != b and similar(items[r], items[t], percent):
                        parent[max(a, b)] = min(a, b)
                        links.append((ids[r], ids[t]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], g.schema.field("id").type) for k in (0, 1)], names=["a", "b"])

    rows = blocks.join(sets, "id").select(*blocks.columns, "items")
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, f"a {kind}, b {kind}")


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct word shingles (A-Z in
    lower case; words are runs of anything but ASCII white space; a text shorter than a shingle is one shingle).
    component_id is the smallest id reachable, kept marks the document that has it. Null texts and texts without words
    have no shingles and are linked with nothing; so are rows without an id, whose component_id is null and which are
    kept. Rows that repeat an id are one document, linked by any of its texts. Ids are integers or strings. Other
    columns are not read.

    A pair at the threshold meets in a band with probability 1 - (1 - 0.8 ** 4) ** 32, short of 1 by 5e-8, and its
    signature is too far off with probability 3e-8 (SLACK standard errors), so 8e-8 in all; other steps are exact but
    for the units of dealt_anew (2e-12).
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint", "string"):
        raise TypeError("ids must be integers or strings")
    with Scratch(docs.sparkSession) as scratch:
        keep = scratch.keep
        rows = keep(sketch(docs, words, text_col, id_col))
        # One row for each set of shingles, that of its smallest id.
        reps = rows.where(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("same").agg(F.min(F.struct("id", "n", "sig")).alias("r"))
        reps = keep(reps.select("same", "r.*"))
        band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * 2 * ROWS + 1, F.lit(2 * ROWS))))
        bands = reps.select("id", F.posexplode(band).alias("band", "key"))
        # A table of its own, so that Spark can split the large keys of the join that follows.
        several = keep(bands.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot < top").select("key", "pivot"))
        members = keep(bands.join(several, "key").select("key", "band", "id", "pivot"))

        heads = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
        pairs = keep(plausible(heads, reps, percent))
        sets = single_sets(keep, full_sets(docs, keep(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "id")), words, text_col, id_col))
        groups = components(keep(confirmed(pairs, sets, percent)), keep)

        placed = keep(with_component(members.select("key", "band", F.lit(-1).alias("unit"), "id"), groups, "id", "component"))
        buckets = keep(mixed_buckets(placed))
        small, large = buckets.where(F.col("rest_blocks") <= MAX_BLOCKS), buckets.where(F.col("rest_blocks") > MAX_BLOCKS)
        blocks = blocks_of(placed, small, reps)
        if large.limit(1).count():
            anew = keep(dealt_anew(placed, large, reps))
            blocks = blocks.unionByName(blocks_of(anew, keep(mixed_buckets(anew)), reps))
        close = keep(by_weight(keep(close_members(blocks, percent)), GROUP_SHINGLES))
        sets = single_sets(keep, full_sets(docs, keep(close.select("id").distinct()), words, text_col, id_col))
        links = keep(links_within(close, sets, percent))
        if links.limit(1).count():
            groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links), keep)

        found = keep(with_component(reps.select("same", "id"), groups, "id", "component_id").select("same", "component_id"))
        # An id stands in one component, even if it repeats with other texts.
        out = rows.select("id", "n", "same").join(found, "same", "left")
        component = F.coalesce("component_id", "id")
        return cut_lineage(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the documents of which a near duplicate with a smaller id stays; all columns. Cases as above."""
    (key,) = unused(docs, "gone")
    gone = near_components(docs, words, percent, text_col, id_col).where(~F.col("kept")).select(F.col(id_col).alias(key)).distinct()
    return docs.join(gone, docs[id_col] == gone[key], "left_anti")
