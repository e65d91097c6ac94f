"""Runs of words that repeat with a period, found by seeds on diagonals.

A run is a stretch of words with smallest period q (words q apart are identical), of at least ``min_length`` words and
``min_periods`` periods, that no neighbouring word extends. On the diagonal of lag q it is a stretch of matches.

1. Seeds: k-grams of the least overlap that a run guarantees on its diagonal. Lags below 16 guarantee 16 matches, lags
   from 16 to 31 guarantee 32, and so on; each band of lags has grams longer than all of its lags.
2. Occurrence pairs: a gram longer than the period of its run occurs next exactly one period on, so pairs of neighbouring
   occurrences within a document are all that is needed, one a word and band. A band only looks at words whose gram of
   the band before occurs again.
3. Extension: a seed grows to both sides, word by word, on its diagonal. A table of the furthest match of each lag
   suppresses seeds that lie in a stretch already found.

Grams are compared by 64-bit hashes, matches by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, unused

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Grams of the first band; 16 words are what a run of 24 words or 3 periods guarantees at every lag below 16.
FIRST_GRAM = 16
BLOCK_WORDS = 1_000_000
MAX_CACHED = 500_000
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _P2
    x = (x ^ x >> np.uint64(27)) * _P3
    return x ^ x >> np.uint64(31)


def doubled(names: np.ndarray, k: int) -> np.ndarray:
    """Names of 2k-grams from those of k-grams."""
    return mix(names[: len(names) - k] * _P1 + names[k:]) if len(names) > k else names[:0]


def seeds(words: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per band: the grams' length, and first places and lags of neighbouring occurrences with a lag of the band.

    words: ids of the words of several texts, owner: the text of each, ends: the place after each text's last word.
    """
    names, k = mix(words.astype(np.uint64) + np.uint64(1)), 1
    while k < FIRST_GRAM:
        names, k = doubled(names, k), 2 * k
    places, low = np.arange(len(names)), 1
    while True:
        places = places[places + k <= ends[owner[places]]]
        keys = mix(names[places] ^ mix(owner[places].astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        again = (keys[1:] == keys[:-1]) & (owner[places[1:]] == owner[places[:-1]])
        lag = places[1:] - places[:-1]
        hit = again & (lag >= low) & (lag < k)
        yield k, places[:-1][hit], lag[hit]
        keep = np.zeros(len(places), bool)
        keep[1:] |= again
        keep[:-1] |= again
        places = np.sort(places[keep])
        if not len(places):
            return
        names, low, k = doubled(names, k), k, 2 * k


def matches(words: np.ndarray, i: int, lag: int, upto: int, step: int) -> int:
    """How many places from i on, in steps of 1 or -1 and short of upto, match the word a lag further on."""
    n, size = 0, 64
    while True:
        left = (upto - i) * step - n
        if left <= 0:
            return n
        size = min(2 * size, left)
        at = i + step * (n + np.arange(size))
        same = words[at] == words[at + lag]
        if not same.all():
            return n + int(same.argmin())
        n += size


def runs_of(words: np.ndarray, lengths: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, by start and period; words: ids of the texts' words in a row."""
    out: list[list] = [[] for _ in lengths]
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for k, place, lag in seeds(words, owner, ends):
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        covered: dict[int, int] = {}  # furthest match of each lag
        at = 0
        while at < len(place):
            i, d = int(place[at]), int(lag[at])
            if i < covered.get(d, 0):
                at += int(np.searchsorted(place[at : np.searchsorted(lag, d, side="right")], covered[d]))
                continue
            text = int(owner[i])
            first, last = int(ends[text]) - lengths[text], int(ends[text])
            forward = matches(words, i, d, last - d, 1)
            back = matches(words, i - 1, d, first - 1, -1)
            covered[d] = i + max(forward, 1)
            length = back + forward + d
            if forward >= k and length >= max(min_length, min_periods * d):
                out[text].append((i - back - first, length, d))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``n_words``, ``runs`` and ``collapsed``, the words without the repeats of runs, joined by one space.

    Words are runs of anything but ASCII white space. runs: start (word number from 0), length and period of each run of
    24 words and 3 periods or more, by start, then period. A word is dropped if some run contains it after that run's
    first period. Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows and null ids are
    treated alike; other columns stay, those of the new names are replaced. A text is handled in its own row in time and
    memory that grow with its words, whatever repeats in it.
    """
    added = ("n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c.lower() not in added]
    (own,) = unused(docs, "own_text")
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())])

    def block(split: list[list[bytes]], ids: dict[bytes, int]) -> tuple[list, list, list]:
        found = runs_of(np.array([ids.setdefault(w, len(ids)) for words in split for w in words], np.int64), [len(x) for x in split])
        left = []
        for words, runs in zip(split, found, strict=True):
            if runs:
                cover = np.zeros(len(words) + 1, np.int64)
                for start, length, period in runs:
                    cover[start + period] += 1
                    cover[start + length] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            left.append(b" ".join(words).decode())
        return [len(x) for x in split], [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        for batch in batches:
            at, split, held = 0, [], 0
            for i, text in enumerate(batch.column(len(kept))):
                split.append((text.as_py() or "").encode().split())
                held += len(split[-1])
                if held < BLOCK_WORDS and i + 1 < batch.num_rows:
                    continue
                if len(ids) > MAX_CACHED:
                    ids.clear()
                counts, runs, left = block(split, ids)
                rows = batch.slice(at, len(split))
                yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in range(len(kept))], pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(left, pa.string())], names=schema.names)
                at, split, held = i + 1, [], 0

    return docs.select(*kept, F.col(text_col).cast("string").alias(own)).mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, compared exactly; ties: the first in order. Null without runs."""
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(more(x, best), x).otherwise(best))


def with_planted_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs where texts whose id's crc32 ends in 0 hold a repeat: every word from a on becomes one of the p words from a.

    Such texts are given as their words joined by one space. Null ids and texts without words stay as they are.
    """
    words, first, period = unused(docs, "words", "first", "period")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    found = F.when(h % 10 == 0, F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD_PATTERN), F.lit(0)))
    n, a, p = F.size(words), F.col(first), F.col(period)
    out = docs.withColumn(words, found).withColumn(first, F.when(n > 0, (g % n).cast("int")))
    out = out.withColumn(period, (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return out.withColumn(text_col, F.when(a.isNull(), F.col(text_col)).otherwise(planted)).select(*docs.columns)
