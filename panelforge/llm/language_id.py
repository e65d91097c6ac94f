"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become letters in lower case with one blank for anything else; runs of one to three characters hash into buckets.
A bounded sample of labelled rows gives bucket counts per language, the smoothed log-probability matrix is broadcast in
blocks of languages (each of a fixed bound), and a batch of texts is scored as one sparse gather and segmented sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, unit_hash

ORDERS = (1, 2, 3)
#: Hash multipliers of the characters of an n-gram.
MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)
BLOCK_CHARS = 1 << 19
#: Values of the matrix that are gathered at once: 16 MB whatever the number of languages.
BLOCK_VALUES = 1 << 22
#: Languages of a block, which bounds what is broadcast at once: languages x buckets x 4 bytes, 128 MB at this many.
BLOCK_LANGUAGES = 2000
#: What may be a letter: numerals such as "½" and "②" are word characters too, so isalpha has the last word.
_WORD = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For each code point, itself if it is a letter, else a blank."""
    points = np.arange(0x110000, dtype=np.uint32)
    points[[i for i in range(0x110000) if not chr(i).isalpha()]] = 32
    return points


_letters: list[np.ndarray] = []


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and blanks of the texts in lower case, a blank around each, and the place after each text's last.

    So no n-gram that counts reaches into the next text.
    """
    if not _letters:
        _letters.append(letter_table())
    low = [t.lower() for t in texts]
    return _letters[0][np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le"), np.uint32)], np.cumsum([len(t) + 2 for t in low])


def ngram_buckets(cps: np.ndarray, start: int, end: int, buckets: int) -> Iterator[np.ndarray]:
    """For each order: the bucket of the n-gram at each place from start to end (``buckets`` where blanks lead)."""
    own = cps[start : end + 2]
    own = np.concatenate([own, np.full(end - start + 3 - len(own), 32, np.uint32)])
    n, blank = end - start, own == 32
    for order in ORDERS:
        key = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            key = (key ^ own[k : n + k] * MIX[k]) * np.uint32(0x85EBCA6B)
            key ^= key >> np.uint32(15)
        key &= np.uint32(buckets - 1)
        key[blank[:n] & (blank[1 : n + 1] if order > 1 else True)] = buckets
        yield key


def blocks(texts: list[str]) -> Iterator[slice]:
    """Slices of texts of a bounded size, or of one long text."""
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > BLOCK_CHARS:
            yield slice(at, i)
            at, held = i, 0
        held += len(t) + 2
    if at < len(texts):
        yield slice(at, len(texts))


def has_letter(text: str | None) -> bool:
    return bool(text) and _WORD.search(text) is not None and any(map(str.isalpha, text))


@dataclass
class LanguageBlock:
    """Some languages, in order; log_probs: one row a bucket and a last row of zeros, one column a language."""

    languages: list[str]
    log_probs: np.ndarray
    log_prior: np.ndarray

    def measure(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Of each text the likeliest language of the block (none without a letter), its log probability, and the log of
        the sum over the block's languages."""
        best, most, total_log = [None] * len(texts), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        chosen = [texts[i] for i in known]
        step = max(1, BLOCK_VALUES // max(1, len(self.languages)))
        for part in blocks(chosen):
            cps, ends = code_points(chosen[part])
            total = np.tile(self.log_prior, (len(ends), 1))
            # A stretch of characters at a time, across texts and inside long ones: its rows of the matrix, summed by text.
            for at in range(0, len(cps), step):
                upto = min(at + step, len(cps))
                first, last = np.searchsorted(ends, [at, upto - 1], side="right")
                starts = np.concatenate([[0], ends[first:last] - at])
                for key in ngram_buckets(cps, at, upto, len(self.log_probs) - 1):
                    total[first : last + 1] += np.add.reduceat(self.log_probs[key], starts, axis=0)
            top = total.max(axis=1)
            sums = top + np.log(np.exp(total - top[:, None]).sum(axis=1))
            most[known[part]], total_log[known[part]] = top, sums
            for i, k in zip(known[part], total.argmax(axis=1), strict=True):
                best[i] = self.languages[k]
        return best, most, total_log


@dataclass
class LanguageModel:
    """Blocks of languages, by name; none where nothing was learned."""

    blocks: list[LanguageBlock]

    @property
    def languages(self) -> list[str]:
        return [x for b in self.blocks for x in b.languages]

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability; ``und`` and 0 where no letter is found."""
        best, most, total = [UNKNOWN] * len(texts), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
        for block in self.blocks:
            own, top, sums = block.measure(texts)
            for i in np.flatnonzero(top > most):
                best[i], most[i] = own[i], top[i]
            total = np.logaddexp(total, sums)
        known = np.isfinite(most)
        return best, np.where(known, np.exp(np.where(known, most - total, 0)), 0.0)


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 1500, buckets: int = 1 << 14, parts: int = 8, alpha: float = 0.5) -> LanguageModel:
    """Fit on about per_language rows of each language, picked by a hash of the id from rows where usable holds.

    Languages are counted in blocks of BLOCK_LANGUAGES, one block after the other. Rows without text or language teach
    nothing. Without any, the model has no language and answers ``und``.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()  # a row a language
    total = sum(r["n"] for r in found)
    named = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), unit_hash(F.col(id_col), seed=2).alias("u"))
    blocks = []
    for at in range(0, len(found), BLOCK_LANGUAGES):
        own = found[at : at + BLOCK_LANGUAGES]
        share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in own], "lang string, share double")
        sample = named.join(F.broadcast(share), "lang").where("u < share").select("lang", "text")
        counts = gram_counts(sample, [r["lang"] for r in own], buckets, parts)
        log_probs = np.log(counts + alpha) - np.log((counts[:-1] + alpha).sum(axis=0))
        log_probs[-1] = 0
        blocks.append(LanguageBlock([r["lang"] for r in own], log_probs.astype(np.float32), np.log([r["n"] for r in own]) - np.log(total)))
    return LanguageModel(blocks)


def gram_counts(sample: DataFrame, languages: list[str], buckets: int, parts: int) -> np.ndarray:
    """How often each bucket occurs in the texts of each language; a last row of zeros."""
    index = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
                sums = table.setdefault(lang, np.zeros(buckets + 1, np.int64))
                for part in blocks(own):
                    cps, _ = code_points(own[part])
                    for at in range(0, len(cps), BLOCK_CHARS):
                        for key in ngram_buckets(cps, at, min(at + BLOCK_CHARS, len(cps)), buckets):
                            sums += np.bincount(key, minlength=buckets + 1)
        for lang, sums in table.items():
            found = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([found.astype("<i4").tobytes()], pa.binary()), pa.array([sums[found].astype("<i8").tobytes()], pa.binary())], names=["lang", "bucket", "n"])

    counts = np.zeros((buckets + 1, len(languages)))
    for r in sample.repartition(parts).mapInArrow(count, "lang string, bucket binary, n binary").toLocalIterator():  # parts x languages rows
        counts[np.frombuffer(r["bucket"], "<i4"), index[r["lang"]]] += np.frombuffer(r["n"], "<i8")
    counts[-1] = 0
    return counts


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, lang_pred, score (posterior, 0 to 1). Null texts and texts without a letter: ``und``, 0.

    Repeated rows and null ids stay; other columns of docs are not read. Texts of any length are scored in stretches.
    A model of several blocks scores the texts once for each, in tasks of its own that hold no other block, and the
    blocks' answers meet by id and text.
    """
    sc, kind = docs.sparkSession.sparkContext, docs.schema[id_col].dataType.simpleString()
    if len(model.blocks) < 2:
        shared = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best, share = shared.value.score(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(share)], names=[id_col, "lang_pred", "score"])

        return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")

    def measured(block: LanguageBlock) -> DataFrame:
        shared = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best, most, total = shared.value.measure(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(most), pa.array(total)], names=["id", "key", "lang", "most", "total"])

        return rows.mapInArrow(run, f"id {kind}, key binary, lang string, most double, total double")

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("key"), text.alias("text"))
    every = cut_lineage(reduce(DataFrame.unionByName, map(measured, model.blocks)))
    # Equal rows get equal answers, so their number is what one block saw of them.
    first = F.min_by("lang", F.struct(-F.col("most"), F.col("lang")))
    most = every.groupBy("id", "key").agg(F.max("most").alias("top"), first.alias("lang"), (F.count(F.lit(1)) / len(model.blocks)).cast("long").alias("rows"))
    top = most.select(F.col("id").alias("r_id"), F.col("key").alias("r_key"), "top", F.col("lang").alias("best"), "rows")
    met = every.join(top, every["id"].eqNullSafe(top["r_id"]) & (every["key"] == top["r_key"]))
    odds = F.sum(F.exp(F.col("total") - F.col("top"))) / F.max("rows")
    out = met.groupBy("id", "key").agg(F.max("best").alias("lang"), F.max("top").alias("top"), odds.alias("odds"), F.max("rows").alias("rows"))
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    unknown = F.col("lang").isNull()
    return out.select(F.col("id").alias(id_col), F.when(unknown, UNKNOWN).otherwise(F.col("lang")).alias("lang_pred"), F.when(unknown, 0.0).otherwise(1 / F.col("odds")).alias("score"))
