"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.

Null and empty texts score the share of good labels, are copies of one another (one stays), have no near copies, weigh
nothing in the mix and take one token each. A null doc_id stays; rows that repeat in id and text are copies. Of empty
tables every stage gives an empty one. Extra columns of docs are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import exact_dedup, mixing, near_dedup, packing, quality
from panelforge.llm.common import fold, read_table
from panelforge.sources.shared import new_folder, remove_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose quality score is below this are rejected: 1 percent of the good ones held out, 90 percent of the bad.
REJECT_BELOW = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier rejects; it learns from the labelled documents outside the held-out fold."""
    model = quality.train(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 2)
    return quality.score(docs, model).where(F.col("quality_score") >= REJECT_BELOW).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text: the one with the largest doc_id."""
    return exact_dedup.deduplicate(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return near_dedup.deduplicate(docs, words=5, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources reach their target weights."""
    return mixing.take(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each document, with its sequence and place."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), tokens=2048)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the signatures have no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What lies between them is written to the shared checkpoint folder, and removed there as
    soon as the next stage is written; the last stage's table stays, as the result reads it."""
    folder = new_folder(spark, "pipeline")
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove_folder(spark, last)
        last = f"{folder}/{name}"
    return docs
