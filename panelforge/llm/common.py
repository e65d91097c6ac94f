"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage, new_folder, remove_folder, shared_folder  # noqa: F401

#: Words are maximal runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; remainder 2 is held out from training. A null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(2))


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends only on the values and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 31)) / F.lit(float(1 << 31))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to differ from the columns of df (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


class Scratch:
    """Parquet tables of one call, in a folder of their own below the shared checkpoint folder; removed at the end.

    Unlike checkpoints they are compressed, read by column, and their small files share tasks when read again. What is
    returned to the caller must not depend on them: cut_lineage it before the block ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, 0
        self.folder = new_folder(spark, "tables")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove_folder(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a written table."""
        path, self.tables = f"{self.folder}/{self.tables}", self.tables + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
