"""Digests of whole files as a Python data source: each file is streamed in blocks, so its size has no bound."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import list_files

BLOCK_BYTES = 8 << 20
#: Files that one task reads at most; a task's files together have about this many bytes, or are one file.
TASK_FILES, TASK_BYTES = 256, 1 << 30


class DigestSource(DataSource):
    """Option ``files``: a JSON list of [path, length]."""

    @classmethod
    def name(cls) -> str:
        return "panelforge_digests"

    def schema(self) -> str:
        return "path string, length bigint, sha256 string"

    def reader(self, schema: object) -> DataSourceReader:
        return DigestReader(json.loads(self.options["files"]))


class DigestReader(DataSourceReader):
    def __init__(self, files: list) -> None:
        self.files = files

    def partitions(self) -> list[InputPartition]:
        tasks, held = [[]], 0
        for path, length in self.files:
            if tasks[-1] and (len(tasks[-1]) == TASK_FILES or held + length > TASK_BYTES):
                tasks.append([])
                held = 0
            tasks[-1].append(path)
            held += length
        return [InputPartition(t) for t in tasks]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        for path in partition.value:
            store, at = fs.FileSystem.from_uri(path)
            digest, length = hashlib.sha256(), 0
            with store.open_input_stream(at, compression=None) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
                    length += len(block)
            yield path, length, digest.hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, file (its name), length and sha256 of each file below a path, hidden ones left out; an empty folder has none.

    The driver lists names and sizes; executors open the files themselves, by any address that Arrow's file systems know.
    """
    spark.dataSource.register(DigestSource)
    files = list_files(spark, path)
    if not files:
        return spark.createDataFrame([], "path string, file string, length bigint, sha256 string")
    found = spark.read.format(DigestSource.name()).option("files", json.dumps(files)).load()
    return found.selectExpr("path", "substring_index(path, '/', -1) as file", "length", "sha256")
