"""Tables published by key: what a run writes becomes visible at once, or not at all.

Rows lie in a fixed number of buckets by a hash of their key. A run writes the buckets that it changes to a folder of its
own and then a manifest that says where each bucket is; renaming the manifest into place is the one step that counts. A
run that fails before it leaves the table as it was, and buckets without new keys are not read or written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .publish import absent, replace_by_key
from .shared import cut_lineage, list_folder, read_text, remove_folder, write_once

BUCKETS = 64
_BUCKET = "__bucket"


class KeyedTable:
    """A published table at a path. Keys may be null (null meets null); a key has one row."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """An empty table; an error where there is one already."""
        out = cls(spark, path)
        out._swap({"version": 0, "keys": keys, "buckets": buckets, "schema": json.loads(schema.json()), "folders": {}})
        return out

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in list_folder(self.spark, f"{self.path}/manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        at = self.versions()[-1] if version is None else version
        return json.loads(read_text(self.spark, f"{self.path}/manifest/{at:012d}.json"))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the last version (or of one that is kept still), of all buckets or some."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(m["schema"])
        where = [f"{self.path}/data/{folder}/{_BUCKET}={b}" for b, folder in m["folders"].items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*where) if where else self.spark.createDataFrame([], schema)

    def insert(self, new: DataFrame) -> int:
        """Add the rows whose key the table lacks, of rows that share a key the first in the order of their columns.

        Returns how many buckets were rewritten.
        """
        m = self.manifest()
        rows = new.select(*T.StructType.fromJson(m["schema"]).fieldNames())
        touched = self._buckets(rows, m)
        had = self.read(m["version"], touched)
        fresh = cut_lineage(absent(had, rows, m["keys"]))
        changed = self._buckets(fresh, m)
        return self._publish(self.read(m["version"], changed).unionByName(fresh), changed, m)

    def replace(self, new: DataFrame) -> int:
        """Put the rows in place of those with their keys; cases as for insert."""
        m = self.manifest()
        rows = new.select(*T.StructType.fromJson(m["schema"]).fieldNames())
        touched = self._buckets(rows, m)
        return self._publish(replace_by_key(self.read(m["version"], touched), rows, m["keys"]), touched, m)

    def clear(self) -> None:
        m = self.manifest()
        self._swap(m | {"version": m["version"] + 1, "folders": {}})

    def vacuum(self, keep: int = 2) -> None:
        """Remove what the last ``keep`` versions don't refer to, failed runs' folders among it; not while others publish."""
        kept = self.versions()[-keep:]
        used = {folder for v in kept for folder in self.manifest(v)["folders"].values()}
        for v in self.versions()[:-keep]:
            remove_folder(self.spark, f"{self.path}/manifest/{v:012d}.json")
        for folder in list_folder(self.spark, f"{self.path}/data"):
            if folder not in used:
                remove_folder(self.spark, f"{self.path}/data/{folder}")

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64(*m["keys"]), F.lit(m["buckets"])).cast("int")

    def _buckets(self, rows: DataFrame, m: dict) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket(m).alias("b")).distinct().collect())  # at most the number of buckets

    def _publish(self, rows: DataFrame, changed: list[int], m: dict) -> int:
        if changed:
            folder = uuid.uuid4().hex
            rows.withColumn(_BUCKET, self._bucket(m)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{folder}")
            self._swap(m | {"version": m["version"] + 1, "folders": m["folders"] | {str(b): folder for b in changed}})
        return len(changed)

    def _swap(self, m: dict) -> None:
        """Make a version the table's; an error if another run has published that version meanwhile."""
        write_once(self.spark, f"{self.path}/manifest/{m['version']:012d}.json", json.dumps(m))
