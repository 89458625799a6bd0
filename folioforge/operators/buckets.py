"""A keyed table in a shared folder, parted by a hash of its keys, of which an upsert rewrites only the buckets that it touches.

Each bucket is a folder of Parquet files of the version that last wrote it; a manifest says which folder is whose. An upsert
writes the touched buckets beside the old ones and then puts the next manifest in place, whole or not at all: a reader sees the
table before or after, and an upsert that was broken off is as if it had not begun. The manifest also holds the last batch of each
source, so that a batch that comes again changes nothing. Folders of buckets that two manifests no longer name are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .catalog import latest
from .tables import Files

BUCKETS = 16


class BucketTable:
    """keys: the columns by which rows replace one another; null keys are equal."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), list(keys), buckets
        self.files = Files(spark, self.folder)

    def manifest(self) -> dict | None:
        """The newest one: version, schema, buckets (their number), folders by bucket and the last batch of each source."""
        names = self.files.names("manifest-*.json")
        return json.loads(self.files.read(names[-1])) if names else None

    def read(self, only: Sequence[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None if nothing was ever written."""
        held = self.manifest()
        if held is None:
            return None
        schema = StructType.fromJson(held["schema"])
        paths = [f"{self.folder}/{p}" for b, p in held["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame, order: Sequence[Column] = (), source: str | None = None, batch: int | None = None, keep: str = "new") -> bool:
        """New rows replace old ones of equal keys; with `order`, of all rows of a key the first in that order stays, new before old if
        equal; keep="old" only adds keys. False if the source's batch was done before."""
        held = self.manifest() or {"version": -1, "schema": json.loads(rows.schema.json()), "buckets": self.buckets, "folders": {}, "batches": {}}
        if source is not None and held["batches"].get(source, -1) >= batch:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(held["buckets"])).cast("int")
        # the batch is read twice: for its buckets, and for its rows
        touched = sorted(r.b for r in rows.select(bucket.alias("b")).distinct().collect())
        version = held["version"] + 1
        if touched:
            old, new = self.read(touched), rows.withColumn("__new", F.lit(1))
            both = new if old is None else new.unionByName(old.withColumn("__new", F.lit(0)))
            first = F.desc("__new") if keep == "new" else F.asc("__new")
            kept = latest(both, self.keys, [*order, first]).drop("__new")
            kept.withColumn("__bucket", bucket).write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.folder}/data/version={version}")
        folders = held["folders"] | {str(b): f"data/version={version}/__bucket={b}" for b in touched}
        batches = held["batches"] | ({source: batch} if source is not None else {})
        told = {"version": version, "schema": held["schema"], "buckets": held["buckets"], "folders": folders, "batches": batches}
        self.files.publish(f"manifest-{version:012d}.json", json.dumps(told))
        self._clear(held, folders)
        return True

    def _clear(self, before: dict, folders: dict[str, str]) -> None:
        """Deletes what neither this manifest nor the one before names, and manifests older than those."""
        named = {*before["folders"].values(), *folders.values()}
        for name in self.files.names("data/version=*/__bucket=*"):
            if name not in named:
                self.files.delete(name)
        for name in self.files.names("manifest-*.json")[:-2]:
            self.files.delete(name)
