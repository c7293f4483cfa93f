"""A stream of records merged into a table of plain files: each batch once, touched buckets only, one pointer to what holds.

The table is dealt to buckets by key. A batch reads the buckets that its keys touch, merges, and writes these anew into a
folder of its own; then a pointer file says, bucket by bucket, where the current rows lie, and which batch was the last.
The pointer's name is its version, and it comes to be by a rename that fails where the name exists: readers see one version
or the next, never a mixture, and of two writers one fails. A batch that is played again finds its number and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Table:
    """A bucketed table under `path`, which driver and executors share. `schema` and `key` are those of its rows."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._p = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._p("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The current version; 0 before the first batch."""
        folder = self._p("pointers")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def pointer(self, version: int | None = None) -> dict:
        """Where each bucket lies (`places`), and the last batch of each stream (`batches`)."""
        version = self.version() if version is None else version
        if not version:
            return {"places": {}, "batches": {}}
        stream = self._fs.open(self._p(f"pointers/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, the current one if none is named, in some buckets or in all."""
        places = self.pointer(version)["places"]
        paths = sorted(f"{self.path}/{p}" for b, p in places.items() if only is None or int(b) in only)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, merge: Merge, batch: int, stream: str = "") -> int | None:
        """Merges a batch and returns the new version; None where the batch, or a later one, is already in. `merge` takes the
        stored rows of the touched buckets and the batch, and returns what those buckets hold from now on, in whatever order
        of columns; rows whose key is null have a bucket like others."""
        version = self.version()
        pointer = self.pointer(version)
        if pointer["batches"].get(stream, -1) >= batch:
            return None
        touched = sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # numbers of buckets
        folder = f"data/{version + 1}-{uuid.uuid4().hex}"
        if touched:
            names = [f.name for f in self.schema.fields]
            merged = merge(self.read(version, touched), rows).select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields))
            b = "_bucket"
            while b in names:
                b += "_"
            merged.withColumn(b, self.bucket()).repartition(len(touched), b).write.partitionBy(b).parquet(f"{self.path}/{folder}")
            written = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._p(folder)) if "=" in s.getPath().getName()}
            if written - set(touched):
                raise ValueError("a merge changed keys of other buckets")
            pointer["places"] = {k: p for k, p in pointer["places"].items() if int(k) not in touched} | {str(k): f"{folder}/{b}={k}" for k in written}
        pointer["batches"][stream] = batch
        self._commit(version + 1, json.dumps(pointer, sort_keys=True))
        return version + 1

    def _commit(self, version: int, text: str) -> None:
        own = self._p(f"pointers/.{uuid.uuid4().hex}")
        out = self._fs.create(own)
        out.write(bytearray(text.encode()))
        out.close()
        last = self._p(f"pointers/{version}")
        if self._fs.exists(last) or not self._fs.rename(own, last):
            self._fs.delete(own, False)
            raise RuntimeError(f"version {version} was committed by another writer")


def upserted(stream: DataFrame, table: Table, merge: Merge, checkpoint: str, name: str = "") -> None:
    """All that a stream holds now, merged batch by batch. After a failure the stream plays its last batch again, which then
    counts once: its number is part of the commit. `name` tells apart streams into one table."""

    def each(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            table.upsert(rows, merge, batch, name)
        finally:
            rows.unpersist()

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
