"""Snapshots: record hashes, differences, deltas and their application, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns as text in the given order; null is told apart from empty."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def diff(base: DataFrame, head: DataFrame, id: str, stable: list[str], volatile: list[str]) -> DataFrame:
    """(id, change, changed_fields): added, removed, modified (a stable field differs) or refreshed (only others do)."""
    a = base.select(id, F.struct(*stable, *volatile).alias("a"))
    b = head.select(id, F.struct(*stable, *volatile).alias("b"))
    both = a.join(b, id, "full_outer")
    fields = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in sorted(stable + volatile))))
    changed = F.arrays_overlap(fields, F.array(*map(F.lit, stable)))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(changed, "modified").when(F.size(fields) > 0, "refreshed")
    return both.select(id, kind.alias("change"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_join(fields, ",")).otherwise("").alias("changed_fields")).filter("change IS NOT NULL")


def apply_delta(base: DataFrame, upserts: DataFrame, removed: DataFrame, id: str) -> DataFrame:
    """(base - removed) with the delta's records in place of their older versions."""
    gone = removed.select(id).union(upserts.select(id)).distinct()
    return base.join(gone, id, "left_anti").unionByName(upserts)


#: Buckets of a file's digest at least, and records a bucket holds on average at most.
BUCKETS, BUCKET_RECORDS = 256, 50_000


def integrity(records: DataFrame, file: str, id: str, hashed: str) -> DataFrame:
    """(file, n, digest): a digest per file that no order or partitioning changes: sorted record hashes per bucket of
    numeric ids, then over buckets. Buckets double until they hold BUCKET_RECORDS on average, so no task holds more than a
    bounded part of a file; the digest of the same records is the same, as their number gives the buckets."""
    buckets = BUCKETS
    for n in [r.n for r in records.groupBy(file).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).collect()]:
        while n and n > buckets * BUCKET_RECORDS:
            buckets *= 2
    part = F.pmod(F.col(id), F.lit(buckets))
    inner = records.groupBy(file, part.alias("_b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(hashed)), "\n"), 256).alias("_h"))
    return inner.groupBy(file).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "\n"), 256).alias("digest"))
