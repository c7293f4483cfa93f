"""As-of join: for each row the latest row of another table before it.

Both tables are one sorted sequence per key, cut into buckets of time. Within a bucket the last value is carried forward by a
window; between buckets by another over one row a bucket. So a key that holds a third of all rows is sorted by as many tasks
as it has buckets, and no row meets more than its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, history: DataFrame, keys: list[str], time: str, values: list[str], ties: str, bucket_seconds: int = 86_400, strict: bool = False) -> DataFrame:
    """`rows` with `values` of the latest history row of the same keys at or before their time, or before it if `strict`; null
    where there is none. Of history rows at one time the one with the largest `ties` counts; a null time or key matches
    nothing. `time` is a timestamp in both; the columns `values` must not be columns of `rows`.
    """
    clash = [c for c in values if c in rows.columns]
    if clash:
        raise ValueError(f"{clash} are columns of the rows")
    struct = F.struct(*(F.col(v).alias(v) for v in values))
    at = F.unix_micros(F.col(time).cast("timestamp"))
    a = rows.select(F.struct(*rows.columns).alias("_row"), *keys, at.alias("_t"), F.lit(0 if strict else 1).alias("_side"))
    b = history.select(*keys, at.alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.col(ties).alias("_tie"), struct.alias("_value"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    b = b.filter(known & F.col("_t").isNotNull())
    all_ = a.withColumn("_tie", F.lit(None).cast(b.schema["_tie"].dataType)).withColumn("_value", F.lit(None).cast(b.schema["_value"].dataType))
    all_ = all_.unionByName(b.withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType))).withColumn("_b", F.floor(F.col("_t") / (bucket_seconds * 1_000_000)))
    here = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = all_.withColumn("_here", F.last("_value", ignorenulls=True).over(here))
    lasts = b.withColumn("_b", F.floor(F.col("_t") / (bucket_seconds * 1_000_000))).groupBy(*keys, "_b").agg(F.max_by("_value", F.struct("_t", "_tie")).alias("_last"))
    spots = all_.filter("_row IS NOT NULL AND _t IS NOT NULL").select(*keys, "_b").distinct().withColumn("_last", F.lit(None).cast(b.schema["_value"].dataType))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.unionByName(spots).groupBy(*keys, "_b").agg(F.first("_last", ignorenulls=True).alias("_last")).withColumn("_before", F.last("_last", ignorenulls=True).over(before))
    mine = within.filter("_row IS NOT NULL").drop("_last").join(carried.select(*keys, "_b", "_before"), [*keys, "_b"], "left")
    found: Column = F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_before"))
    return mine.select("_row.*", *(found[v].alias(v) for v in values))
