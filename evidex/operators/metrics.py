"""Aggregates over runs and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins between the least and the greatest value.
BINS = 4096


def percentile(rows: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """(key, percentile): exact, linear between neighbouring ranks. Rows are counted per bin of values; only the values in
    the bins that hold the two ranks are counted one by one, so that no task sees all values of a hot key."""
    rows = rows.filter(F.col(value).isNotNull()).select(F.col(key), F.col(value).cast("double").alias("_v"))
    ends = rows.agg(F.min("_v").alias("low"), F.max("_v").alias("high")).first()
    width = ((ends.high - ends.low) if ends.low is not None else 0) / BINS or 1.0
    binned = rows.withColumn("_bin", F.floor((F.col("_v") - F.lit(ends.low or 0.0)) / width))
    counts = binned.groupBy(key, "_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    upto = F.sum("_n").over(w.orderBy("_bin"))
    at = (F.sum("_n").over(w) - 1) * p
    ranks = counts.select(key, "_bin", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), at.alias("_at"))
    held = ranks.filter((F.ceil("_at") >= F.col("_before")) & (F.floor("_at") < F.col("_upto")))
    values = binned.groupBy(key, "_bin", "_v").agg(F.count("*").alias("_n")).join(held, [key, "_bin"])
    below = F.col("_before") + F.sum("_n").over(Window.partitionBy(key, "_bin").orderBy("_v")) - F.col("_n")
    found = values.select(key, "_v", "_n", "_at", below.alias("_below"))

    def has(rank):
        return F.when((rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_n")), F.col("_v"))

    both = found.groupBy(key).agg(F.max(has(F.floor("_at"))).alias("a"), F.max(has(F.ceil("_at"))).alias("b"), F.first("_at").alias("_at"))
    return both.select(key, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("_at") - F.floor("_at"))).alias("percentile"))
