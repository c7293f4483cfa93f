"""Sharding by extendible hashing: a directory over hash prefixes in which only oversized buckets split.

A row's 60-bit hash is read from the top. Bytes are first summed per prefix of `grain` bits (a partial aggregate, so a
hot key costs nothing more); the directory is then built on those sums: starting from one bucket, every bucket above
the byte limit splits on its next bit, the others keep their depth. Buckets still above the limit at `grain` bits go on
with sums over longer prefixes, of their own rows only. What no further bit can divide, rows with the same hash and a
single row above the limit, becomes a chain of overflow shards filled in order of a second hash.

DataFrame functions only. The directory has a row per split of the data and is joined by prefix, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, staged

HASH_BITS, GRAIN = 60, 12


def prefix(hashed: Column | str, bits: int) -> Column:
    """The first `bits` of a 60-bit hash."""
    return F.shiftright(hashed, HASH_BITS - bits)


def _settle(sums: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of (p, bytes), prefixes of `high` bits below buckets of `low` bits that are too large: (p, depth) settled, and the rest.

    A prefix's depth is the smallest at which its bucket fits. Each level is one more sum over the same few rows.
    """
    out = sums
    for d in range(low + 1, high):
        at = F.shiftright("p", high - d)
        out = out.withColumn(f"b{d}", F.sum("bytes").over(Window.partitionBy(at)))
    fits = [F.when(F.col(f"b{d}") <= limit, d) for d in range(low + 1, high)] + [F.when(F.col("bytes") <= limit, high)]
    out = staged(out.select("p", "bytes", F.coalesce(*fits).alias("depth")), "levels")
    return out.filter("depth IS NOT NULL").select("p", "depth"), out.filter("depth IS NULL").select("p")


def directory(rows: DataFrame, limit: int, grain: int = GRAIN) -> list[tuple[int, DataFrame]]:
    """[(bits, (p, depth))]: for prefixes of so many bits, the depth of the bucket they lie in; together they cover all
    rows but those that even 60 bits leave in an oversized bucket. `rows`: h, bytes."""
    found, low, bits = [], -1, grain
    while True:
        sums = rows.groupBy(prefix("h", bits).alias("p")).agg(F.sum("bytes").alias("bytes"))
        settled, rest = _settle(sums, low, bits, limit)
        found.append((bits, settled))
        if bits == HASH_BITS or rest.isEmpty():
            return found
        rows = rows.withColumn("_p", prefix("h", bits)).join(rest.withColumnRenamed("p", "_p"), "_p", "left_semi").drop("_p")
        low, bits = bits, min(HASH_BITS, bits + grain)


def placed(rows: DataFrame, limit: int, grain: int = GRAIN) -> DataFrame:
    """`rows` (h, bytes and any others, staged) with prefix, depth and overflow as further columns."""
    columns = rows.columns
    left, parts = rows, []
    for bits, settled in directory(rows.select("h", "bytes"), limit, grain):
        here = left.withColumn("p", prefix("h", bits)).join(settled, "p", "left").drop("p")
        parts.append(here.filter("depth IS NOT NULL").select(*columns, "depth", F.lit(0).cast("long").alias("overflow")))
        left = here.filter("depth IS NULL").drop("depth")
    parts.append(_overflow(left, limit))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    bucket = F.call_function("shiftright", F.col("h"), (F.lit(HASH_BITS) - F.col("depth")).cast("int"))
    return out.select(*columns, bucket.alias("prefix"), F.col("depth").cast("int").alias("depth"), "overflow")


def _hashed(key: str, text: str) -> list[Column]:
    return [F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.shiftrightunsigned(F.xxhash64(key), 64 - HASH_BITS).alias("h")]


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text", grain: int = GRAIN) -> DataFrame:
    """(key, n_bytes, prefix, depth, overflow) per row: a shard is a (prefix, depth, overflow); each holds at most `limit`
    bytes unless a single row is larger.

    A null key is hashed as a value, a null text has 0 bytes; rows with equal keys share a hash, and where they exceed
    the limit they fill numbered overflow shards. An empty table has no shards.
    """
    rows = staged(docs.select(F.col(key).alias("k"), *_hashed(key, text)), "keys")
    return placed(rows, limit, grain).select(F.col("k").alias(key), F.col("bytes").alias("n_bytes"), "prefix", "depth", "overflow")


#: Limits' worth of rows that a slot of an overflowing hash holds.
SLOT_LIMITS = 16


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash in numbered shards. A hash has a slot for every SLOT_LIMITS limits of its bytes; rows are dealt to
    its slots one by one, and each slot fills shards of its own, so that no task holds all rows of a hot key; a shard is
    closed before it would pass the limit."""
    columns = rows.columns
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "overflow")
    slots = rows.groupBy("h").agg(F.ceil(F.sum("bytes") / (SLOT_LIMITS * limit)).alias("slots"))
    dealt = rows.join(slots, "h").withColumn("slot", F.pmod(F.xxhash64("row"), F.greatest("slots", F.lit(1))))
    w = Window.partitionBy("h", "slot").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A row begins in the half-limit step its running sum has reached: two neighbouring steps never share a shard, and a
    # shard's rows sum to at most a step plus one row of at most a step; larger rows stand alone.
    step = max(1, limit // 2)
    small = dealt.filter(F.col("bytes") <= step).withColumn("at", F.floor((F.sum("bytes").over(w) - F.col("bytes")) / step))
    alone = dealt.filter(F.col("bytes") > step).withColumn("at", F.lit(None).cast("long"))
    name = F.when(F.col("at").isNull(), -1 - F.col("row")).otherwise(1 + F.col("slot") + F.col("at") * F.col("slots"))
    return small.unionByName(alone).select(*columns, F.lit(HASH_BITS).alias("depth"), name.cast("long").alias("overflow"))


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text", grain: int = GRAIN) -> None:
    """The rows under one folder a shard, for trainers that read whole shards; a shard's texts hold at most `limit` bytes.

    Each row goes to its own shard, also where keys are null or repeat and fill overflow shards. Null texts have 0 bytes.
    The folders' column is named shard, with underscores added where `docs` has that name. An empty table writes no shard.
    """
    shard, row = free_name(docs, "shard"), free_name(docs, "_row")
    whole = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    marks = placed(staged(whole.select(F.col(row).alias("_id"), *_hashed(key, text)), "keys"), limit, grain)
    bits = F.lpad(F.conv("prefix", 10, 2), F.greatest("depth", F.lit(1)), "0")
    name = F.concat_ws("-", F.concat(F.lit("s"), bits), "depth", "overflow")  # the letter keeps readers from taking it for a date
    whole.join(marks.select("_id", name.alias(shard)), F.col(row) == F.col("_id")).drop(row, "_id").repartition(shard).write.partitionBy(shard).parquet(path)
