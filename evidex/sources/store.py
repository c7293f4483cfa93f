"""Sources and sinks: change-detecting upserts, content-addressed raw objects, snapshot files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def crawl_upsert(stored: DataFrame, fetched: DataFrame, key: list[str], min_chars: int = 200) -> DataFrame:
    """Stored and fetched pages merged by key: new pages start at version 1, a changed hash adds one and keeps the old
    hash, an unchanged page is confirmed, a page under `min_chars` is skipped. `stored`: key, hash, version; `fetched`:
    key, hash, n_chars. Plain files have no MERGE, so the merged table is written anew."""
    old = stored.select(*key, F.col("hash").alias("_old"), F.col("version").alias("_version"))
    both = old.join(fetched, key, "full_outer")
    short = F.col("n_chars") < min_chars
    action = F.when(F.col("hash").isNull(), "absent").when(short, "skipped").when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("hash"), "changed").otherwise("confirmed")
    out = both.withColumn("action", action)
    changed = F.col("action") == "changed"
    return out.select(
        *key,
        F.when(F.col("action").isin("new", "changed"), F.col("hash")).otherwise(F.col("_old")).alias("hash"),
        F.when(changed, F.col("_old")).alias("previous_hash"),
        (F.coalesce("_version", F.lit(0)) + F.when(F.col("action").isin("new", "changed"), 1).otherwise(0)).cast("long").alias("version"),
        "action",
    )


def catalogue_upsert(stored: DataFrame, declared: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action, fields): declared entries inserted, updated where a field differs, or the same; stored ones that are no
    longer declared are absent and keep their fields."""
    old = stored.select(key, *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_old"))
    both = old.join(declared.select(key, *fields, F.lit(True).alias("_new")), key, "full_outer")
    differ = F.lit(False)
    for c in fields:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "absent").when(differ, "update").otherwise("same")
    return both.select(key, action.alias("action"), *(F.when(F.col("_new").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields))


def catalogue_sync(stored: DataFrame, declared: DataFrame, key: str, fields: list[str], default_class: Column) -> DataFrame:
    """(key, action, fields, source_class, status, mirror_of, class_changed): the catalogue after its declaration is read.

    `stored` and `declared`: key, fields, source_class, mirror_of (a key), and `stored` its status. A declared entry is
    inserted as ACTIVE or takes the declared fields, a candidate becomes ACTIVE, any other status stays. Without a declared
    class `default_class` counts, over the declared columns. Mirrors are resolved in a second pass, when every key exists: an
    unknown primary, or the entry itself, is none. Entries no longer declared stay as they are. `class_changed` tells the
    entries that existed and whose class is another now: the provenance of their items is due.
    """
    columns = [*fields, "source_class", "mirror_of"]
    old = stored.select(key, *(F.col(c).alias(f"_{c}") for c in [*columns, "status"]), F.lit(True).alias("_old"))
    new = declared.withColumn("source_class", F.coalesce(F.when(F.col("source_class") != "", F.col("source_class")), default_class)).select(key, *columns, F.lit(True).alias("_new"))
    both = old.join(new, key, "full_outer")
    gone, fresh = F.col("_new").isNull(), F.col("_old").isNull()
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = F.when(fresh, "insert").when(gone, "absent").when(differ | (F.col("_status") == "CANDIDATE"), "update").otherwise("same")
    status = F.when(fresh | (~gone & (F.col("_status") == "CANDIDATE")), "ACTIVE").otherwise(F.col("_status"))
    kept = {c: F.when(gone, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    changed = ~fresh & ~gone & ~F.col("source_class").eqNullSafe(F.col("_source_class"))
    rows = both.select(key, action.alias("action"), *(v.alias(c) for c, v in kept.items()), status.alias("status"), changed.alias("class_changed"), gone.alias("_gone"))
    keys = both.select(F.col(key).alias("_primary"))
    known = rows.join(keys, (F.col("mirror_of") == F.col("_primary")) & (F.col("mirror_of") != F.col(key)), "left")
    return known.select(key, "action", *fields, "source_class", "status", F.when(F.col("_gone"), F.col("mirror_of")).otherwise(F.col("_primary")).alias("mirror_of"), "class_changed")


def to_embed(vectors: DataFrame, id: str, outdated: Column) -> DataFrame:
    """The ids whose vector is missing or of another model."""
    return vectors.filter(outdated).select(id)


def raw_key(body: Column, domain: Column, extension: str) -> Column:
    """The content address of a raw object."""
    digest = F.sha2(body, 256)
    return F.concat_ws("/", domain, F.substring(digest, 1, 2), F.concat(digest, F.lit(f".{extension}")))


def write_raw(objects: DataFrame, path: str) -> None:
    """New raw objects appended by prefix; `objects`: key, domain, prefix, body. One row per key is written, once."""
    spark = objects.sparkSession
    new = objects.dropDuplicates(["key"])
    try:
        new = new.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").partitionBy("domain", "prefix").parquet(path)


def write_jsonl(records: DataFrame, path: str, id: str) -> None:
    """Records as JSON lines, sorted by id over all files, with nulls written out and keys in order of their names."""
    line = F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"})
    records.select(id, line.alias("value")).orderBy(id).select("value").write.text(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines by an explicit schema, so that an empty file has its types; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
