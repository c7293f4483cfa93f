"""The data source of digested files: round trip, failed tasks, damaged files, overwriting; and the catalogue's sync."""

import datetime
import decimal
import glob
import os

import pytest
from evidex.sources import digested, store
from pyspark.sql import Row
from pyspark.sql import functions as F

KIND = "id long, text string, at timestamp, day date, price decimal(10,2), part binary, ok boolean, x double, tags array<string>, inner struct<a:int,b:array<double>>"


@pytest.fixture
def path(spark, tmp_path):
    digested.register(spark)
    return str(tmp_path / "records")


def files(path):
    return sorted(os.path.relpath(f, path) for f in glob.glob(f"{path}/**", recursive=True) + glob.glob(f"{path}/.*") if os.path.isfile(f))


def test_round_trip_of_all_types(spark, path):
    rows = [
        Row(1, 'é "q"\n\\ ', datetime.datetime(2024, 1, 2, 3, 4, 5, 678), datetime.date(2024, 2, 29), decimal.Decimal("1.50"), bytearray(b"\x00\xff"), True, 2.0, ["a", None], Row(a=1, b=[0.5])),
        Row(2, None, None, None, None, None, None, None, None, None),
        Row(3, "", datetime.datetime(1970, 1, 1), None, decimal.Decimal("-0.01"), bytearray(b""), False, float("1e300"), [], Row(a=None, b=None)),
    ]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    df.write.format("digested").mode("overwrite").save(path)
    back = spark.read.format("digested").schema(KIND).load(path)
    assert sorted(back.collect()) == sorted(df.collect())
    listed = digested.manifest(path)
    assert sum(f["rows"] for f in listed["files"].values()) == 3 and files(path) == sorted(["_manifest.json", *(f"data/{n}" for n in listed["files"])])
    df.write.format("digested").mode("append").save(path)
    assert spark.read.format("digested").schema(KIND).load(path).count() == 6
    df.limit(1).write.format("digested").mode("overwrite").save(path)
    assert spark.read.format("digested").schema(KIND).load(path).count() == 1


def test_empty(spark, path):
    spark.createDataFrame([], "a int").write.format("digested").mode("overwrite").save(path)
    assert spark.read.format("digested").schema("a int").load(path).count() == 0 and digested.manifest(path)["files"] == {}


def test_a_failed_task_leaves_nothing(spark, path):
    spark.range(3).write.format("digested").mode("overwrite").save(path)
    before, listed = files(path), digested.manifest(path)
    broken = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        broken.write.format("digested").mode("append").save(path)
    assert files(path) == before and digested.manifest(path) == listed
    assert spark.read.format("digested").schema("id long").load(path).count() == 3


def test_damaged_files_are_found(spark, path):
    spark.range(10).coalesce(1).write.format("digested").mode("overwrite").save(path)
    (name,) = digested.manifest(path)["files"]
    with open(f"{path}/data/{name}", "a") as f:
        f.write('{"id":99}\n')
    with pytest.raises(Exception, match="digest"):
        spark.read.format("digested").schema("id long").load(path).collect()


def test_catalogue_sync(spark):
    kind = "key string, name string, source_class string, mirror_of string"
    stored = spark.createDataFrame([("a", "A", "official", None, "ACTIVE"), ("b", "B", "community", "a", "CANDIDATE"), ("c", "C", None, None, "DISABLED"), ("gone", "G", "official", "nowhere", "CANDIDATE"), ("same", "S", "external", None, "ACTIVE")], kind + ", status string")
    declared = spark.createDataFrame([("a", "A", None, "new"), ("b", "B", "community", "b"), ("c", "C2", "", "gone"), ("new", "N", "official", "unknown"), ("same", "S", "external", None)], kind)
    got = {r.key: tuple(r)[1:] for r in store.catalogue_sync(stored, declared, "key", ["name"], F.lit("external")).collect()}
    assert got == {
        "a": ("update", "A", "external", "ACTIVE", "new", True), "b": ("update", "B", "community", "ACTIVE", None, False), "c": ("update", "C2", "external", "DISABLED", "gone", True),
        "gone": ("absent", "G", "official", "CANDIDATE", "nowhere", False), "new": ("insert", "N", "official", "ACTIVE", None, False), "same": ("same", "S", "external", "ACTIVE", None, False)}
