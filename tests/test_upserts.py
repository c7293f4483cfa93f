"""The streaming upsert: replays, versions, touched buckets, failures, and a stream taken up again."""

import pytest
from evidex.streaming import upserts
from pyspark.sql import functions as F


def latest(stored, rows):
    """Of each key the row with the largest n, stored or new."""
    both = stored.unionByName(rows.select(*stored.columns))
    return both.groupBy("k").agg(F.max_by("v", "n").alias("v"), F.max("n").alias("n"))


@pytest.fixture
def held(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n long, v string").schema
    return upserts.Table(spark, f"file://{tmp_path}/table", schema, ["k"], 8)


def rows(spark, *values):
    return spark.createDataFrame(values, "k string, n long, v string")


def content(held, version=None):
    return sorted(map(tuple, held.read(version).collect()), key=repr)


def test_batches_count_once_and_versions_stay(spark, held):
    assert content(held) == [] and held.version() == 0
    assert held.upsert(rows(spark, ("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")), latest, 0) == 1
    first = content(held)
    assert first == sorted([("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")], key=repr)
    places = held.pointer()["places"]
    assert held.upsert(rows(spark, ("a", 2, "new"), ("c", 1, "w")), latest, 1) == 2
    second = content(held)
    assert ("a", 2, "new") in second and ("b", 1, "y") in second and len(second) == 4
    untouched = {k for k, p in held.pointer()["places"].items() if places.get(k) == p}
    assert untouched and len(untouched) < len(places) + 1
    assert held.upsert(rows(spark, ("a", 9, "again")), latest, 1) is None and held.upsert(rows(spark, ("a", 9, "old")), latest, 0) is None
    assert content(held) == second and content(held, 1) == first
    assert held.upsert(rows(spark, ("a", 9, "other stream")), latest, 0, "other") == 3
    assert held.upsert(rows(spark).limit(0), latest, 2) == 4 and len(content(held)) == 4


def test_a_failed_batch_leaves_the_table(spark, held):
    held.upsert(rows(spark, ("a", 1, "x")), latest, 0)

    def fails(stored, new):
        return latest(stored, new).withColumn("v", F.raise_error(F.lit("broken")))

    with pytest.raises(Exception, match="broken"):
        held.upsert(rows(spark, ("a", 2, "y")), fails, 1)
    with pytest.raises(ValueError, match="other buckets"):
        held.upsert(rows(spark, ("a", 2, "y")), lambda s, n: latest(s, n).withColumn("k", F.explode(F.array(*(F.lit(f"k{i}") for i in range(40))))), 1)
    assert content(held) == [("a", 1, "x")] and held.version() == 1
    assert held.upsert(rows(spark, ("a", 2, "y")), latest, 1) == 2 and content(held) == [("a", 2, "y")]


def test_two_writers(spark, held, monkeypatch):
    """The second to commit a version fails and leaves the first's."""
    other = upserts.Table(spark, held.path, held.schema, ["k"], 8)

    def slow(stored, new):
        other.upsert(rows(spark, ("b", 1, "first")), latest, 0, "other")
        return latest(stored, new)

    with pytest.raises(RuntimeError, match="another writer"):
        held.upsert(rows(spark, ("a", 1, "second")), slow, 0)
    assert content(held) == [("b", 1, "first")]
    assert held.upsert(rows(spark, ("a", 1, "second")), latest, 0) == 2 and len(content(held)) == 2


def test_stream_taken_up_again(spark, held, tmp_path):
    folder = f"file://{tmp_path}/in"
    for n, batch in enumerate([[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")], []]):
        if batch:
            rows(spark, *batch).coalesce(1).write.mode("append").parquet(folder)
        upserts.upserted(spark.readStream.schema(held.schema).parquet(folder), held, latest, f"file://{tmp_path}/checkpoint")
        assert held.version() == min(n, 1) + 1
    assert content(held) == [("a", 2, "z"), ("b", 1, "y")]
