from collections import defaultdict

from evidex.llm import sharding as S
from pyspark.sql import functions as F


def shards(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.prefix, r.depth, r.overflow].append(r)
    return out


def brute(rows, limit, prefix=0, depth=0):
    """Buckets of (hash, bytes) by splitting one bucket at a time."""
    if sum(b for _, b in rows) <= limit or depth == 60:
        return {(prefix, depth): rows} if rows else {}
    out = {}
    for bit in (0, 1):
        part = [(h, b) for h, b in rows if h >> (59 - depth) & 1 == bit]
        out |= brute(part, limit, 2 * prefix + bit, depth + 1)
    return out


def test_splits_only_oversized_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hashes = docs.selectExpr("doc_id", "xxhash64(doc_id) AS x", "octet_length(text) AS n").collect()
    rows = [((r.x & (2**64 - 1)) >> 4, r.n) for r in hashes]
    for limit in (10**9, 100_000, 20_000):
        want = {k: sum(b for _, b in v) for k, v in brute(rows, limit).items()}
        for grain in (3, 12):
            got = S.assign(docs, limit, grain=grain).collect()
            assert len(got) == len(rows)
            normal = {k[:2]: sum(r.n_bytes for r in v) for k, v in shards(got).items() if not k[2]}
            assert normal == {k: v for k, v in want.items() if v <= limit}


def test_hot_key_oversized_row_and_nulls(spark):
    rows = [(1, "x" * 100)] * 50 + [(2, "y" * 5000), (None, None), (3, ""), (None, "z" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS bytes", "3 AS prefix")
    got = S.assign(docs, 1000).collect()
    assert len(got) == len(rows)
    for part in shards(got).values():
        assert sum(r.n_bytes for r in part) <= 1000 or len(part) == 1
    assert S.assign(docs.limit(0), 1000).collect() == []


def test_native(spark, sf):
    plan = S.assign(spark.read.parquet(f"{sf}/documents.parquet"), 10_000)._jdf.queryExecution().toString()
    assert not [w for w in ("Python", "Arrow", "Pandas") if w in plan]


def test_write(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    S.write_shards(docs, str(tmp_path / "out"), 50_000)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == docs.count() and again.select("shard").distinct().count() > 5


def test_written_shards_keep_the_limit(spark, tmp_path):
    rows = [(1, "x" * 400)] * 30 + [(None, "n" * 300)] * 12 + [(2, "y" * 5000), (3, None), (4, "é" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS shard", "2 AS _row", "3 AS bytes", "4 AS h")
    S.write_shards(docs, str(tmp_path / "out"), 1000)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    for r in got.groupBy("shard_").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.count("*").alias("rows")).collect():
        assert r.n <= 1000 or r.rows == 1, r
    S.write_shards(docs.limit(0), str(tmp_path / "none"), 1000)


def test_a_hot_key_takes_slots_by_its_bytes(spark):
    docs = spark.range(2000).selectExpr("7 AS doc_id", "repeat('x', 100) AS text")
    got = S.assign(docs, 1000).collect()
    assert len(got) == 2000 and all(sum(r.n_bytes for r in part) <= 1000 for part in shards(got).values())
    assert len(shards(got)) <= 2000 * 100 / 500 + 14


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "x" * 5_000_000), (2, "y")], "doc_id long, text string")
    assert sorted(r.n_bytes for r in S.assign(docs, 1000).collect()) == [1, 5_000_000]
