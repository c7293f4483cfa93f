import random

from evidex.operators import graph, quality, retrieval, snapshot
from evidex.sources import store
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_mirrors_take_the_first_signal_and_skip_the_same_source(spark):
    rows = [(1, "s1", "h1", "f1"), (2, "s2", "h1", "f1"), (3, "s1", "h1", "f9"), (4, "s3", "h4", "f1"), (5, "s4", None, None), (6, "s4", "h6", None)]
    docs = spark.createDataFrame(rows, "id int, source string, content string, loose string")
    got = {tuple(r) for r in quality.mirrors(docs, "id", "source", ["content", "loose"]).collect()}
    assert got == {(1, 2, "content"), (2, 1, "content"), (4, 1, "loose")}


def test_independent_sources(spark):
    rows = [("i", "said", "a", 1), ("i", "said", "b", 2), ("i", "other", "b", 3), ("j", "x", "a", 4)]
    ev = spark.createDataFrame(rows, "item string, excerpt string, source string, at int")
    assert {tuple(r) for r in quality.independent_sources(ev, "item", "excerpt", "source", "at").collect()} == {("i", 2), ("j", 1)}


def test_score_is_the_sum_of_its_factors(spark):
    c = [F.lit(90.0), F.lit(True), F.lit(2), F.lit(0.9), F.lit(True), F.lit(None).cast("boolean"), F.lit(0.7), F.lit(False), F.lit(True)]
    total, factors = quality.score(*c)
    row = spark.range(1).select(total.alias("s"), factors.alias("f")).first()
    assert abs(row.s - sum(row.f[k] * w for k, w in quality.WEIGHTS.items())) < 1e-4 and abs(sum(quality.WEIGHTS.values()) - 1) < 1e-9


def test_levels_and_steps(spark):
    rows = [(False, 0, 0.0, False), (False, 1, 50.0, False), (False, 1, 80.0, False), (False, 2, 10.0, False), (False, 1, 10.0, True), (True, 0, 0.0, False)]
    df = spark.createDataFrame(rows, "a boolean, s int, u double, v boolean")
    lv = quality.level(F.col("a"), F.col("s"), F.col("u"), F.col("v"))
    assert [r[0] for r in df.select(lv).collect()] == [0, 1, 2, 3, 4, 5]
    steps = spark.range(1).select(quality.steps_to(F.lit("EXTRACTED"), F.lit("SUPPORTED")).alias("a"), quality.steps_to(F.lit("VERIFIED"), F.lit("SUPPORTED")).alias("b"), quality.steps_to(F.lit("STALE"), F.lit("VERIFIED")).alias("c")).first()
    assert [tuple(s) for s in steps.a] == [("EXTRACTED", "CANDIDATE"), ("CANDIDATE", "SUPPORTED")] and steps.b == steps.c == []


def test_freshness_steps(spark):
    now = F.lit("2024-06-01").cast("timestamp")
    days = [0, 29, 30, 89, 90, 179, 180, 900]
    df = spark.createDataFrame([(d,) for d in days], "d int").select(quality.freshness(now - F.make_dt_interval("d"), F.lit(False), now))
    assert [r[0] for r in df.collect()] == [1.0, 1.0, 0.7, 0.7, 0.4, 0.4, 0.2, 0.2]


def test_closure_on_cycles_and_diamonds(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d"), ("z", "y")], "src string, dst string")
    got = {(r.node, r.hops, r.parent) for r in graph.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b")}


def test_chain_roots(spark):
    rng = random.Random(1)
    parent = {i: rng.randrange(i) for i in range(1, 200)}
    links = spark.createDataFrame(list(parent.items()), "node long, parent long")

    def root(i):
        while i in parent:
            i = parent[i]
        return i

    assert {r.node: r.root for r in graph.chain_roots(links).collect()} == {i: root(i) for i in parent}


def test_rrf_and_fusion(spark):
    df = spark.createDataFrame([(1, 2), (None, 3), (None, None)], "v int, l int")
    got = df.select(retrieval.rrf(F.col("v"), F.col("l")), retrieval.vector_primary(F.col("v"), F.col("l"), F.lit(None))).collect()
    assert [round(r[0], 9) for r in got] == [round(1 / 61 + 1 / 62, 9), round(1 / 63, 9), 0.0]
    assert [round(r[1], 9) for r in got] == [round(0.6 / 16, 9), round(0.15 / 18, 9), 0.0]


def test_diversified_caps_subjects_and_fills_up(spark):
    rows = [("q", i, i, "s" if i <= 5 else "t", [f"w{i}"]) for i in range(1, 8)]
    ranked = spark.createDataFrame(rows, "query string, id int, rank int, subject string, words array<string>")
    got = sorted(retrieval.diversified(ranked, k=6).collect(), key=lambda r: r.place)
    assert [r.id for r in got] == [1, 2, 3, 6, 7, 4]


def test_apply_of_a_diff_gives_the_head(spark):
    rng = random.Random(2)
    base = [(i, rng.randrange(3), "n") for i in range(200) if rng.random() < 0.8]
    head = [(i, rng.randrange(3), rng.choice("nm")) for i in range(220) if rng.random() < 0.8]
    a, b = (spark.createDataFrame(x, "id long, v int, note string") for x in (base, head))
    change = snapshot.diff(a, b, "id", ["v"], ["note"])
    made = snapshot.apply_delta(a, b.join(change.filter("change <> 'removed'").select("id"), "id", "left_semi"), change.filter("change = 'removed'"), "id")
    assert sorted(map(tuple, made.collect())) == sorted(head)
    digest = lambda df: snapshot.integrity(df.select("id", F.lit("f").alias("file"), snapshot.record_hash(["id", "v", "note"]).alias("h")), "file", "id", "h").first().digest
    assert digest(made) == digest(b.repartition(7)) != digest(a)


def test_crawl_upsert(spark):
    stored = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 3), ("c", "h3", 1), ("e", "h5", 1)], "url string, hash string, version int")
    fetched = spark.createDataFrame([("a", "h1", 500), ("b", "new", 500), ("d", "h4", 500), ("e", "h6", 10)], "url string, hash string, n_chars int")
    got = {r.url: (r.action, r.hash, r.previous_hash, r.version) for r in store.crawl_upsert(stored, fetched, ["url"]).collect()}
    assert got == {"a": ("confirmed", "h1", None, 1), "b": ("changed", "new", "h2", 4), "c": ("absent", "h3", None, 1), "d": ("new", "h4", None, 1), "e": ("skipped", "h5", None, 1)}


def test_raw_store_writes_each_object_once(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "t string").select(store.raw_key(F.col("t"), F.lit("web"), "html").alias("key"), F.lit("web").alias("domain"), F.substring(F.sha2("t", 256), 1, 2).alias("prefix"), F.col("t").alias("body"))
    path = str(tmp_path / "raw")
    store.write_raw(rows, path)
    store.write_raw(rows, path)
    assert sorted(r.body for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_jsonl_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("note", T.StringType())])
    rows = [(2, ["é"], None), (1, [], "x")]
    df = spark.createDataFrame(rows, schema)
    store.write_jsonl(df, str(tmp_path / "j"), "id")
    assert sorted(map(tuple, store.read_jsonl(spark, str(tmp_path / "j"), schema).collect())) == sorted(rows)
    store.write_jsonl(df.limit(0), str(tmp_path / "none"), "id")
    assert store.read_jsonl(spark, str(tmp_path / "none"), schema).schema == schema
