import random

from evidex.llm import queries
from evidex.llm import toxicity as T


def test_features_of_odd_texts():
    for t in ("", " ", "a", "You IDIOT!! " * 5000, "m0r0n you", "\x00 é 日本"):
        x = T.features(t, {"idiot": 3.0, "moron": 2.0})
        assert len(x) == len(T.NAMES) and all(v == v and v >= 0 for v in x)
    shown = dict(zip(T.NAMES, T.features("you m0r0n, idiot clowny here", {"idiot": 3.0, "moron": 2.0, "clow~": 1.0})))
    assert shown["kinds"] == 3 and shown["hidden"] == 0.2 and shown["beginnings"] == 0.2 and shown["near_second"] == 1 and shown["best"] == 3


def test_held_out_accuracy(spark):
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for p, t in held if not t) <= 0.03 * sum(not t for _, t in held)
    assert sum(p for p, t in held if t) >= 0.6 * sum(t for _, t in held)


def test_few_or_no_labels_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, 0.5, 1), (2, "", 0.5, 1), (None, "x", 0.5, 1), (3, "y", 0.5, 1), (3, "y", 0.5, 1)], "doc_id long, text string, score double, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.p for r in T.fit(docs, none).scored(docs, "text", "p").collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    model = T.fit(docs, one)
    assert {r.p for r in model.scored(docs, "text", "p").collect()} == {1.0}
    assert T.not_toxic(docs, model).count() == 0 and T.not_toxic(docs, T.fit(docs, none)).columns == docs.columns
    assert T.fit(docs, none).scored(docs.limit(0), "text", "p").collect() == []


def test_repeated_rows_keep_their_score(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=30) + ["vile"] * (i % 3 == 0))) for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("*", "1 AS _tox_raw", "2 AS x")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    scored = T.fit(docs, labels).scored(docs, "text", "p").collect()
    assert len(scored) == 303 and all((r.p >= 0.7) == (r.doc_id % 3 == 0) for r in scored)


def test_repeated_labels_count_once_and_scores_follow_the_whole_curve(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = random.Random(4)
    words = [f"w{i}" for i in range(80)] + ["vile", "awful"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=25) + ["vile"] * rng.randrange(1 + 2 * (i % 2)))) for i in range(400)], "doc_id long, text string")
    given = [(i, i % 2) for i in range(400)]
    once, twice = (T.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (given, given * 3 + [(1, 0), (3, 0)]))
    a, b = ({r.doc_id: r.p for r in m.scored(docs, "text", "p").collect()} for m in (once, twice))
    assert a == b and len(set(a.values())) > 2
    x = once.trees.setFeaturesCol("v").transform(once.described(docs, "text", "x").withColumn("v", array_to_vector("x")))
    margins = {r.doc_id: r.m for r in x.select("doc_id", vector_to_array(once.trees.getRawPredictionCol())[1].alias("m")).collect()}
    xs, ys = once.curve.boundaries.toArray(), once.curve.predictions.toArray()
    assert all(abs(a[i] - np.interp(m, xs, ys)) < 1e-9 for i, m in margins.items())
