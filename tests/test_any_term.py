"""The first texts by the density of any term: against sums of all, and what a run shuffles."""

import random

import pytest
from evidex.operators import proximity
from evidex.plans import QUERIES
from pyspark.sql import functions as F


@pytest.mark.parametrize("pairs,texts", [(500_000, 256), (6, 3)])
def test_first_of_any_term(spark, monkeypatch, pairs, texts):
    """Ties by id, absent and empty texts, queries of absent words, blocks of few queries, batches of few texts."""
    monkeypatch.setattr(proximity, "PAIRS", pairs)
    monkeypatch.setattr(proximity, "TEXTS", texts)
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 30}"
    made = [(f"d{k:03}", [word() for _ in range(rng.randint(0, 3))] if k % 5 else None, [word() for _ in range(rng.choice([0, 4, 4, 9]))]) for k in range(120)]
    docs = spark.createDataFrame(made, "id string, a array<string>, b array<string>").repartition(5)
    terms = spark.createDataFrame([(q, t) for q in range(7) for t in {word() for _ in range(4)}] + [(7, "absent"), (8, "absent"), (8, "w1")], "query long, term string")
    fields = [(docs.a, "A"), (docs.b, "D")]
    rounded = F.round("density", 6).alias("density")
    first = lambda rows: {tuple(r) for r in rows.selectExpr("*", "row_number() OVER (PARTITION BY query ORDER BY density DESC, id) AS r").filter("r <= 4").collect()}
    want = first(proximity.any_term(terms, proximity.positional(docs, "id", fields)).select("query", "id", "n_covers", rounded))
    assert len(want) > 20
    assert first(proximity.any_term_top(terms, docs, "id", fields, 4)) == want
    assert proximity.any_term_top(terms.limit(0), docs, "id", fields, 4).count() == 0


def test_scores_stay_where_texts_are_read(spark):
    """The exchange holds each task's first twenty of a question, not a row for each text and question."""

    def written() -> int:
        sc = spark.sparkContext
        none = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    assert QUERIES["r21_any_term_density"](spark, "/root/testdata/sf0.1").count() == 200 * 20
    assert written() - before < 200_000  # 10,000 texts for 200 questions
