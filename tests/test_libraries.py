"""Library functions on small fixtures, where the registered queries' tables don't reach a case."""

import random

from evidex.functions import quotes
from evidex.functions import text as X
from evidex.operators import checks, edges, lifecycle, metrics, quality, ranking, retrieval, validators, vectors
from pyspark.sql import functions as F


def test_quote_forms_and_source_offsets(spark):
    long = "One two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"Intro.  {long} ten"), (2, "x ONE  two\nthree four\tfive six seven eight nine."), (3, f"{long[:-5]} other"), (4, "a (b) c"), (5, "nothing")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, long), (8, "(B)"), (9, ""), (10, "b) C")], "quote_id int, quote string")
    got = {(r.quote_id, r.doc_id): (r.start, r["end"], r.form) for r in quotes.located(docs, asked).collect()}
    assert got == {(7, 1): (8, 8 + len(long), "exact"), (7, 2): (2, 47, "tolerant"), (7, 3): (0, 39, "head"), (8, 4): (2, 5, "tolerant"), (10, 4): (3, 7, "tolerant")}


def test_passages(spark):
    t = "head " * 300 + "needle one " + "x" * 2000 + " needle two"
    df = spark.createDataFrame([(1, t, ["needle"]), (2, "short", ["absent", ""]), (3, None, None)], "i int, t string, n array<string>")
    got = {r.i: r.p for r in df.select("i", quotes.passages("t", "n").alias("p")).collect()}
    assert len(got[1]) == 2 and all("needle" in p and len(p) <= 900 for p in got[1]) and got[2] == ["short"] and got[3] == [""]


def test_addresses(spark):
    cases = {"8.8.8.8": True, "10.0.0.1": False, "0x7f.1": False, "2130706433": False, "0177.0.0.1": False, "::1": False, "::ffff:10.0.0.1": False, "2002:0a00:0001::": False, "2606:4700::1111": True, "100.64.1.1": False, "224.0.0.1": False, "example.org": None, "1.2.3.4.5": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert [r.p for r in df.select(X.public_address(F.col("h")).alias("p")).collect()] == list(cases.values())


def test_partners_against_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(5), rng.randrange(3), rng.randrange(3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k int, a int, b int")
    want = {}
    for i, k, a, b in rows:
        n = sum(k == k2 and a != a2 and b != b2 for _, k2, a2, b2 in rows)
        if n:
            want[i] = (min(j for j, *x in rows if x == [k, a, b]), n)
    assert {r.id: (r.class_id, r.n_partners) for r in edges.partners(df, "id", ["k"], ["a", "b"]).collect()} == want


def test_derived_scores_over_several_steps(spark):
    items = [(1, 0.8, 4, "VERIFIED", None, False), (2, 0.6, 2, "SUPPORTED", None, False), (3, 0.9, 4, "SUPERSEDED", 2, False), (10, None, None, "CANDIDATE", None, False), (11, None, None, "CANDIDATE", None, False), (12, None, None, "VERIFIED", None, False), (13, None, None, "CANDIDATE", None, True), (14, None, None, "STALE", None, False)]
    df = spark.createDataFrame(items, "id int, confidence double, level int, status string, superseded_by int, approved boolean")
    uses = [(10, 1), (10, 2), (10, 3), (11, 10), (11, 1), (12, 3), (13, 12), (14, 11)]
    got = {r.id: (r.confidence, r.level, r.status) for r in lifecycle.derived_scores(df, spark.createDataFrame(uses, "id int, premise int")).collect()}
    assert got == {10: (0.54, 2, "SUPPORTED"), 11: (0.486, 2, "SUPPORTED"), 12: (0.45, 0, "STALE"), 13: (0.225, 5, "VERIFIED"), 14: (0.4374, 2, "SUPPORTED")}


def test_near_duplicate_guards(spark):
    rows = [("dup", [1.0, 0.0], "filter context", "the filter context applies to rows"), ("far", [0.0, 1.0], "filter context", "the filter context applies to rows"), ("object", [1.0, 0.01], "row context", "the row applies to rows"), ("words", [1.0, 0.02], "filter context", "what a filter context is said to be")]
    items = spark.createDataFrame([(i, "s", v, o.split(), t.split()) for i, v, o, t in rows] + [("other", "z", [1.0, 0.0], ["filter", "context"], ["the", "filter", "context"])], "id string, subject string, vector array<double>, object array<string>, words array<string>")
    q = spark.createDataFrame([("q", "s", [1.0, 0.0], ["filter", "context"], "the filter context applies to all rows".split())], "query string, subject string, vector array<double>, object array<string>, words array<string>")
    got = {r.id: r.duplicate for r in vectors.nearest_duplicates(q, items).collect()}
    assert got == {"dup": True, "far": False, "object": False, "words": False}


def test_intents_and_versions(spark):
    cases = {"Which visuals are there": "listing", "what are the risks of x": "limitation", "How does it work": "conceptual", "how do I set it up": "procedure", "what is a measure": "definition", "blah": None, "difference between a and b": "comparison"}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert [r.i for r in df.select(ranking.intent("q").alias("i")).collect()] == list(cases.values())
    assert df.limit(1).select(ranking.intent("q", {"limitation": ["^which"]}).alias("i")).first().i == "limitation"
    v = spark.createDataFrame([("since version 2.1.3",), ("in 2024",), ("Version v2023 of",)], "q string").select(ranking.version("q").alias("v"))
    assert [r.v for r in v.collect()] == ["2.1.3", None, "2023"]


def test_entities(spark):
    items = spark.createDataFrame([("Star schema design",), ("star schema design",), ("Gateway",), ("on-premises data gateway",), ("CALCULATE function",)], "subject string")
    q = spark.createDataFrame([(1, "Does the star schema need an on-premises data gateway or CALCULATE here")], "query int, text string")
    got = {r.low: (r.kind, r.n_items, round(r.weight, 3)) for r in ranking.entities(q, items).collect()}
    assert got == {"star schema": ("prefix", 2, 0.5), "on-premises data gateway": ("subject", 1, 1.0), "calculate": ("identifier", 0, 1.0)}


def test_answers(spark):
    a = [("The base does not contain it.", 3, 0), ("x [1]", 3, 1), ("x", 3, 0), ("x", 0, 1), ("does not contain " + "y" * 400, 3, 0)]
    df = spark.createDataFrame(a, "t string, r int, c int")
    assert [r.k for r in df.select(checks.answer_kind("t", F.col("r"), F.col("c")).alias("k")).collect()] == ["abstention", "cited_answer", "uncited_answer", "abstention", "uncited_answer"]


def test_percentiles_are_exact(spark):
    import numpy as np

    rng = random.Random(2)
    rows = [(k, float(rng.choice([rng.random(), 5, 5, rng.gauss(0, 50)]))) for k in "abc" for _ in range(500)] + [("one", 3.0), ("null", None)]
    got = {r.k: r.percentile for r in metrics.percentile(spark.createDataFrame(rows, "k string, v double"), "k", "v", 0.95).collect()}
    assert set(got) == {"a", "b", "c", "one"} and all(abs(got[k] - np.percentile([v for j, v in rows if j == k], 95)) < 1e-9 for k in got)


def test_validator_results(spark):
    items = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    new = validators.run(items, "id", "text", {"ok": lambda t: True, "full": bool, "bad": lambda t: 1 / 0})
    assert sorted(tuple(r) for r in new.collect()) == [(1, "bad", "error"), (1, "full", "passed"), (1, "ok", "passed"), (2, "bad", "error"), (2, "full", "failed"), (2, "ok", "passed")]
    old = spark.createDataFrame([(1, "ok", "failed"), (1, "bad", "passed")], "id int, validator string, outcome string")
    merged = validators.replaced(old, new, ["id", "validator"])
    assert (1, "bad", "passed") in {tuple(r) for r in merged.collect()} and merged.count() == 5
    assert [r.id for r in validators.validated(new, "id").collect()] == [1]
    files = {"a": items}
    assert sorted(validators.extended(files, lambda f: {"n": f["a"].limit(1)})) == ["a", "ext/n"]


def test_lexical_lists_are_exact_whatever_is_common(spark):
    import math

    rng = random.Random(3)
    vocab = [f"t{i}" for i in range(60)]
    docs = {i: {t for k, t in enumerate(vocab) if rng.random() < 1 / (1 + k / 4)} for i in range(300)}
    asked = {q: set(rng.sample(vocab, rng.choice([1, 2, 5, 20]))) for q in range(25)}
    posts = spark.createDataFrame([(i, t) for i, ts in docs.items() for t in ts], "id int, term string")
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query int, term string")
    idf = retrieval.document_frequency(posts, len(docs))
    value = {r.term: r.idf for r in idf.collect()}
    got = {(r.query, r.lex_rank): (r.id, r.coverage) for r in retrieval.lexical_channel(terms, posts, idf, 7).collect()}
    want = {}
    for q, ts in asked.items():
        total = math.fsum(value[t] for t in ts if t in value)
        scores = [(-round(math.fsum(value[t] for t in ts & own) / total, 6), i) for i, own in docs.items() if ts & own]
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(sorted(scores)[:7], 1)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
