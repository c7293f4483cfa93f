"""Summaries of evidence and facts, and synonyms, on small cases."""

from evidex.operators import summaries as S

EVIDENCE = "item string, nth int, kind string, source string, excerpt string, verified boolean, provider string, authority int, passed boolean, approved boolean, url string"


def test_evidence_summary(spark):
    rows = [
        ("a", 1, "extraction", "s1", "x", True, None, None, None, None, "u1"), ("a", 2, "extraction", "s2", "x", True, None, None, None, None, "u2"),  # s2 repeats s1
        ("a", 3, "extraction", "s3", "y", False, None, None, None, None, ""), ("a", 4, "validator", None, None, None, None, None, True, None, None),
        ("b", 1, "human", None, None, None, "ann", None, None, False, None), ("b", 2, "human", None, None, None, "ann", 90, None, True, None), ("b", 3, "human", None, None, None, None, 99, None, None, None),
        ("c", 1, "validator", None, None, None, None, None, True, None, None), ("c", 2, "validator", None, None, None, None, None, None, None, None),
        ("e", 1, "extraction", None, "x", True, None, None, None, None, None), ("e", 2, "extraction", "unknown", "x", True, None, None, None, None, "u"),
    ]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    items = spark.createDataFrame([(k, f"status {k}") for k in "abcde"], "item string, status string")
    sources = spark.createDataFrame([("s1", 40), ("s2", 80), ("s3", 100)], "source string, authority int")
    got = {r[0]: tuple(r)[1:] for r in S.evidence_summary(items, evidence, sources, "item").collect()}
    assert got == {"a": (1, 80, True, False), "b": (1, 90, False, True), "c": (0, 0, False, False), "d": (0, 0, False, False), "e": (1, 0, False, False)}
    asked = spark.createDataFrame([("a",), ("a",), ("c",), ("d",), ("nowhere",)], "item string")
    facts = {r.item: tuple(r)[1:] for r in S.item_facts(items, evidence, asked, "item", ["status"]).collect()}
    assert facts == {"a": ("status a", True, ["u1", "u2"], [True]), "c": ("status c", False, [], [True, False]), "d": ("status d", False, [], [])}


def test_means_leave_out_what_is_unknown(spark):
    rows = spark.createDataFrame([("x", 1.0, None), ("x", 0.5, None), ("x", None, None), ("y", 1.0, 0.25)], "d string, r double, m double")
    got = {r.d: tuple(r)[1:] for r in S.offline_aggregate(rows, "d", ["r", "m"], "r").collect()}
    assert got == {"x": (3, 0.75, None, 1), "y": (1, 1.0, 0.25, 1)}


def test_configuration(spark):
    rows = spark.createDataFrame([("x", "B"), ("x", "A"), ("x", "B"), ("y", "C")], "d string, s string")
    assert {r.d: r.configuration for r in S.run_configuration(rows, "d", "s", {"k": 3}).collect()} == {"x": '{"k":3,"knowledge_counts":{"A":1,"B":2}}', "y": '{"k":3,"knowledge_counts":{"C":1}}'}
    assert S.run_configuration(rows, "d", "s", {}).filter("d = 'y'").first().configuration == '{"knowledge_counts":{"C":1}}'


def test_synonyms(spark):
    groups = spark.createDataFrame([("g1", "Power Query"), ("g1", "M"), ("g1", "mashup"), ("g2", "DAX"), ("g2", "data analysis"), ("g2", "mashup"), ("g3", ""), ("g3", None)], "`group` string, member string")
    texts = ["What is power query?", "m-code and DAX", "MDAX or command", "mashup of DAX and Data  Analysis", "", None, "data analysis mashup m power query dax"]
    got = {r.q: r.added for r in S.synonyms(spark.createDataFrame([*enumerate(texts)], "q int, t string"), "q", "t", groups).collect()}
    assert got == {0: ["m", "mashup"], 1: ["data analysis", "mashup", "power query"], 3: ["data analysis", "m", "power query"]}
