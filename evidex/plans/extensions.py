"""Validators, conflict resolution, surface forms and file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import lifecycle, validators
from ..session import staging, table
from ..sources import store
from .registry import query


def balanced(text: str) -> bool | None:
    """As many closing as opening brackets; none where a text has no bracket."""
    return None if "(" not in text and ")" not in text else text.count("(") == text.count(")")


def second_word(text: str) -> bool:
    """Raises where a text has one word only."""
    return len(text.split(" ")[1]) > 2


@query("""
    WITH v AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents)
    SELECT doc_id, 'balanced' AS validator, CASE WHEN NOT contains(text, '(') AND NOT contains(text, ')') THEN 'skipped' WHEN len(regexp_extract_all(text, '[(]', 0)) = len(regexp_extract_all(text, '[)]', 0)) THEN 'passed' ELSE 'failed' END AS outcome FROM v
    UNION ALL SELECT doc_id, 'second_word', CASE WHEN len(w) < 2 THEN 'error' WHEN length(w[2]) > 2 THEN 'passed' ELSE 'failed' END FROM v
    UNION ALL SELECT doc_id, 'shell', 'skipped' FROM v""")
def u02_validator_runner(spark, sf):
    """Three validators on every document: one that may not apply, one that may raise, one that would execute."""
    checks = {"balanced": balanced, "second_word": second_word, "shell": bool}
    return validators.run(table(spark, sf, "documents"), "doc_id", "text", checks, frozenset({"shell"}))


@query("""
    WITH p AS (SELECT o_custkey, min(o_orderkey) AS a_id, max(o_orderkey) AS b_id FROM orders GROUP BY 1 HAVING count(*) > 1), k AS (SELECT *, CASE o_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'both' ELSE 'neither' END AS keep FROM p)
    SELECT a_id AS item, CASE keep WHEN 'a' THEN 'VERIFIED' WHEN 'both' THEN 'VERIFIED' WHEN 'neither' THEN 'REJECTED' ELSE 'SUPERSEDED' END AS status FROM k
    UNION ALL SELECT b_id, CASE keep WHEN 'b' THEN 'VERIFIED' WHEN 'both' THEN 'VERIFIED' WHEN 'neither' THEN 'REJECTED' ELSE 'SUPERSEDED' END FROM k""")
def e13_conflict_resolution(spark, sf):
    """A customer's first and last order in conflict, resolved by the customer's number."""
    keep = F.element_at(F.array(*map(F.lit, ["a", "b", "both", "neither"])), (F.col("o_custkey") % 4 + 1).cast("int"))
    pairs = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("a_id"), F.max("o_orderkey").alias("b_id"), F.count("*").alias("n")).filter("n > 1")
    return lifecycle.resolved(pairs, keep)


@query(r"SELECT conv_id, turn, nullif(regexp_extract(text, '(?i)(?:^|[^\p{L}])(' || left(regexp_extract(lower(text), '([a-z]{5,})', 1), 4) || '[\w-]*)', 1), '') AS surface FROM conversations WHERE regexp_matches(lower(text), '[a-z]{5,}')")
def p04_surface_form(spark, sf):
    """The first word as written that begins with the first four letters of a turn's first long run of letters."""
    stem = F.substring(F.regexp_extract(F.lower("text"), "([a-z]{5,})", 1), 1, 4)
    return table(spark, sf, "conversations").filter(F.lower("text").rlike("[a-z]{5,}")).select("conv_id", "turn", X.surface(F.col("text"), stem).alias("surface"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS p_brand FROM part")
def a13_a14_jsonl_round_trip(spark, sf):
    """Parts written as sorted JSON lines to the shared folder and read back by an explicit schema, nulls included."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("p_brand"))
    path = f"{staging(spark)}/jsonl-{uuid.uuid4().hex}"
    store.write_jsonl(part, path, "p_partkey")
    return store.read_jsonl(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in part.schema.fields]))


@query("""SELECT 'parts' AS file, count(*) AS n_rows, count(DISTINCT p_brand) AS n_brands FROM part UNION ALL SELECT 'ext/dear', count(*), count(DISTINCT p_brand) FROM part WHERE p_retailprice > 1500
    UNION ALL SELECT 'ext/brands', count(*), count(DISTINCT p_brand) FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) WHERE n > 1""")
def u04_export_extension(spark, sf):
    """An export's files with those that two extensions make from its records."""
    files = {"parts": table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")}
    dear = lambda records: {"dear": records["parts"].filter("p_retailprice > 1500")}
    brands = lambda records: {"brands": records["parts"].groupBy("p_brand").agg(F.count("*").alias("n")).filter("n > 1")}
    sizes = [rows.agg(F.count("*").alias("n_rows"), F.countDistinct("p_brand").alias("n_brands")).select(F.lit(name).alias("file"), "n_rows", "n_brands") for name, rows in validators.extended(files, dear, brands).items()]
    return sizes[0].union(sizes[1]).union(sizes[2])
