"""Queries over sums of evidence, runs and declared synonyms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import summaries
from ..session import staging, table
from ..sources import digested, store
from .registry import query

LINES = """SELECT l_orderkey AS item, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS nth, CASE l_linenumber % 4 WHEN 0 THEN 'human' WHEN 3 THEN 'validator' ELSE 'extraction' END AS kind, s_nationkey AS source, CAST(l_partkey % 3 AS VARCHAR) AS excerpt, l_linestatus = 'F' AS verified,
    CASE WHEN l_suppkey % 3 <> 0 THEN 'p' || l_suppkey % 5 END AS provider, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_quantity AS INT) END AS authority, l_returnflag <> 'R' AS passed, l_discount > 0.05 AS approved, CASE WHEN l_partkey % 7 > 0 THEN 'u' || l_suppkey ELSE '' END AS url FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""


def lines(spark, sf):
    """Lines of orders as evidence of items; suppliers' nations are the sources."""
    n = F.col("l_linenumber") % 4
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    s = F.col("l_suppkey")
    return rows.select(
        F.col("l_orderkey").alias("item"), (F.col("l_linenumber") * F.lit(10_000_000_000) + F.col("l_partkey") * 100_000 + s).alias("nth"), F.when(n == 0, "human").when(n == 3, "validator").otherwise("extraction").alias("kind"), F.col("s_nationkey").alias("source"), (F.col("l_partkey") % 3).cast("string").alias("excerpt"),
        (F.col("l_linestatus") == "F").alias("verified"), F.when(s % 3 != 0, F.concat(F.lit("p"), (s % 5).cast("string"))).alias("provider"), F.when(s % 2 == 0, F.col("l_quantity").cast("int")).alias("authority"),
        (F.col("l_returnflag") != "R").alias("passed"), (F.col("l_discount") > 0.05).alias("approved"), F.when(F.col("l_partkey") % 7 > 0, F.concat(F.lit("u"), s.cast("string"))).otherwise("").alias("url"))


@query(f"""
    WITH e AS ({LINES}), q AS (SELECT * FROM e WHERE kind = 'extraction' AND verified),
    f AS (SELECT item, count(DISTINCT owner) AS n FROM (SELECT item, arg_min(source, nth) AS owner FROM q GROUP BY item, excerpt) GROUP BY item),
    b AS (SELECT item, max(n_nationkey * 3) AS best FROM q JOIN nation ON n_nationkey = source GROUP BY 1),
    r AS (SELECT item, count(DISTINCT CASE WHEN kind = 'human' THEN provider END) AS people, max(CASE WHEN kind = 'human' AND provider IS NOT NULL THEN coalesce(authority, 60) END) AS said, bool_and(passed) FILTER (WHERE kind = 'validator') AS passed, coalesce(bool_or(approved) FILTER (WHERE kind = 'human'), false) AS approved FROM e GROUP BY 1)
    SELECT o_orderkey AS item, coalesce(n, 0) + coalesce(people, 0) AS n_sources, coalesce(greatest(best, said), 0) AS max_authority, coalesce(passed, false) AS validator_passed, coalesce(approved, false) AS human_approved
    FROM orders LEFT JOIN f ON f.item = o_orderkey LEFT JOIN b ON b.item = o_orderkey LEFT JOIN r ON r.item = o_orderkey""")
def d10_independent_summary(spark, sf):
    """What the evidence of every order amounts to: independent sources and people, authority, validators, approval."""
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"))
    sources = table(spark, sf, "nation").select(F.col("n_nationkey").alias("source"), (F.col("n_nationkey") * 3).alias("authority"))
    return summaries.evidence_summary(items, lines(spark, sf), sources, "item")


@query(f"""
    WITH e AS ({LINES})
    SELECT o_orderkey AS item, o_orderstatus AS status, o_orderpriority AS topic, coalesce(bool_or(kind = 'extraction' AND verified), false) AS evidence_verified,
        coalesce(list(url ORDER BY nth) FILTER (WHERE url <> ''), []) AS evidence_urls, coalesce(list(passed ORDER BY nth) FILTER (WHERE kind = 'validator'), []) AS validator_results
    FROM orders LEFT JOIN e ON e.item = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) GROUP BY ALL""")
def v17_asked_facts(spark, sf):
    """Facts of the orders that large lines ask for."""
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("topic"))
    asked = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("item"))
    return summaries.item_facts(items, lines(spark, sf), asked, "item", ["status", "topic"])


@query("""
    WITH r AS (SELECT event_type AS dataset, value / 100 AS mrr, CASE WHEN user_id % 4 > 0 THEN least(value / 80, 1) END AS recall, CASE WHEN value > 50 THEN value END AS latency FROM events)
    SELECT dataset, count(*) AS questions, round(CAST(sum(CAST(mrr AS DECIMAL(28, 10))) AS DOUBLE) / count(mrr), 10) AS mrr, round(CAST(sum(CAST(recall AS DECIMAL(28, 10))) AS DOUBLE) / count(recall), 10) AS recall, round(CAST(sum(CAST(latency AS DECIMAL(28, 10))) AS DOUBLE) / count(latency), 10) AS latency, count(*) FILTER (WHERE recall = 1) AS fully_covered
    FROM r GROUP BY 1""")
def v16_offline_means(spark, sf):
    """Means over events as a run's questions, some of whose measures are unknown."""
    value = F.col("value")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("dataset"), (value / 100).alias("mrr"), F.when(F.col("user_id") % 4 > 0, F.least(value / 80, F.lit(1.0))).alias("recall"), F.when(value > 50, value).alias("latency"))
    return summaries.offline_aggregate(rows, "dataset", ["mrr", "recall", "latency"], "recall")


@query("""
    SELECT o_orderpriority AS domain, '{"answer_mode":"staged","retrieval_k":8,"knowledge_counts":{' || string_agg('"' || o_orderstatus || '":' || n, ',' ORDER BY o_orderstatus) || '}}' AS configuration
    FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""")
def v20_configuration(spark, sf):
    """Each priority's configuration record, with how many orders stand in each status."""
    return summaries.run_configuration(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("domain"), "o_orderstatus"), "domain", "o_orderstatus", {"retrieval_k": 8, "answer_mode": "staged"})


@query(r"""
    WITH g AS (SELECT DISTINCT 'brand ' || split_part(p_brand, '#', 2) AS g, lower(split_part(p_name, ' ', 1)) AS member FROM part UNION SELECT 'item ' || item_id, lower(w) FROM (SELECT item_id, unnest(string_split(text, ' ')[1:3]) AS w FROM benchmark) WHERE w <> ''),
    m AS (SELECT DISTINCT g, trim(member) AS member FROM g WHERE trim(member) <> ''), q AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user'),
    h AS (SELECT DISTINCT conv_id, turn, member FROM q JOIN (SELECT DISTINCT member FROM m) ON contains(t, member) WHERE regexp_matches(t, '(?:^|[^\p{L}\p{N}_])' || regexp_replace(member, '([\\.+*?()\[\]{}|^$-])', '\\\1', 'g') || '(?:[^\p{L}\p{N}_]|$)')),
    a AS (SELECT DISTINCT h.conv_id, h.turn, n.member FROM h JOIN m ON m.member = h.member JOIN m n ON n.g = m.g ANTI JOIN h x ON x.conv_id = h.conv_id AND x.turn = h.turn AND x.member = n.member)
    SELECT conv_id, turn, list_sort(list(member)) AS added FROM a GROUP BY 1, 2""")
def r03_synonym_groups(spark, sf):
    """Members that users' turns lack of the declared groups they name, from a table of groups: the first words of parts by
    brand, and of benchmark texts."""
    first = F.split("text", " ")
    parts = table(spark, sf, "part").select(F.concat(F.lit("brand "), F.split("p_brand", "#")[1]).alias("group"), F.split("p_name", " ")[0].alias("member"))
    bench = table(spark, sf, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("group"), F.explode(F.slice(first, 1, 3)).alias("member"))
    asked = table(spark, sf, "conversations").filter("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("q"), "text")
    added = summaries.synonyms(asked, "q", "text", parts.union(bench))
    part = F.split("q", "/")
    return added.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), "added")


@query("""
    WITH o AS (SELECT s_suppkey AS k, s_name AS name, CAST(s_nationkey AS INT) AS authority, CASE WHEN s_suppkey % 2 = 0 THEN 'official' ELSE 'community' END AS source_class, CASE s_suppkey % 3 WHEN 0 THEN 'CANDIDATE' WHEN 1 THEN 'ACTIVE' ELSE 'DISABLED' END AS status, CASE WHEN s_suppkey % 10 = 1 THEN s_suppkey - 1 END AS mirror_of FROM supplier WHERE s_suppkey % 9 <> 0),
    d AS (SELECT s_suppkey AS k, s_name AS name, CAST(s_nationkey + CASE WHEN s_suppkey % 4 = 0 THEN 50 ELSE 0 END AS INT) AS authority, CASE WHEN s_suppkey % 6 = 1 THEN 'external' WHEN s_suppkey % 6 = 2 THEN 'official' END AS source_class, CASE s_suppkey % 10 WHEN 1 THEN s_suppkey WHEN 2 THEN s_suppkey - 1 WHEN 3 THEN -5 END AS mirror_of FROM supplier WHERE s_suppkey % 5 <> 0),
    e AS (SELECT k, name, authority, coalesce(source_class, CASE WHEN authority >= 50 THEN 'official' ELSE 'external' END) AS source_class, mirror_of FROM d),
    keys AS (SELECT k FROM o UNION SELECT k FROM e)
    SELECT coalesce(o.k, e.k) AS source_key, CASE WHEN o.k IS NULL THEN 'insert' WHEN e.k IS NULL THEN 'absent' WHEN o.name <> e.name OR o.authority <> e.authority OR o.source_class <> e.source_class OR o.mirror_of IS DISTINCT FROM e.mirror_of OR o.status = 'CANDIDATE' THEN 'update' ELSE 'same' END AS action,
        CASE WHEN e.k IS NULL THEN o.authority ELSE e.authority END AS authority, CASE WHEN e.k IS NULL THEN o.source_class ELSE e.source_class END AS source_class, CASE WHEN o.k IS NULL OR (e.k IS NOT NULL AND o.status = 'CANDIDATE') THEN 'ACTIVE' ELSE o.status END AS status,
        CASE WHEN e.k IS NULL THEN o.mirror_of WHEN e.mirror_of IN (SELECT k FROM keys) AND e.mirror_of <> e.k THEN e.mirror_of END AS mirror_of, coalesce(o.source_class <> e.source_class, false) AS class_changed
    FROM o FULL JOIN e ON o.k = e.k""")
def a12_catalogue_sync(spark, sf):
    """Suppliers as a catalogue, declared anew: candidates promoted, classes changed or defaulted, mirrors resolved at last."""
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(k.alias("source_key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("authority"), k)
    stored = rows.filter("s_suppkey % 9 <> 0").withColumn("source_class", F.when(k % 2 == 0, "official").otherwise("community")).withColumn("status", F.when(k % 3 == 0, "CANDIDATE").when(k % 3 == 1, "ACTIVE").otherwise("DISABLED")).withColumn("mirror_of", F.when(k % 10 == 1, k - 1))
    declared = rows.filter("s_suppkey % 5 <> 0").withColumn("authority", (F.col("authority") + F.when(k % 4 == 0, 50).otherwise(0)).cast("int")).withColumn("source_class", F.when(k % 6 == 1, "external").when(k % 6 == 2, "official")).withColumn("mirror_of", F.when(k % 10 == 1, k).when(k % 10 == 2, k - 1).when(k % 10 == 3, F.lit(-5)))
    default = F.when(F.col("authority") >= 50, "official").otherwise("external")
    return store.catalogue_sync(stored, declared, "source_key", ["name", "authority"], default).drop("name")


@query("SELECT o_orderkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, [o_orderpriority, CAST(o_custkey AS VARCHAR)] AS tags FROM orders")
def a13_a14_digested_round_trip(spark, sf):
    """Orders through the data source of digested files: half of them written, the rest appended, all read back."""
    digested.register(spark)
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("o_totalprice"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.array("o_orderpriority", F.col("o_custkey").cast("string")).alias("tags"))
    path = f"{staging(spark)}/digested-{uuid.uuid4().hex}"
    rows.filter("o_orderkey % 2 = 0").write.format("digested").mode("overwrite").save(path)
    rows.filter("o_orderkey % 2 <> 0").write.format("digested").mode("append").save(path)
    return spark.read.format("digested").schema(rows.schema).load(path)
