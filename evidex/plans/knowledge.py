"""Deduplication, scoring, lifecycle and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import edges as E
from ..operators import graph, quality, vectors
from ..operators import lifecycle as L
from ..session import staged, table
from .registry import query, standard
from .text import NORM

#: "Now" for every query with a clock.
NOW = "2001-09-01"


def documents(spark, sf):
    """Documents with their two duplicate signals and the hash of what they say: texts are read and hashed once."""
    said = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    return staged(table(spark, sf, "documents").select("doc_id", "lang", "source", X.content_hash("text").alias("content"), X.fingerprint("text").alias("loose"), F.sha2(said, 256).alias("excerpt")), "signals")


@query(f"SELECT doc_id, duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {NORM.format('text')}) AS duplicate_of FROM documents) WHERE doc_id > duplicate_of")
def d01_exact_duplicates(spark, sf):
    return quality.exact_duplicates(documents(spark, sf), "content", "doc_id")


@query("""
    WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS w FROM conversations)
    SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) END, 6) AS overlap
    FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def d02_token_jaccard(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(X.words("text")).alias("w"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(quality.jaccard(F.col("w"), F.col("v")), 6).alias("overlap"))


@query("""
    SELECT p_partkey AS part_id, s_suppkey AS supplier_id, equal FROM (
    SELECT DISTINCT p_partkey, s_suppkey, len(list_filter(string_split(lower(p_name), ' '), lambda x: NOT list_contains(string_split(lower(n_name || ' ' || p_name), ' '), x))) = 0 AND len(list_filter(string_split(lower(n_name), ' '), lambda x: NOT list_contains(string_split(lower(p_name || ' ' || p_type), ' '), x))) = 0 AS equal
    FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)""")
def d03_object_equivalence(spark, sf):
    """Whether each side's content words lie within the other's statement and object."""
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("n_name"), " ")
    one = F.size(F.array_except(a, F.split(F.lower(F.concat_ws(" ", "n_name", "p_name")), " "))) == 0
    two = F.size(F.array_except(b, F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))) == 0
    return rows.select(F.col("p_partkey").alias("part_id"), F.col("s_suppkey").alias("supplier_id"), (one & two).alias("equal"))


@query(rf"""
    WITH d AS (SELECT doc_id, source, {NORM.format('text')} AS c, nullif(regexp_replace(lower(text), '[^0-9a-z]+', '', 'g'), '') AS l FROM documents),
    m AS (SELECT doc_id, 0 AS r, CASE WHEN doc_id = min(doc_id) OVER w THEN nth_value(doc_id, 2) OVER w ELSE min(doc_id) OVER w END AS o FROM d WINDOW w AS (PARTITION BY c ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
      UNION ALL SELECT doc_id, 1, CASE WHEN doc_id = min(doc_id) OVER w THEN nth_value(doc_id, 2) OVER w ELSE min(doc_id) OVER w END FROM d WHERE l IS NOT NULL WINDOW w AS (PARTITION BY l ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    b AS (SELECT doc_id, min(r) AS r, arg_min(o, r) AS o FROM m WHERE o IS NOT NULL GROUP BY 1)
    SELECT b.doc_id, b.o AS mirror_of, CASE b.r WHEN 0 THEN 'content' ELSE 'loose' END AS signal FROM b JOIN d x ON x.doc_id = b.doc_id JOIN d y ON y.doc_id = b.o WHERE x.source <> y.source""")
def d07_mirror_link(spark, sf):
    return quality.mirrors(documents(spark, sf), "doc_id", "source", ["content", "loose"])


@query("""
    WITH RECURSIVE link AS (SELECT o_orderkey AS node, o_orderkey // 3 AS parent FROM orders WHERE o_orderkey % 7 <> 0),
    up AS (SELECT node, parent AS root FROM link UNION ALL SELECT u.node, l.parent FROM up u JOIN link l ON l.node = u.root)
    SELECT node, min(root) AS root FROM up WHERE root NOT IN (SELECT node FROM link) GROUP BY 1""")
def d08_mirror_chains(spark, sf):
    """Roots of chains: orders whose number divides down, every seventh standing alone."""
    links = table(spark, sf, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("node"), F.expr("o_orderkey div 3").alias("parent"))
    return graph.chain_roots(links)


@query(r"""
    WITH e AS (SELECT lang, first_value(source) OVER (PARTITION BY lang, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY doc_id) AS owner, source FROM documents)
    SELECT lang AS item, count(DISTINCT source) AS n_sources FROM e WHERE owner = source GROUP BY 1""")
def d09_independent_sources(spark, sf):
    found = quality.independent_sources(documents(spark, sf), "lang", "excerpt", "source", "doc_id")
    return found.withColumnRenamed("lang", "item")


standard("d10_evidence_summary", """
    SELECT l_orderkey AS item, count(DISTINCT s_nationkey) AS n_sources, max(s_acctbal) AS max_authority, bool_and(l_returnflag <> 'R') AS validator_passed, bool_or(l_discount > 0.08) AS human_approved
    FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_orderkey""", "lineitem", "supplier")


@query("""
    SELECT l_orderkey AS item, CASE arg_max(c, (s_acctbal, -s_suppkey)) WHEN 0 THEN 'OFFICIAL' WHEN 1 THEN 'EXTERNAL' WHEN 2 THEN 'COMMUNITY' WHEN 3 THEN 'ORGANIZATION' ELSE 'EXTERNAL' END AS provenance
    FROM (SELECT l_orderkey, s_acctbal, s_suppkey, n_regionkey AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1""")
def d11_provenance(spark, sf):
    """The class of the evidence's source with the highest authority; a class without a name counts as external."""
    classes = F.create_map(*(F.lit(x) for pair in enumerate(quality.PROVENANCE.values()) for x in pair))
    sources = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf, "lineitem").join(sources, F.col("l_suppkey") == F.col("s_suppkey"))
    best = rows.groupBy(F.col("l_orderkey").alias("item")).agg(F.max_by("n_regionkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("c"))
    return best.select("item", F.coalesce(F.try_element_at(classes, "c"), F.lit("EXTERNAL")).alias("provenance"))


def scored(spark, sf):
    """Orders as items: their customer's balance as authority, their suppliers as sources."""
    now = F.lit(NOW).cast("timestamp_ntz")
    sources = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_suppkey").alias("sources"), F.bool_and(F.col("l_returnflag") != "R").alias("validators"))
    rows = table(spark, sf, "orders").join(sources, "o_orderkey", "left").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    seen, stale = F.col("o_orderdate"), F.col("o_orderstatus") == "P"
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(seen.cast("timestamp"))) / 86_400_000_000)
    fresh = quality.freshness(seen.cast("timestamp"), stale, now.cast("timestamp"))
    specific = quality.specificity(F.col("c_name"), F.col("o_orderpriority").startswith("1"))
    authority = F.floor(F.col("c_acctbal") / 100).cast("double")
    total, factors = quality.score(authority, F.col("o_orderstatus") == "F", F.coalesce("sources", F.lit(0)), specific, F.col("c_mktsegment") != "MACHINERY", F.col("validators"), fresh, F.col("o_orderpriority").startswith("5"), days < 2000)
    lv = quality.level(F.col("o_orderpriority").startswith("1"), F.coalesce("sources", F.lit(0)), authority, F.coalesce("validators", F.lit(False)))
    return rows.select("o_orderkey", total.alias("score"), factors.alias("factors"), lv.alias("level"), quality.status_for(lv, F.col("o_orderpriority").startswith("5")).alias("status"))


FACTORS = f"""
    WITH s AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, bool_and(l_returnflag <> 'R') AS v FROM lineitem GROUP BY 1),
    i AS (SELECT o_orderkey, floor(c_acctbal / 100) AS a, o_orderstatus = 'F' AS f, coalesce(n, 0) AS n, v, o_orderpriority LIKE '5%' AS conflict, o_orderpriority LIKE '1%' AS one, c_mktsegment <> 'MACHINERY' AS tax,
      CASE WHEN length(c_name) < 40 THEN 0.3 WHEN length(c_name) < 90 THEN 0.6 ELSE 0.8 END + CASE WHEN regexp_matches(c_name, '[0-9]') THEN 0.1 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 0.1 ELSE 0 END AS sp,
      floor(date_diff('microsecond', o_orderdate, TIMESTAMP '{NOW}') / 86400000000) AS days, o_orderstatus = 'P' AS stale
      FROM orders LEFT JOIN s ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey)"""


@query(FACTORS + """
    SELECT o_orderkey, round(0.30 * (least(greatest(a, 0), 100) / 100) + 0.15 * f::INT + 0.15 * least(n, 3) / 3.0 + 0.08 * least(1.0, sp) + 0.04 * tax::INT + 0.13 * CASE WHEN v IS NULL THEN 0.5 WHEN v THEN 1 ELSE 0 END
      + 0.08 * CASE WHEN stale THEN 0 WHEN days < 30 THEN 1 WHEN days < 90 THEN 0.7 WHEN days < 180 THEN 0.4 ELSE 0.2 END + 0.05 * CASE WHEN conflict THEN 0.3 ELSE 1 END + 0.02 * CASE WHEN days < 2000 THEN 1 ELSE 0.6 END, 3)::DOUBLE AS score FROM i""")
def d15_d16_d17_score(spark, sf):
    return scored(spark, sf).select("o_orderkey", F.round("score", 3).alias("score"))


@query(FACTORS + """, l AS (SELECT *, CASE WHEN one THEN 5 WHEN n = 0 THEN 0 ELSE greatest(1, CASE WHEN a >= 80 THEN 2 ELSE 1 END, CASE WHEN n >= 2 THEN 3 ELSE 1 END, CASE WHEN v THEN 4 ELSE 1 END) END AS level FROM i)
    SELECT o_orderkey, level, CASE WHEN conflict THEN 'CONFLICTED' WHEN level >= 2 THEN 'VERIFIED' WHEN level >= 1 THEN 'SUPPORTED' ELSE 'CANDIDATE' END AS status FROM l""")
def e02_e03_levels(spark, sf):
    return scored(spark, sf).select("o_orderkey", "level", "status")


@query(FACTORS + """, l AS (SELECT *, CASE WHEN one THEN 5 WHEN n = 0 THEN 0 ELSE greatest(1, CASE WHEN a >= 80 THEN 2 ELSE 1 END, CASE WHEN n >= 2 THEN 3 ELSE 1 END, CASE WHEN v THEN 4 ELSE 1 END) END AS level FROM i),
    t AS (SELECT o_orderkey, f, CASE o_orderkey % 5 WHEN 0 THEN 'CANDIDATE' WHEN 1 THEN 'SUPPORTED' WHEN 2 THEN 'VERIFIED' WHEN 3 THEN 'REJECTED' ELSE 'STALE' END AS cur, CASE WHEN conflict THEN 'CONFLICTED' WHEN level >= 2 THEN 'VERIFIED' WHEN level >= 1 THEN 'SUPPORTED' ELSE 'CANDIDATE' END AS tgt FROM l),
    o AS (SELECT * FROM (VALUES ('CANDIDATE', 1), ('SUPPORTED', 2), ('VERIFIED', 3)) r(s, k))
    SELECT o_orderkey, CASE WHEN cur = 'REJECTED' THEN cur WHEN cur = 'STALE' THEN CASE WHEN f THEN tgt ELSE cur END WHEN tgt = 'CONFLICTED' THEN CASE WHEN cur = 'CANDIDATE' THEN cur ELSE tgt END WHEN y.k > x.k THEN tgt ELSE cur END AS status
    FROM t LEFT JOIN o x ON x.s = cur LEFT JOIN o y ON y.s = tgt""")
def d18_rescore(spark, sf):
    """Levels turned into statuses, from a status that orders are given by number."""
    names = F.array(*map(F.lit, ["CANDIDATE", "SUPPORTED", "VERIFIED", "REJECTED", "STALE"]))
    rows = scored(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    current = F.get(names, (F.col("o_orderkey") % 5).cast("int"))
    return rows.select("o_orderkey", quality.rescored(current, F.col("status"), F.col("o_orderstatus") == "F").alias("status"))


@query("""
    WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS a, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 3 ELSE 1 END AS b FROM orders)
    SELECT o_orderkey, (ARRAY['EXTRACTED', 'CANDIDATE', 'SUPPORTED', 'VERIFIED'])[s] AS from_status, (ARRAY['EXTRACTED', 'CANDIDATE', 'SUPPORTED', 'VERIFIED'])[s + 1] AS to_status FROM c, range(1, 4) AS r(s) WHERE s >= a AND s < b""")
def e04_advance(spark, sf):
    """One transition a step along the chain of states."""
    now = F.when(F.col("o_orderkey") % 3 == 0, "EXTRACTED").otherwise("CANDIDATE")
    target = F.when(F.col("o_orderstatus") == "F", "VERIFIED").when(F.col("o_orderstatus") == "O", "SUPPORTED").otherwise("EXTRACTED")
    return table(spark, sf, "orders").select("o_orderkey", F.explode(quality.steps_to(now, target)).alias("s")).select("o_orderkey", "s.from_status", "s.to_status")


@query(r"""
    WITH e AS (SELECT doc_id, left(text, 60) AS quote FROM documents), d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN substr(text, 31) ELSE text END AS body FROM documents)
    SELECT quote AS item, bool_or(contains(body, quote)) AS still_verified, CASE WHEN bool_or(contains(body, quote)) THEN 'VERIFIED' ELSE 'STALE' END AS status FROM e JOIN d USING (doc_id) GROUP BY 1""")
def e05_stale_marking(spark, sf):
    """Quotes, the first 60 characters of documents, are items; evidence of changed documents is checked verbatim, and an
    item with none left is stale."""
    docs = table(spark, sf, "documents")
    changed = F.when(F.col("doc_id") % 4 == 0, F.expr("substring(text, 31)")).otherwise(F.col("text"))
    rows = docs.select(F.substring("text", 1, 60).alias("quote"), changed.alias("body"))
    return rows.groupBy(F.col("quote").alias("item")).agg(F.bool_or(F.col("body").contains(F.col("quote"))).alias("still_verified")).withColumn("status", F.when(F.col("still_verified"), "VERIFIED").otherwise("STALE"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    s AS (SELECT doc_id, pos, sha256(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS h FROM l WHERE trim(line) <> '')
    SELECT doc_id, CAST(pos AS BIGINT) AS pos, h AS section_hash FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.h = s.h AND o.pos % 3 <> 0)""")
def e07_section_delta(spark, sf):
    """Sections whose hash the stored version (here: without every third line) doesn't have."""
    from .text import lines

    rows = lines(spark, sf).filter(F.trim("line") != "").select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha2(F.trim(F.regexp_replace("line", r"\s+", " ")), 256).alias("section_hash"))
    return rows.join(rows.filter("pos % 3 <> 0").select("doc_id", "section_hash"), ["doc_id", "section_hash"], "left_anti").select("doc_id", "pos", "section_hash")


@query("""
    WITH o AS (SELECT l_orderkey, l_suppkey % 10 AS g, min(l_linenumber) AS i FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2 HAVING count(*) = 1),
    n AS (SELECT l_orderkey, l_suppkey % 10 AS g, min(l_linenumber) AS i FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT l_orderkey, g, o.i AS old_line, n.i AS new_line FROM o JOIN n USING (l_orderkey, g)""")
def e09_supersede(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("g", F.col("l_suppkey") % 10)
    old = lines.filter("l_returnflag = 'R'").withColumnRenamed("l_linenumber", "old_line")
    new = lines.filter("l_returnflag = 'A'").withColumnRenamed("l_linenumber", "new_line")
    return quality.one_to_one(old, new, ["l_orderkey", "g"], "old_line", "new_line")


@query("""
    WITH i AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS core, o_orderstatus AS object FROM orders),
    many AS (SELECT subject, core FROM i GROUP BY subject, core HAVING count(DISTINCT object) >= 3)
    SELECT a.id, min((SELECT min(c.id) FROM i c WHERE c.subject = a.subject AND c.core = a.core AND c.object = a.object)) AS class_id, count(*) AS n_partners
    FROM i a JOIN i b ON a.subject = b.subject AND a.core = b.core AND a.object <> b.object LEFT JOIN many ON many.subject = a.subject AND many.core = a.core WHERE many.subject IS NULL GROUP BY a.id""")
def g03_conflict_pairs(spark, sf):
    """Orders against which others of the same customer and priority stand with another status: their class and how many."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("core"), F.col("o_orderstatus").alias("object"))
    return E.conflicts(rows, "id", ["subject", "core"], "object")


@query("""
    SELECT d.o_orderkey AS src, min(f.o_orderkey) AS foundation, count(*) AS n_foundations, min(CASE WHEN d.o_orderpriority LIKE '1%' THEN 'example_of' ELSE 'depends_on' END) AS relation
    FROM orders d JOIN orders f ON d.o_custkey = f.o_custkey AND d.o_orderstatus = 'P' AND f.o_orderstatus = 'F' GROUP BY 1""")
def g07_derived_edges(spark, sf):
    """Pending orders depend on their customer's final ones, given by the first of these and their number."""
    role = F.when(F.col("o_orderstatus") == "F", "foundation").when(F.col("o_orderstatus") == "P", "dependent")
    relation = F.when(F.col("o_orderpriority").startswith("1"), "example_of").otherwise("depends_on")
    return E.to_foundation(table(spark, sf, "orders"), "o_orderkey", "o_custkey", role, relation)


EDGES = """SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
    UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'o' || o_orderkey, 'o' || (o_orderkey // 2) FROM orders WHERE o_orderkey % 97 = 1"""


def edges(spark, sf):
    """The tables' keys as dependencies, and a few chains of orders that make diamonds."""

    def part(name: str, a: str, b: str, kind: str, other: str, where: str = "true"):
        return table(spark, sf, name).filter(where).select(F.concat(F.lit(kind), F.col(a)).alias("src"), F.concat(F.lit(other), F.expr(b).cast("string")).alias("dst"))

    out = part("nation", "n_nationkey", "n_regionkey", "n", "r").union(part("customer", "c_custkey", "c_nationkey", "c", "n"))
    return out.union(part("orders", "o_orderkey", "o_custkey", "o", "c")).union(part("orders", "o_orderkey", "o_orderkey div 2", "o", "o", "o_orderkey % 97 = 1"))


REACHED = f"""
    WITH RECURSIVE e AS ({EDGES}), c AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS hops FROM region UNION SELECT c.root, e.src, c.hops + 1 FROM c JOIN e ON e.dst = c.node),
    n AS (SELECT root, node, min(hops) AS hops FROM c WHERE hops > 0 GROUP BY 1, 2)"""


@query(REACHED + " SELECT n.root, n.node, n.hops, min(e.dst) AS parent FROM n JOIN e ON e.src = n.node LEFT JOIN n p ON p.root = n.root AND p.node = e.dst WHERE p.hops = n.hops - 1 OR (n.hops = 1 AND e.dst = n.root) GROUP BY ALL")
def g09_closure(spark, sf):
    roots = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    return graph.closure(edges(spark, sf), roots)


@query(REACHED + """, i AS (SELECT 'c' || c_custkey AS node, c_mktsegment AS s FROM customer)
    SELECT node, root, hops FROM n JOIN i USING (node) WHERE s NOT IN ('MACHINERY', 'HOUSEHOLD')""")
def g10_propagate_flags(spark, sf):
    roots = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    status = F.when(F.col("c_mktsegment") == "MACHINERY", "REJECTED").when(F.col("c_mktsegment") == "HOUSEHOLD", "SUPERSEDED").otherwise("VERIFIED")
    items = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), status.alias("status"))
    return graph.flag_dependents(graph.closure(edges(spark, sf), roots), items).select("node", "root", "hops")


@query("""
    SELECT l.l_orderkey AS item, l.l_partkey AS dependency, CASE WHEN p.p_partkey IS NULL THEN 'missing' WHEN p.p_size > 40 THEN 'not live' ELSE 'flagged' END AS why
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l LEFT JOIN part p ON p.p_partkey = l.l_partkey
    WHERE p.p_partkey IS NULL OR p.p_size > 40 OR (p.p_size = 7 AND p.p_brand LIKE '%1')""")
def g11_unresolved_dependencies(spark, sf):
    parts = table(spark, sf, "part").withColumnRenamed("p_partkey", "dependency")
    needs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("dependency"))
    return E.unresolved(needs, parts, F.col("p_size") <= 40, (F.col("p_size") == 7) & F.col("p_brand").endswith("1"))


@query(REACHED + """, q AS (SELECT 'r' || (c_custkey % 5) AS start, 'c' || c_custkey AS target FROM customer UNION SELECT 'c' || (o_custkey + o_orderkey % 2), 'o' || o_orderkey FROM orders WHERE o_orderkey % 20 = 0)
    SELECT q.start, q.target, CASE WHEN q.start LIKE 'r%' THEN n.node IS NOT NULL ELSE EXISTS (SELECT 1 FROM e WHERE e.src = q.target AND e.dst = q.start) OR EXISTS (SELECT 1 FROM e a JOIN e b ON a.dst = b.src WHERE a.src = q.target AND b.dst = q.start) END AS reachable
    FROM q LEFT JOIN n ON n.root = q.start AND n.node = q.target""")
def g12_reachability(spark, sf):
    """Whether customers depend on a region, and orders on a customer."""
    customers = table(spark, sf, "customer").select(F.concat(F.lit("r"), F.col("c_custkey") % 5).alias("start"), F.concat(F.lit("c"), F.col("c_custkey")).alias("target"))
    orders = table(spark, sf, "orders").filter("o_orderkey % 20 = 0").select(F.concat(F.lit("c"), F.col("o_custkey") + F.col("o_orderkey") % 2), F.concat(F.lit("o"), F.col("o_orderkey")))
    return graph.reachable(edges(spark, sf), customers.union(orders).distinct())


@query("""
    WITH i AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'SUPPORTED' ELSE 'STALE' END AS status, o_custkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0),
    f AS (SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R')),
    c AS (SELECT a.o_orderkey AS id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey <> b.o_orderkey),
    u AS (SELECT l_orderkey AS id FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_partkey IS NULL OR p_size > 40 OR (p_size = 7 AND p_brand LIKE '%1'))
    SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'CONFLICTED' WHEN id IN (SELECT id FROM f) THEN 'STALE' ELSE status END AS status, id NOT IN (SELECT id FROM u) AS flag_cleared FROM i""")
def g14_revalidation(spark, sf):
    """Every third order is flagged: returned lines fail it, another order at the same time is in conflict with it, and
    its flag goes where no part is unresolved."""
    status = F.when(F.col("o_orderstatus") == "F", "VERIFIED").when(F.col("o_orderstatus") == "O", "SUPPORTED").otherwise("STALE")
    rows = table(spark, sf, "orders")
    items = rows.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), status.alias("status"))
    failed = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    conflicts = E.partners(rows.withColumn("each", F.col("o_orderkey")), "o_orderkey", ["o_custkey", "o_orderdate"], ["each"]).select(F.col("o_orderkey").alias("id"))
    return L.revalidated(items, failed, conflicts, g11_unresolved_dependencies(spark, sf).select(F.col("item").alias("id")))


@query("""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS w FROM documents),
    v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda z: z::DOUBLE) AS e, list_distinct(w) AS w, list_distinct(w[1:2]) AS o FROM embeddings JOIN d ON doc_id = vec_id),
    p AS (SELECT q.id AS query, i.id, round(1 - list_inner_product(q.e, i.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(i.e, i.e))), 6) AS distance, q.w AS qw, q.o AS qo, i.w, i.o FROM v q JOIN v i ON q.label = i.label AND q.id <> i.id WHERE q.id % 20 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM p),
    g AS (SELECT query, id, rank, distance, len(list_filter(o, lambda x: NOT list_contains(list_concat(qo, qw), x))) = 0 AND len(list_filter(qo, lambda x: NOT list_contains(list_concat(o, w), x))) = 0 AS same_object,
          round(CASE WHEN len(w) = 0 OR len(qw) = 0 THEN 0.0 ELSE len(list_intersect(w, qw)) / CAST(len(list_distinct(list_concat(w, qw))) AS DOUBLE) END, 6) AS overlap FROM t WHERE rank <= 5)
    SELECT query, id, rank, distance, same_object, overlap, coalesce(rank = min(CASE WHEN distance <= 0.06 AND same_object AND overlap >= 0.6 THEN rank END) OVER (PARTITION BY query), false) AS duplicate FROM g""")
def d04_d05_near_duplicates(spark, sf):
    """The five nearest of the same label for every twentieth vector with a document, and the guards on their texts."""
    words = X.words("text")
    docs = table(spark, sf, "documents").select("doc_id", F.array_distinct(words).alias("words"), F.array_distinct(F.slice(words, 1, 2)).alias("object"))
    v = table(spark, sf, "embeddings").join(docs, F.col("doc_id") == F.col("vec_id")).select(F.col("vec_id").alias("id"), F.col("label").alias("subject"), F.col("embedding").alias("vector"), "object", "words")
    v = staged(v, "items")
    return vectors.nearest_duplicates(v.filter("id % 20 = 0").withColumnRenamed("id", "query"), v)


@query("""
    WITH e AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'DERIVED' WHEN 1 THEN 'SYNTHESIZED' ELSE 'DIRECT' END AS origin, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS statement, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'because' END AS rationale, c_mktsegment AS t FROM customer),
    p AS (SELECT o_custkey AS id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS live FROM orders GROUP BY 1)
    SELECT e.id, list_filter([CASE WHEN statement = '' THEN 'no statement' END, CASE WHEN t NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'unknown type' END, CASE WHEN origin <> 'DIRECT' AND rationale = '' THEN 'no rationale' END,
      CASE WHEN coalesce(n, 0) < CASE origin WHEN 'SYNTHESIZED' THEN 2 WHEN 'DERIVED' THEN 1 ELSE 0 END THEN 'too few premises' END, CASE WHEN coalesce(live, 0) < coalesce(n, 0) THEN 'premise not live' END], lambda x: x IS NOT NULL) AS problems FROM e LEFT JOIN p ON p.id = e.id""")
def d20_entry_problems(spark, sf):
    """Customers as entries, their orders as premises."""
    c = table(spark, sf, "customer")
    origin = F.when(F.col("c_custkey") % 3 == 0, "DERIVED").when(F.col("c_custkey") % 3 == 1, "SYNTHESIZED").otherwise("DIRECT")
    entries = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("statement"), F.col("c_mktsegment").alias("knowledge_type"), origin.alias("origin"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise("because").alias("rationale"))
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "STALE").otherwise("SUPPORTED")
    items = o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("statement"))
    return L.entry_problems(entries, o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("premise")), items, ["BUILDING", "MACHINERY", "AUTOMOBILE"])
