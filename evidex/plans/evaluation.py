"""Evaluation, snapshot, operations and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, lifecycle, metrics, snapshot
from ..session import staged, table
from ..sources import store
from . import retrieval
from .registry import query, standard
from .text import NORM, QUOTES, c06_quote_location

C06 = QUOTES + ", found AS (SELECT item_id AS query, doc_id AS id FROM best)"


@query(r"""
    WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM conversations)
    SELECT q.conv_id, q.turn, contains(a.t, split_part(q.t, ' ', 1)) AS has_concept, contains(a.t, 'idiot') AS has_forbidden FROM t q JOIN t a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND q.role = 'user'""")
def v01_concept_checks(spark, sf):
    flat = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", flat.alias("t"))
    a = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("answer"))
    return t.filter("role = 'user'").join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.col("answer").contains(F.split_part("t", F.lit(" "), F.lit(1))).alias("has_concept"), F.col("answer").contains("idiot").alias("has_forbidden"))


@query(r"""
    WITH t AS (SELECT conv_id, turn, role, text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS f FROM conversations)
    SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 OR (length(f) <= 400 AND regexp_matches(f, 'does not contain|do not contain|not enough|insufficient|no verified information|does not cover|not covered|cannot answer|no information|not available in the knowledge|not possible to determine|not possible to answer')) THEN 'abstention'
      WHEN regexp_matches(text, '\[[0-9]+\]') OR turn % 4 = 2 THEN 'cited_answer' ELSE 'uncited_answer' END AS kind FROM t WHERE role = 'assistant'""")
def v02_answer_kind(spark, sf):
    """Answers by kind; every ninth conversation retrieved nothing, and some turns count as citing."""
    rows = table(spark, sf, "conversations").filter("role = 'assistant'")
    cited = F.when(F.col("text").rlike(r"\[[0-9]+\]") | (F.col("turn") % 4 == 2), 1).otherwise(0)
    return rows.select("conv_id", "turn", checks.answer_kind("text", F.col("conv_id") % 9, cited).alias("kind"))


@query(retrieval.FUSED + f""", {C06}, r AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0), 9) DESC, id) AS rank FROM u),
    c AS (SELECT item_id AS query, list_distinct([lower(x) FOR x IN string_split(text, ' ') IF length(x) > 9]) AS concepts FROM benchmark),
    k AS (SELECT c.query, min(rank) AS first FROM c LEFT JOIN (SELECT r.query, rank, lower(text) AS t FROM r JOIN documents ON doc_id = r.id WHERE rank <= 10) x ON x.query = c.query AND len(list_filter(concepts, lambda w: contains(t, w))) > 0 GROUP BY 1),
    h AS (SELECT f.query, count(*) AS n, count(rank) AS hit FROM found f LEFT JOIN r ON r.query = f.query AND r.id = f.id AND r.rank <= 10 GROUP BY 1)
    SELECT k.query, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, first IS NOT NULL AS hit, coalesce(h.hit = 0, false) OR coalesce(h.hit / 10.0 < 0.5, false) AS missed FROM k LEFT JOIN h ON h.query = k.query""")
def v18_v19_concept_rank(spark, sf):
    """Where a question's long words first occur in what the hybrid search retrieves, and whether the retrieval missed."""
    concepts = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.array_distinct(F.transform(F.filter(F.split("text", " "), lambda x: F.length(x) > 9), lambda x: F.lower(x))).alias("concepts"))
    found = staged(retrieval.r28_rrf_hybrid(spark, sf).select("query", "id", "rank"), "retrieved")
    texts = found.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    ranks = checks.concept_rank(texts, concepts, "query", "text", "rank")
    relevant = c06_quote_location(spark, sf).select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"))
    measures = relevant.join(found, ["query", "id"], "left").groupBy("query").agg((F.count("rank") / F.count("*")).alias("recall"), (F.count("rank") / 10).alias("precision"))
    rows = ranks.join(measures, "query", "left")
    return rows.select("query", F.round("mrr", 6).alias("mrr"), "hit", checks.retrieval_missed(F.lit(10), F.col("recall"), F.col("precision")).alias("missed"))


@query(f"WITH {C06} SELECT item_id, count(id) > 0 AS in_corpus, CASE WHEN count(id) = 0 THEN 'not covered' WHEN count(id) = 1 THEN 'single source' ELSE 'covered' END AS class FROM benchmark LEFT JOIN found ON query = item_id GROUP BY 1")
def v07_v09_v10_coverage(spark, sf):
    """Whether the corpus holds a question's passage, and the class of failure if it doesn't."""
    found = c06_quote_location(spark, sf).groupBy("item_id").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "benchmark").select("item_id").join(found, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("item_id", (F.col("n") > 0).alias("in_corpus"), F.when(F.col("n") == 0, "not covered").when(F.col("n") == 1, "single source").otherwise("covered").alias("class"))


@query(retrieval.FUSED + f""", {C06}, r AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0), 9) DESC, id) AS rank FROM u),
    h AS (SELECT f.query, f.id, r.rank FROM found f LEFT JOIN r ON r.query = f.query AND r.id = f.id AND r.rank <= 10)
    SELECT query, round(count(rank) / count(*)::DOUBLE, 6) AS recall, round(count(rank) / 10.0::DOUBLE, 6) AS precision, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS mrr, min(rank) AS first_rank FROM h GROUP BY 1""")
def v04_v05_v15_ir_metrics(spark, sf):
    """Recall, precision and reciprocal rank at 10 of the hybrid search; documents with the passage are relevant."""
    relevant = c06_quote_location(spark, sf).select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"))
    hits = relevant.join(retrieval.r28_rrf_hybrid(spark, sf).select("query", "id", "rank"), ["query", "id"], "left")
    n = F.count("rank")
    return hits.groupBy("query").agg(F.round(n / F.count("*"), 6).alias("recall"), F.round(n / F.lit(10.0), 6).alias("precision"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"), F.min("rank").alias("first_rank"))


def mean(x: str) -> str:
    """An average over exact decimal sums, which no order of addition changes. Averages are rounded to ten places: at
    fewer, ties are common, and engines break them apart."""
    return f"CAST(sum(CAST({x} AS DECIMAL(18, 2))) AS DOUBLE) / count({x})"


DAILY = "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, event_type, value, user_id FROM {events}"
standard("v11_metrics", f"""
    SELECT day, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END), 10) AS error_rate, round({mean("CASE WHEN event_type = 'purchase' THEN value END")}, 10) AS mean_purchase,
           round({mean("CASE WHEN event_type = 'view' AND value > 50 THEN value END")}, 10) AS mean_large_view, count(DISTINCT user_id) AS n_users FROM ({DAILY}) d GROUP BY day""", "events")
standard("v12_regression", f"""
    WITH d AS (SELECT event_type, day, {mean('value')} AS accuracy FROM ({DAILY}) x GROUP BY event_type, day), b AS (SELECT event_type, day, accuracy, lag(accuracy) OVER (PARTITION BY event_type ORDER BY day) AS baseline FROM d)
    SELECT event_type, day, round(accuracy - baseline, 10) AS delta, coalesce(baseline - accuracy > 5, false) AS regressed FROM b""", "events")


@query("SELECT cause, count(*) AS n, count(DISTINCT user_id) AS n_questions FROM (SELECT user_id, unnest(list_filter([CASE WHEN value < 25 THEN 'coverage' END, CASE WHEN event_type = 'error' THEN 'citation' END, CASE WHEN value > 75 AND event_type <> 'view' THEN 'answer' END], lambda x: x IS NOT NULL)) AS cause FROM events) GROUP BY 1")
def v13_findings(spark, sf):
    """Events as results with up to three causes each, counted by cause."""
    causes = F.array_compact(F.array(F.when(F.col("value") < 25, "coverage"), F.when(F.col("event_type") == "error", "citation"), F.when((F.col("value") > 75) & (F.col("event_type") != "view"), "answer")))
    return checks.findings(table(spark, sf, "events"), causes, "user_id")


standard("v14_compare_runs", f"""
    WITH d AS ({DAILY}), a AS (SELECT user_id, round({mean('value')}, 10) AS m FROM d WHERE day < '2024-01-15' GROUP BY user_id), b AS (SELECT user_id, round({mean('value')}, 10) AS m FROM d WHERE day >= '2024-01-15' GROUP BY user_id)
    SELECT coalesce(a.user_id, b.user_id) AS question, round(b.m - a.m, 9) AS delta, CASE WHEN a.m IS NULL THEN 'only second' WHEN b.m IS NULL THEN 'only first' WHEN (a.m > 50) <> (b.m > 50) THEN 'flipped' ELSE 'same' END AS outcome FROM a FULL OUTER JOIN b ON a.user_id = b.user_id""", "events")


# Snapshots: orders, and the same with every fifth record changed, every eleventh refreshed, every seventh removed.
BASE = "SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS note FROM orders WHERE o_orderkey % 13 <> 0"
HEAD = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderstatus AS status, CASE WHEN o_orderkey % 11 = 0 THEN 'seen' ELSE o_orderpriority END AS note FROM orders WHERE o_orderkey % 7 <> 0"
HASH = "sha256('=' || id || chr(31) || '=' || CAST(round(price * 100) AS BIGINT) || chr(31) || '=' || status || chr(31) || '=' || note)"
CHANGE = f"""WITH a AS ({BASE}), b AS ({HEAD}), c AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.price <> b.price OR a.status <> b.status THEN 'modified' WHEN a.note <> b.note THEN 'refreshed' END AS change,
    CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a.note <> b.note THEN 'note' END, CASE WHEN a.price <> b.price THEN 'price' END, CASE WHEN a.status <> b.status THEN 'status' END], lambda x: x IS NOT NULL), ',') END AS changed_fields FROM a FULL JOIN b ON a.id = b.id)"""


def snapshots(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"))
    price, note = F.when(F.col("id") % 5 == 0, F.col("price") + 1).otherwise(F.col("price")), F.when(F.col("id") % 11 == 0, "seen").otherwise(F.col("note"))
    return rows.filter("id % 13 <> 0"), rows.filter("id % 7 <> 0").withColumns({"price": price, "note": note})


@query(CHANGE + " SELECT id, change, changed_fields FROM c WHERE change IS NOT NULL")
def x06_snapshot_diff(spark, sf):
    return snapshot.diff(*snapshots(spark, sf), "id", ["price", "status"], ["note"])


@query(CHANGE + " SELECT change, count(*) AS n FROM c WHERE change IS NOT NULL GROUP BY 1")
def x07_x08_delta_counts(spark, sf):
    return x06_snapshot_diff(spark, sf).groupBy("change").agg(F.count("*").alias("n"))


DIGEST = "SELECT status, sum(n)::BIGINT AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM (SELECT status, id % 256 AS b, count(*) AS n, sha256(string_agg({0}, chr(10) ORDER BY {0})) AS h FROM ({1}) GROUP BY 1, 2) GROUP BY 1"


def _hashed(rows):
    cents = rows.withColumn("price", F.round(F.col("price") * 100).cast("long"))
    return cents.select("id", "status", snapshot.record_hash(["id", "price", "status", "note"]).alias("hash"))


@query(DIGEST.format(HASH, BASE))
def x04_integrity(spark, sf):
    return snapshot.integrity(_hashed(snapshots(spark, sf)[0]), "status", "id", "hash")


@query(DIGEST.format(HASH, HEAD))
def x09_x10_x11_apply_delta(spark, sf):
    """The base with the delta applied; its digests are the head's."""
    base, head = snapshots(spark, sf)
    change = snapshot.diff(base, head, "id", ["price", "status"], ["note"])
    upserts = head.join(change.filter("change <> 'removed'").select("id"), "id", "left_semi")
    made = snapshot.apply_delta(base, upserts.select(*base.columns), change.filter("change = 'removed'"), "id")
    return snapshot.integrity(_hashed(made), "status", "id", "hash")


@query("""SELECT o_orderkey AS id, list_sort(list_distinct(list(l_suppkey))) AS source_ids, count(*) AS n_evidence, count(*) FILTER (WHERE l_returnflag = 'R') AS n_refuting, min(c_name) AS subject
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY 1""")
def x01_gather(spark, sf):
    """Items with their evidence gathered by item; an item's evidence is a bounded list."""
    rows = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    facts = rows.groupBy("o_orderkey", "o_custkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("source_ids"), F.count("*").alias("n_evidence"), F.count_if(F.col("l_returnflag") == "R").alias("n_refuting"))
    named = facts.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return named.select(F.col("o_orderkey").alias("id"), "source_ids", "n_evidence", "n_refuting", F.col("c_name").alias("subject"))


@query("""
    SELECT 'order without customer' AS problem, count(*) AS n FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_custkey IS NULL
    UNION ALL SELECT 'line without order', count(*) FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IS NULL
    UNION ALL SELECT 'final order without verified line', count(*) FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F') v ON v.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' AND v.l_orderkey IS NULL""")
def x02_export_gate(spark, sf):
    """Dangling references and unverified final items, counted by rule."""
    o, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    verified = lines.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return checks.gate({
        "order without customer": o.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left_anti"),
        "line without order": lines.join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"),
        "final order without verified line": o.filter("o_orderstatus = 'F'").join(verified, "o_orderkey", "left_anti"),
    })


@query("""SELECT p_partkey AS part_id, '{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}' AS line FROM part""")
def x03_canonical_json(spark, sf):
    part = table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("part_id"), F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), {"ignoreNullFields": "false"}).alias("line"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders")
def x05_utc_stamp(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'historical' WHEN len(r) > 0 THEN 'caution' ELSE 'cite' END AS usage, array_to_string(r, ',') AS reasons
    FROM (SELECT *, list_filter([CASE WHEN o_orderstatus = 'P' THEN 'stale' END, CASE WHEN o_totalprice > 400000 THEN 'conflicted' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'flagged' END], lambda x: x IS NOT NULL) AS r FROM orders)""")
def x13_usage(spark, sf):
    o = table(spark, sf, "orders")
    reasons = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "P", "stale"), F.when(F.col("o_totalprice") > 400000, "conflicted"), F.when(F.col("o_orderpriority").startswith("5"), "flagged")))
    use = F.when((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1"), "historical").when(F.size(reasons) > 0, "caution").otherwise("cite")
    return o.select("o_orderkey", use.alias("usage"), F.array_join(reasons, ",").alias("reasons"))


standard("x15_l07_index_rollup", "SELECT p_type AS topic, p_brand AS subject, count(*) AS n, CAST(grouping(p_type) + grouping(p_brand) AS INT) AS depth FROM {part} GROUP BY ROLLUP (p_type, p_brand)", "part")
standard("x17_status_counts", "SELECT o_orderstatus AS status, count(*) AS n, max(o_orderkey) AS latest FROM {orders} GROUP BY o_orderstatus", "orders")
standard("x19_citation_lines", "SELECT l_orderkey AS item, l_suppkey AS source, min(l_linenumber) AS first_line, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_suppkey", "lineitem")

# Operations over the event table: event types as job types, users as runs, props.k as a number of attempts or priority.


def jobs(spark, sf):
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


JOBS = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


@query(f"SELECT user_id, event_type, k, min(event_id) AS event_id, count(*) - 1 AS n_repeats FROM {JOBS} GROUP BY 1, 2, 3")
def o01_idempotent_enqueue(spark, sf):
    return jobs(spark, sf).groupBy("user_id", "event_type", "k").agg(F.min("event_id").alias("event_id"), (F.count("*") - 1).alias("n_repeats"))


@query(f"SELECT user_id, arg_min(event_id, (k, event_id)) AS event_id FROM {JOBS} GROUP BY 1")
def o02_claim_next(spark, sf):
    """Each run's next job: lowest priority number, then oldest."""
    return jobs(spark, sf).groupBy("user_id").agg(F.min_by("event_id", F.struct("k", "event_id")).alias("event_id"))


@query(f"SELECT event_id, CASE WHEN k % 5 >= 3 THEN 'DEAD' ELSE 'QUEUED' END AS status, CASE WHEN k % 5 < 3 THEN CAST(30 * 2 ** (k % 5) AS INT) END AS delay_s FROM {JOBS} WHERE event_type = 'error'")
def o03_o05_backoff(spark, sf):
    failed = jobs(spark, sf).filter("event_type = 'error'")
    dead = F.col("k") % 5 >= 3
    return failed.select("event_id", F.when(dead, "DEAD").otherwise("QUEUED").alias("status"), F.when(~dead, (30 * F.pow(F.lit(2), F.col("k") % 5)).cast("int")).alias("delay_s"))


standard("o04_requeue_stuck", "SELECT event_id FROM {events} WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '60' MINUTE AND value > 90", "events")


@query("SELECT user_id AS run, event_type, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(*) AS n_done, count(*) FILTER (WHERE value > 95) AS n_dead FROM events GROUP BY user_id, event_type HAVING count(*) FILTER (WHERE value < 0.2) = 0")
def o06_finalize_runs(spark, sf):
    """Users as runs: those kinds of jobs of which none is unfinished."""
    return lifecycle.finalized(table(spark, sf, "events"), "user_id", "event_type", F.col("value"), F.col("value") < 0.2, F.col("value") > 95)


@query(f"SELECT event_id, user_id, k, CAST(120 * 2 ** (k % 5 - 1) AS INT) AS delay_s FROM {JOBS} WHERE event_type = 'error' AND k % 5 BETWEEN 1 AND 3")
def o07_partial_retry(spark, sf):
    """Errors as failed sections, k modulo 5 as their attempts."""
    rows = jobs(spark, sf).filter("k % 5 >= 1").select("event_id", "user_id", "event_type", "k")
    return lifecycle.retries(rows, F.col("k") % 5, F.col("event_type") == "error").select("event_id", "user_id", "k", "delay_s")


standard("o08_queue_health", f"SELECT event_type, count(*) AS n, round({mean('value')}, 10) AS mean_value, max(value) AS max_value, min(ts) AS oldest FROM {{events}} WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY event_type", "events")


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (WHERE value > 90) AS failures FROM events GROUP BY 1")
def o09_latency(spark, sf):
    """Exact 95th percentiles per purpose."""
    rows = table(spark, sf, "events")
    p95 = metrics.percentile(rows, "event_type", "value", 0.95).select("event_type", F.round("percentile", 6).alias("p95"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("failures")).join(p95, "event_type")


standard("o10_storage_totals", "SELECT lang AS domain, count(*) AS n_documents, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT source) AS n_sources FROM {documents} GROUP BY lang", "documents")
standard("o11_o13_schedule", """
    SELECT user_id, max(ts) + INTERVAL '1' DAY AS next_check, max(ts) + INTERVAL '1' DAY <= TIMESTAMP '2024-01-30 12:00:00' AS due FROM {events} GROUP BY user_id""", "events")
standard("o12_corpus_metrics", "SELECT d.lang, d.source, count(*) AS n, count(l.doc_id) AS n_labelled, CAST(sum(coalesce(l.toxic, 0)) AS BIGINT) AS n_toxic, CAST(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_good FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.lang, d.source", "documents", "labels")
standard("o14_falsification_sample", "SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id ORDER BY l.quality ASC NULLS FIRST, d.doc_id LIMIT 60) x ORDER BY doc_id DESC LIMIT 20", "documents", "labels")


@query(r"""WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host, split_part(url, '/', 4) AS q, page_id FROM pages)
    SELECT host, 15 * least(count(DISTINCT q) - 1, 3) + CASE WHEN min(page_id) < 3 THEN 10 WHEN min(page_id) < 50 THEN 5 ELSE 0 END + CASE WHEN bool_or(host LIKE '%.example.org') THEN 25 ELSE 0 END AS relevance, count(*) AS n_hits FROM h WHERE host NOT LIKE '%spam%' GROUP BY 1""")
def o17_discovery(spark, sf):
    """Hosts scored by distinct queries, best rank and preference; denied hosts are left out."""
    rows = table(spark, sf, "pages").select(X.bare_host("url").alias("host"), F.split_part("url", F.lit("/"), F.lit(4)).alias("q"), "page_id").filter(~F.col("host").contains("spam"))
    first = F.min("page_id")
    points = 15 * F.least(F.countDistinct("q") - 1, F.lit(3)) + F.when(first < 3, 10).when(first < 50, 5).otherwise(0) + F.when(F.bool_or(F.col("host").endswith(".example.org")), 25).otherwise(0)
    return rows.groupBy("host").agg(points.cast("long").alias("relevance"), F.count("*").alias("n_hits"))


standard("o18_extraction_backlog", "SELECT d.doc_id, d.source FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL", "documents", "labels")


@query(f"""WITH s AS (SELECT page_id, 'sha256:' || sha256({NORM.format("html")}) AS h FROM pages WHERE page_id % 3 <> 0), f AS (SELECT page_id, 'sha256:' || sha256({NORM.format("CASE WHEN page_id % 4 = 0 THEN substr(html, 2) ELSE html END")}) AS h, length(html) AS n FROM pages WHERE page_id % 5 <> 0)
    SELECT page_id, action, CASE WHEN action IN ('new', 'changed') THEN f_h ELSE s_h END AS hash, CASE WHEN action = 'changed' THEN s_h END AS previous_hash, CAST((s_h IS NOT NULL)::INT + (action IN ('new', 'changed'))::INT AS BIGINT) AS version
    FROM (SELECT coalesce(s.page_id, f.page_id) AS page_id, s.h AS s_h, f.h AS f_h, CASE WHEN f.h IS NULL THEN 'absent' WHEN n < 1200 THEN 'skipped' WHEN s.h IS NULL THEN 'new' WHEN s.h <> f.h THEN 'changed' ELSE 'confirmed' END AS action FROM s FULL JOIN f ON s.page_id = f.page_id)""")
def a04_crawl_upsert(spark, sf):
    """Two thirds of the pages as stored, a later crawl in which every fourth has changed and every fifth is missing."""
    pages = table(spark, sf, "pages")
    stored = pages.filter("page_id % 3 <> 0").select("page_id", X.content_hash("html").alias("hash"), F.lit(1).alias("version"))
    body = F.when(F.col("page_id") % 4 == 0, F.expr("substring(html, 2)")).otherwise(F.col("html"))
    fetched = pages.filter("page_id % 5 <> 0").select("page_id", X.content_hash(body).alias("hash"), F.length("html").alias("n_chars"))
    return store.crawl_upsert(stored, fetched, ["page_id"], 1200)


@query("SELECT page_id, 'web/' || substr(sha256(html), 1, 2) || '/' || sha256(html) || '.html' AS key FROM pages")
def a05_b12_raw_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", store.raw_key(F.col("html"), F.lit("web"), "html").alias("key"))


standard("l01_list_page", """
    SELECT o_orderkey, o_totalprice, o_orderdate FROM {orders} WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 100000 AND 300000 AND lower(o_orderpriority) LIKE '%high%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""", "orders")
standard("l03_evidence_stats", "SELECT l_partkey AS item, count(*) AS n, count(DISTINCT l_suppkey) AS n_sources FROM {lineitem} GROUP BY l_partkey", "lineitem")
standard("l05_sources", "SELECT s.s_suppkey, s.s_acctbal AS authority, coalesce(n, 0) AS n_items FROM {supplier} s LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM {lineitem} GROUP BY l_suppkey) x ON x.l_suppkey = s.s_suppkey", "supplier", "lineitem")


@query("SELECT user_id AS run, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1")
def l06_l16_run_pivot(spark, sf):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run")).pivot("event_type", kinds).agg(F.count("event_id")).na.fill(0, kinds)


standard("l08_stats", f"""
    SELECT k.status, coalesce(n, 0) AS n, mean_price FROM (SELECT 'F' AS status UNION ALL SELECT 'O' UNION ALL SELECT 'P' UNION ALL SELECT 'X') k
    LEFT JOIN (SELECT o_orderstatus, count(*) AS n, round({mean('o_totalprice')}, 10) AS mean_price FROM {{orders}} GROUP BY o_orderstatus) o ON o.o_orderstatus = k.status""", "orders")


@query("""
    SELECT o.o_orderkey, min(g.low) AS class_id, min(g.n) - 1 AS n_partners FROM orders o JOIN (SELECT o_custkey, o_orderdate, min(o_orderkey) AS low, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1) g ON g.o_custkey = o.o_custkey AND g.o_orderdate = o.o_orderdate GROUP BY 1""")
def l09_l02_conflict_list(spark, sf):
    """Orders with others of the same customer and time against them: the first of them and how many."""
    key = ["o_custkey", "o_orderdate"]
    same = table(spark, sf, "orders").groupBy(*key).agg(F.min("o_orderkey").alias("class_id"), F.count("*").alias("n")).filter("n > 1")
    return table(spark, sf, "orders").join(same, key).select("o_orderkey", "class_id", (F.col("n") - 1).alias("n_partners"))


standard("l12_embedding_identity", "SELECT label AS model, count(*) AS n, count(*) FILTER (WHERE vec_id % 9 = 0) AS n_stale FROM {embeddings} GROUP BY label", "embeddings")
standard("l15_live_job_audit", "SELECT event_type, user_id, count(*) AS n FROM {events} WHERE value > 80 GROUP BY event_type, user_id HAVING count(*) > 3", "events")


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[(]', 0), lambda x: true)) = len(regexp_extract_all(text, '[)]', 0)) AS passed, CASE WHEN text LIKE '%(%' THEN 'checked' ELSE 'skipped' END AS outcome FROM documents")
def u01_u03_balance_validator(spark, sf):
    """A static validator: as many closing as opening brackets; recorded as skipped where it doesn't apply."""
    n = [F.regexp_count("text", F.lit(p)) for p in ("[(]", "[)]")]
    return table(spark, sf, "documents").select("doc_id", (n[0] == n[1]).alias("passed"), F.when(F.col("text").contains("("), "checked").otherwise("skipped").alias("outcome"))
