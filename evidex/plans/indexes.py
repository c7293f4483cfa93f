"""Queries over structures of their own: prefix index, positions, cells, bands, rounds in time, as-of joins, automata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import automaton, prefixes, proximity, quality, schema, temporal, vectors
from ..session import staged, table
from .registry import query
from .retrieval import WORDS
from .text import HOST, NORM, PATH

KEY = rf"CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower({HOST.format('url')} || regexp_replace({PATH.format('url')}, '/+$', '')) ELSE lower(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '')) END"


@query(f"""
    WITH s AS (SELECT CASE WHEN page_id % 3 = 2 THEN (page_id + 1) % 40 ELSE page_id % 40 END AS question, CASE page_id % 3 WHEN 0 THEN left(url, CAST(12 + page_id % 30 AS INT)) WHEN 1 THEN url || '/deeper' ELSE url END AS url FROM pages WHERE page_id % 40 < 36),
    k AS (SELECT question, {KEY} AS key FROM s), r AS (SELECT DISTINCT page_id % 40 AS question, {KEY} AS key FROM pages),
    f AS (SELECT k.question, count(*) AS n_sources, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM r WHERE r.question = k.question AND (starts_with(r.key, k.key) OR starts_with(k.key, r.key)))) AS n_found FROM k GROUP BY 1)
    SELECT q.question, coalesce(n_sources, 0) AS n_sources, coalesce(n_found, 0) AS n_found, round(n_found / CAST(n_sources AS DOUBLE), 6) AS value, coalesce(n_found > 0, true) AS ok
    FROM (SELECT DISTINCT page_id % 40 AS question FROM pages) q LEFT JOIN f ON f.question = q.question""")
def v05_authoritative_recall(spark, sf):
    """Pages dealt to questions as what they retrieved; addresses cut short, gone deeper, or of another question's pages are
    what the questions name as authoritative. Questions from 36 on name none."""
    pages = table(spark, sf, "pages")
    question = (F.col("page_id") % 40).alias("question")
    third = F.col("page_id") % 3
    named = F.when(third == 0, F.expr("left(url, CAST(12 + page_id % 30 AS INT))")).when(third == 1, F.concat("url", F.lit("/deeper"))).otherwise(F.col("url"))
    sources = pages.filter("page_id % 40 < 36").select(F.when(third == 2, (F.col("page_id") + 1) % 40).otherwise(F.col("page_id") % 40).alias("question"), named.alias("url"))
    found = prefixes.authoritative_recall(pages.select(question).distinct(), sources, pages.select(question, "url"), "question", "url")
    return found.withColumn("value", F.round("value", 6))


@query(f"""
    WITH w AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), p AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS pos, len(w) AS n FROM w),
    t AS (SELECT DISTINCT item_id AS query, unnest({WORDS}) AS term FROM benchmark), df AS (SELECT term, count(DISTINCT id) AS df FROM p GROUP BY 1),
    r AS (SELECT query, term FROM (SELECT query, term, row_number() OVER (PARTITION BY query ORDER BY df, term) AS r FROM t JOIN df USING (term)) WHERE r <= 2),
    h AS (SELECT query, id, term, pos, n, CASE WHEN pos <= 10 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS k FROM r JOIN p USING (term)),
    s AS (SELECT *, lag(term) OVER b AS term0, lag(pos) OVER b AS pos0, lag(k) OVER b AS k0 FROM h WINDOW b AS (PARTITION BY query, id ORDER BY pos)),
    z AS (SELECT query, id, count(*) AS n_covers, sum(2 / (1 / k0 + 1 / k) / (pos - pos0)) / ln(any_value(n) + 1) AS density FROM s WHERE term0 <> term GROUP BY 1, 2)
    SELECT query, id, n_covers, round(density, 6) AS density FROM z""")
def r21_cover_density(spark, sf):
    """Documents that hold both of a question's two rarest words, by the density of their covers; a document's first ten
    words weigh ten times the others."""
    words = X.words("text")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), words.alias("w"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(words)).alias("term"))
    posts = proximity.positional(docs, "id", [(F.slice("w", 1, 10), "A"), (F.slice("w", 11, 1 << 30), "D")])
    posts = staged(posts.join(F.broadcast(asked.select("term").distinct()) if asked.count() < 1_000_000 else asked.select("term").distinct(), "term", "left_semi"), "positions")
    df = posts.groupBy("term").agg(F.countDistinct("id").alias("df"))
    rarest = asked.join(df, "term").selectExpr("query", "term", "row_number() OVER (PARTITION BY query ORDER BY df, term) AS r").filter("r <= 2").select("query", "term")
    pairs = rarest.groupBy("query").agg(F.count("*").alias("n")).filter("n = 2").select("query")
    found = proximity.all_terms(rarest.join(pairs, "query"), posts)
    return found.select("query", "id", "n_covers", F.round("density", 6).alias("density"))


@query(f"""
    WITH w AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), p AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS pos, len(w) AS n FROM w),
    t AS (SELECT DISTINCT item_id AS query, unnest({WORDS}) AS term FROM benchmark),
    z AS (SELECT query, id, count(*) AS n_covers, round(sum(CASE WHEN pos <= 10 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END) / ln(any_value(n) + 1), 6) AS density FROM t JOIN p USING (term) GROUP BY 1, 2)
    SELECT query, id, n_covers, density, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY density DESC, id) AS rank FROM z) WHERE rank <= 20""")
def r21_any_term_density(spark, sf):
    """The first twenty documents by the density of any of a question's words."""
    from ..operators import retrieval as R

    words = X.words("text")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), words.alias("w"))
    asked = staged(table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(words).alias("term")).distinct(), "terms")
    hits = proximity.any_term_top(asked, docs, "id", [(F.slice("w", 1, 10), "A"), (F.slice("w", 11, 1 << 30), "D")], 20)
    return R.top(hits, "query", [F.desc("density"), F.col("id")], 20, "rank")


NEAREST = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings),
    p AS (SELECT q.vec_id AS query, i.vec_id AS id, round(1 - list_inner_product(q.e, i.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(i.e, i.e))), 6) AS distance FROM v q JOIN v i ON i.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM p)"""


def embedded(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(NEAREST + " SELECT query, id, distance, rank FROM t WHERE rank <= 10")
def r20_nearest_exact(spark, sf):
    """The ten nearest of all vectors for every twentieth, tile by tile."""
    v = embedded(spark, sf)
    return vectors.nearest(v.filter("id % 20 = 0").withColumnRenamed("id", "query"), v, 10, others_only=True)


@query()
def r20_nearest_by_cells(spark, sf):
    """The same through an inverted file: cells fitted on a bounded sample, every vector indexed, the nearest cells searched."""
    v = embedded(spark, sf)
    cells = vectors.fit_cells(v)
    indexed = staged(cells.of(v), "cells")
    return vectors.search_cells(v.filter("id % 20 = 0").withColumnRenamed("id", "query"), indexed, cells, 10, others_only=True)


BAG = "(unicode(x) * 31 + unicode(right(x, 1)) * 7 + length(x)) % 64"


@query(f"""
    WITH d AS (SELECT doc_id AS id, list_distinct({WORDS}) AS w, {WORDS}[1:2] AS o, [{BAG} FOR x IN {WORDS}] AS b FROM documents),
    v AS (SELECT id, w, o, list_transform(range(64), lambda k: len(list_filter(b, lambda y: y = k))::DOUBLE) AS e FROM d WHERE len(w) > 0),
    p AS (SELECT i.id AS a, j.id AS b FROM v i JOIN v j ON i.id < j.id AND round(1 - list_inner_product(i.e, j.e) / (sqrt(list_inner_product(i.e, i.e)) * sqrt(list_inner_product(j.e, j.e))), 9) <= 0.06
        AND least(len(i.w), len(j.w)) >= 0.6 * greatest(len(i.w), len(j.w))
        AND len(list_intersect(i.w, j.w)) / (len(i.w) + len(j.w) - len(list_intersect(i.w, j.w)))::DOUBLE >= 0.6
        AND len(list_filter(i.o, lambda x: NOT list_contains(j.w, x))) = 0 AND len(list_filter(j.o, lambda x: NOT list_contains(i.w, x))) = 0),
    l AS (SELECT id, count(*) AS n_links FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY 1)
    SELECT d.id, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN l ON l.id = d.id""")
def d05_duplicate_links(spark, sf):
    """How many near duplicates each document has among all others, by a vector of its words and the guards on its text."""
    return classes(spark, sf).select("id", "n_links")


@query()
def d05_duplicate_classes(spark, sf):
    """The class of near duplicates of every document, without a subject to meet by (components are beyond plain SQL)."""
    return classes(spark, sf)


def classes(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.words("text").alias("words"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in (batch.slice(k, 1000) for batch in batches for k in range(0, batch.num_rows, 1000)):
            lists, n = part.column("words"), part.num_rows
            flat = lists.flatten().cast(pa.large_string())
            at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
            data = np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) else np.zeros(0, np.uint8)
            first, last = data[at[:-1]].astype(np.int64), data[at[1:] - 1].astype(np.int64)
            row = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            counts = np.bincount(row * 64 + (first * 31 + last * 7 + np.diff(at)) % 64, minlength=n * 64).astype(float)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(counts))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists, vector], ["id", "words", "vector"])

    bags = docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, words array<string>, vector array<double>")
    return vectors.duplicate_classes(bags.select("id", "vector", "words", F.slice("words", 1, 2).alias("object")))


@query(rf"""
    WITH RECURSIVE d AS (SELECT doc_id AS id, source, sha256({NORM.format('text')}) AS c, nullif(regexp_replace(lower(text), '[^0-9a-z]+', '', 'g'), '') AS l,
        'doc:' || doc_id AS url, CASE doc_id % 10 WHEN 3 THEN 'doc:' || (doc_id // 2) WHEN 4 THEN 'doc:' || (doc_id - 1) WHEN 5 THEN 'doc:' || (doc_id + 1) WHEN 6 THEN 'doc:none' END AS canonical FROM documents),
    n AS (SELECT *, row_number() OVER (ORDER BY id) AS k, list(id) OVER (PARTITION BY c ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cs, CASE WHEN l IS NOT NULL THEN list(id) OVER (PARTITION BY l ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS ls FROM d),
    m AS (SELECT n.*, o.id AS u FROM n LEFT JOIN d o ON o.url = n.canonical AND o.id < n.id),
    r(k, mirrors, id, target, signal, source) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR
      UNION ALL SELECT x.k, CASE WHEN y.source <> x.source THEN list_append(x.mirrors, x.id) ELSE x.mirrors END, x.id, y.id, x.signal, x.source
      FROM (SELECT m.k, m.id, m.source, r.mirrors, coalesce(list_filter(cs, lambda z: NOT list_contains(r.mirrors, z))[1], list_filter(ls, lambda z: NOT list_contains(r.mirrors, z))[1], CASE WHEN NOT list_contains(r.mirrors, u) THEN u END) AS target,
          CASE WHEN list_filter(cs, lambda z: NOT list_contains(r.mirrors, z))[1] IS NOT NULL THEN 'content' WHEN list_filter(ls, lambda z: NOT list_contains(r.mirrors, z))[1] IS NOT NULL THEN 'loose' ELSE 'canonical' END AS signal
        FROM r JOIN m ON m.k = r.k + 1) x LEFT JOIN d y ON y.id = x.target)
    SELECT r.id, target AS mirror_of, signal FROM r JOIN d y ON y.id = target WHERE y.source <> r.source""")
def d07_mirror_rounds(spark, sf):
    """Mirrors by content, loose text or declared canonical address, originals being no mirrors themselves; some documents
    declare another's address, a later one's, or one that nobody has."""
    docs = table(spark, sf, "documents")
    k = F.col("doc_id") % 10
    other = F.when(k == 3, F.expr("doc_id div 2")).when(k == 4, F.col("doc_id") - 1).when(k == 5, F.col("doc_id") + 1)
    canonical = F.when(k == 6, "doc:none").otherwise(F.concat(F.lit("doc:"), other.cast("string")))
    rows = docs.select(F.col("doc_id").alias("id"), "source", X.content_hash("text").alias("content"), X.fingerprint("text").alias("loose"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), canonical.alias("canonical_url"))
    return quality.linked_mirrors(rows, "id", "source", ["content", "loose"], "url", "canonical_url")


def typed(spark, sf, kind: str, *columns):
    return table(spark, sf, "events").filter(F.col("event_type") == kind).select(*columns)


@query("""
    SELECT e.event_id, a.event_id AS purchase_id, round(a.value, 2) AS purchase FROM (SELECT * FROM events WHERE event_type = 'error') e
    LEFT JOIN LATERAL (SELECT event_id, value FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) a ON true""")
def v12_baseline_as_of(spark, sf):
    """The user's last purchase before each error: the value that held when the error came."""
    errors = typed(spark, sf, "error", "event_id", "user_id", "ts")
    purchases = typed(spark, sf, "purchase", F.col("event_id").alias("purchase_id"), F.round("value", 2).alias("purchase"), "user_id", "ts")
    return temporal.as_of(errors, purchases, ["user_id"], "ts", ["purchase_id", "purchase"], "purchase_id").select("event_id", "purchase_id", "purchase")


@query("""
    WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM orders)
    SELECT r.o_orderkey, a.o_orderkey AS last_run, CAST(date_diff('day', a.o_orderdate, r.o_orderdate) AS BIGINT) AS days FROM r
    LEFT JOIN LATERAL (SELECT o_orderkey, o_orderdate FROM r p WHERE p.o_custkey = r.o_custkey AND p.o_orderdate < r.o_orderdate ORDER BY p.o_orderdate DESC, p.o_orderkey DESC LIMIT 1) a ON true""")
def o13_last_run_as_of(spark, sf):
    """The customer's last order before each order, and the days since: orders as runs of a schedule."""
    runs = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    history = runs.select(F.col("o_orderkey").alias("last_run"), F.col("o_orderdate").alias("last_date"), "o_custkey", "o_orderdate")
    found = temporal.as_of(runs, history, ["o_custkey"], "o_orderdate", ["last_run", "last_date"], "last_run", bucket_seconds=365 * 86_400, strict=True)
    return found.select("o_orderkey", "last_run", F.datediff(F.col("o_orderdate").cast("date"), F.col("last_date").cast("date")).cast("long").alias("days"))


@query("""
    SELECT e.event_id, a.event_id AS ready_id FROM (SELECT * FROM events WHERE event_type = 'view') e
    LEFT JOIN LATERAL (SELECT event_id FROM events p WHERE p.event_type = 'signup' AND p.ts <= e.ts ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) a ON true""")
def x17_latest_ready_as_of(spark, sf):
    """The last signup of anyone at each view, as the snapshot that was ready then: one key, so time alone deals the rows."""
    views, ready = typed(spark, sf, "view", "event_id", "ts"), typed(spark, sf, "signup", F.col("event_id").alias("ready_id"), "ts")
    one = F.lit(1).alias("base")
    return temporal.as_of(views.select("*", one), ready.select("*", one), ["base"], "ts", ["ready_id"], "ready_id", bucket_seconds=3600).select("event_id", "ready_id")


@query("""
    SELECT l.l_orderkey, l.l_linenumber, coalesce(a.l_returnflag = 'R', false) AS pointless FROM lineitem l
    LEFT JOIN LATERAL (SELECT l_returnflag FROM lineitem p WHERE p.l_partkey = l.l_partkey AND p.l_shipdate < l.l_shipdate ORDER BY p.l_shipdate DESC, p.l_orderkey DESC, p.l_linenumber DESC LIMIT 1) a ON true""")
def g15_last_outcome_as_of(spark, sf):
    """Whether a part's shipment before each one was returned: a revalidation whose last outcome says it is pointless."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag")
    history = lines.select("l_partkey", "l_shipdate", F.col("l_returnflag").alias("last_flag"), F.struct("l_orderkey", "l_linenumber").alias("nth"))
    found = temporal.as_of(lines, history, ["l_partkey"], "l_shipdate", ["last_flag"], "nth", bucket_seconds=365 * 86_400, strict=True)
    return found.select("l_orderkey", "l_linenumber", F.coalesce(F.col("last_flag") == "R", F.lit(False)).alias("pointless"))


@query("""
    WITH p AS (SELECT DISTINCT p_name AS phrase FROM part UNION SELECT DISTINCT string_split(text, ' ')[1] FROM benchmark UNION SELECT DISTINCT array_to_string(string_split(text, ' ')[1:3], ' ') FROM benchmark)
    SELECT phrase, doc_id, CAST(strpos(text, phrase) - 1 AS BIGINT) AS first FROM p JOIN documents ON contains(text, phrase) WHERE phrase <> ''""")
def p04_phrase_mentions(spark, sf):
    """Where part names and the beginnings of benchmark texts first occur in documents, by one automaton."""
    first = F.split("text", " ")
    bench = table(spark, sf, "benchmark")
    asked = table(spark, sf, "part").select(F.col("p_name").alias("phrase")).union(bench.select(first[0])).union(bench.select(F.array_join(F.slice(first, 1, 3), " "))).distinct()
    return automaton.found(table(spark, sf, "documents"), "doc_id", "text", asked.withColumn("phrase_id", F.col("phrase")), "phrase_id", "phrase").select(F.col("phrase_id").alias("phrase"), "doc_id", "first")


EVENT_SCHEMA = {
    "type": "object",
    "required": ["id", "kind", "props"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer"},
        "kind": {"enum": ["click", "view", "error", "signup"]},
        "value": {"type": "number", "minimum": 0, "maximum": 90},
        "props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 80}}},
        "tags": {"type": "array", "items": {"type": "string"}},
        "note": {"anyOf": [{"type": "string", "pattern": "^ok"}, {"type": "null"}]},
    },
}


@query("""
    WITH e AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 17 = 0 AS broken FROM events),
    p AS (SELECT event_id, broken, [CASE WHEN event_type NOT IN ('click', 'view', 'error', 'signup') THEN 'kind: is not one of click, view, error, signup' END,
        CASE WHEN event_id % 5 = 0 THEN 'value: is not of type number' WHEN value > 90 THEN 'value: is above 90' WHEN value < 0 THEN 'value: is below 0' END,
        CASE WHEN event_id % 7 = 0 THEN 'props: is missing' WHEN k IS NULL THEN 'props.k: is missing' WHEN k > 80 THEN 'props.k: is above 80' END,
        CASE WHEN event_id % 11 = 0 THEN 'tags[1]: is not of type string' END, CASE WHEN event_id % 13 = 0 THEN 'more: is not declared' END, CASE WHEN event_id % 3 = 1 AND event_id % 19 = 0 THEN 'note: is none of what is allowed' END] AS found FROM e),
    r AS (SELECT event_id, broken, unnest(CASE WHEN broken THEN [': is not valid JSON'] ELSE list_filter(found, lambda x: x IS NOT NULL) END) AS x FROM p)
    SELECT event_id, CASE WHEN NOT broken THEN CAST(event_id AS VARCHAR) END AS record, split_part(x, ': ', 1) AS field, split_part(x, ': ', 2) AS problem FROM r""")
def x12_schema_problems(spark, sf):
    """Events as JSON lines, some of them broken in one way or another, held against a declared schema."""
    id = F.col("event_id")
    text = F.concat(
        F.lit('{"id":'), id, F.lit(',"kind":"'), "event_type", F.lit('","value":'), F.when(id % 5 == 0, '"high"').otherwise(F.col("value").cast("string")), F.when(id % 7 == 0, "").otherwise(F.concat(F.lit(',"props":'), "props")),
        F.lit(',"tags":["a",'), F.when(id % 11 == 0, "5").otherwise('"b"'), F.lit('],"note":'), F.when(id % 3 == 0, "null").when((id % 3 == 1) & (id % 19 == 0), '"bad"').otherwise('"ok"'), F.when(id % 13 == 0, ',"more":1').otherwise(""), F.lit("}"))
    lines = table(spark, sf, "events").select("event_id", F.when(id % 17 == 0, "{not json").otherwise(text).alias("line"))
    return schema.problems(lines, "line", EVENT_SCHEMA, ["event_id"])
