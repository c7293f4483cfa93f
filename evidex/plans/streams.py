"""Streams drained over what is there now, equal to batch queries over closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming import events as S
from .registry import query

LAST = "(SELECT max(ts) FROM events)"


@query(f"SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18, 2))), 2)::DOUBLE AS total FROM events GROUP BY CAST(ts AS DATE), 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= {LAST} - INTERVAL 1 DAY")
def s_daily_window(spark, sf):
    return S.drained(S.daily_totals(S.event_stream(spark, f"{sf}/events.parquet")))


@query("SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY 1, 2")
def s_dedup(spark, sf):
    rows = S.drained(S.first_of_each(S.event_stream(spark, f"{sf}/events.parquet"), ["user_id", "event_type"]))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {LAST} - INTERVAL 1 HOUR""")
def s_sessions(spark, sf):
    return S.drained(S.sessions(S.event_stream(spark, f"{sf}/events.parquet"), "user_id"))


CRAWLED = r"""SELECT page_id, html AS body, 0 AS crawl FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, CASE WHEN page_id % 4 = 0 THEN substr(html, 2) ELSE html END, 1 FROM pages WHERE page_id % 5 <> 0"""


@query(f"""
    WITH c AS (SELECT page_id, crawl, sha256(body) AS hash FROM ({CRAWLED}) WHERE length(body) >= 1200),
    a AS (SELECT page_id, max(CASE WHEN crawl = 0 THEN hash END) AS h0, max(CASE WHEN crawl = 1 THEN hash END) AS h1 FROM c GROUP BY page_id)
    SELECT page_id, coalesce(h1, h0) AS hash, CAST(CASE WHEN h0 IS NULL OR h1 IS NULL OR h0 = h1 THEN 1 ELSE 2 END AS BIGINT) AS version FROM a""")
def a04_upsert_stream(spark, sf):
    """Two crawls of the pages as a stream of two batches, merged into a table of files; the second comes twice."""
    import uuid

    from ..session import staging, table
    from ..sources import store
    from ..streaming import upserts

    pages = table(spark, sf, "pages")
    body = F.when(F.col("page_id") % 4 == 0, F.expr("substring(html, 2)")).otherwise(F.col("html"))
    crawls = [pages.filter("page_id % 3 <> 0").select("page_id", F.col("html").alias("body")), pages.filter("page_id % 5 <> 0").select("page_id", body.alias("body"))]
    folder = f"{staging(spark)}/upserts-{uuid.uuid4().hex}"
    kind = T.StructType([pages.schema["page_id"], T.StructField("hash", T.StringType()), T.StructField("version", T.LongType())])
    held = upserts.Table(spark, f"{folder}/table", kind, ["page_id"], 16)

    def merge(stored, rows):
        fetched = rows.select("page_id", F.sha2("body", 256).alias("hash"), F.length("body").alias("n_chars"))
        return store.crawl_upsert(stored, fetched, ["page_id"], 1200).filter("hash IS NOT NULL").select("page_id", "hash", "version")

    for n, crawl in enumerate([*crawls, crawls[1]]):
        if n < 2:
            crawl.write.mode("append").parquet(f"{folder}/crawled")
            stream = spark.readStream.schema(crawl.schema).parquet(f"{folder}/crawled")
            upserts.upserted(stream, held, merge, f"{folder}/checkpoint")
        else:
            held.upsert(crawl, merge, 1)
    return held.read()


@query(f"""
    WITH e AS (SELECT user_id AS job, ts, event_id, CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'fail' END AS kind FROM events),
    n AS (SELECT *, count(*) FILTER (WHERE kind = 'done') OVER w AS epoch, lead(ts) OVER w AS next FROM e WINDOW w AS (PARTITION BY job ORDER BY ts, event_id)),
    a AS (SELECT *, count(*) FILTER (WHERE kind = 'fail') OVER (PARTITION BY job, epoch ORDER BY ts, event_id) AS attempts FROM n)
    SELECT job, ts AS at, CASE WHEN attempts >= 3 THEN 'DEAD' ELSE 'QUEUED' END AS status, CAST(attempts AS INT) AS attempts, CASE WHEN attempts < 3 THEN CAST(30 * 2 ** (attempts - 1) AS INT) END AS delay_s FROM a WHERE kind = 'fail'
    UNION ALL SELECT job, ts + INTERVAL 1 HOUR, 'STUCK', CAST(attempts AS INT), NULL FROM a WHERE kind = 'start' AND (next > ts + INTERVAL 1 HOUR OR (next IS NULL AND ts + INTERVAL 1 HOUR <= {LAST} - INTERVAL 1 HOUR))""")
def o03_o04_queue_stream(spark, sf):
    """Users as jobs: clicks start them, errors fail them, purchases finish them; their transitions by a stateful stream."""
    from ..streaming import queue

    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail")
    events = S.event_stream(spark, f"{sf}/events.parquet").withColumn("kind", kind)
    before = spark.conf.get(queue.STORE[0], None)
    spark.conf.set(*queue.STORE)
    try:
        found = S.drained(queue.transitions(events, "user_id", "ts", "kind", "event_id"))
    finally:
        if before is None:
            spark.conf.unset(queue.STORE[0])
        else:
            spark.conf.set(queue.STORE[0], before)
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))
