"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, collocations, decontaminate, divergence, html_text, ngram_lm, packing, quality, sharding, simhash, toxicity, urls, warc
from .common import crc_mod

SHARD_BYTES = 16 << 20


def op1_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by host suffix arrays and page structure. Null pages are empty; ids may repeat."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labels outside the held-out third. Null texts score as empty ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    scored = model.scored(docs.select("doc_id", "text"), "text", "score")
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document. Null texts have no words and fail."""
    return quality.judged(table(spark, sf_dir, "documents"))


def op4_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document; a fifth is held out. Null texts are the end token alone."""
    return ngram_lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every url. Null urls have neither host nor path, and the prior decides."""
    return urls.judged(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back. Null pages are empty payloads."""
    pages = table(spark, sf_dir, "pages")
    back = warc.read(warc.write(pages))
    ids = [F.col(c).cast(pages.schema["page_id"].dataType).alias(c) for c in ("page_id", "refers_to")]
    return back.select(ids[0], "payload_bytes", "payload_digest", "record_type", ids[1])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover, with the longest matches. Null texts have no words."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, bench, ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "matches")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null texts have fingerprint zero and are linked like others."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_extendible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document under a limit of 16 MiB. Null texts have no bytes."""
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence. Null texts are the end token alone."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: the number of ids, and digests of ids and text. Null texts have no ids."""
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), packed=True)
    both = bpe.decode(ids)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's word use is from the other sources of its language, and the terms it uses more than the language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two or three words by how far their words go together."""
    return collocations.phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_host_suffix_array, op2_toxicity, op3_quality_mcd, op4_elias_fano, op5_urls, op6_warc, op7_decontaminate, op8_simhash, op9_extendible, op10_best_fit, op11_bpe, op12_divergence, op13_collocations)}
ORACLES: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS low FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN low < page_id THEN low END AS refers_to
        FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest""",
    "op12_divergence": """
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
        size AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
        g AS (SELECT d.lang, d.source, coalesce(any_value(total), 0) + 2 * coalesce(any_value(v), 0) AS total
              FROM d LEFT JOIN v ON v.lang = d.lang LEFT JOIN size ON size.lang = d.lang AND size.source = d.source GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // total AS p
              FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
        q AS (SELECT l.lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY l.lang) + 2 * v) AS q FROM l JOIN v ON v.lang = l.lang),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT p.lang, source, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
        UNION ALL
        SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS r FROM terms QUALIFY r <= 10""",
    "op13_collocations": """
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
        g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) AS sizes(k)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY ALL),
        c AS (SELECT lang, k AS words, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
        cuts AS (SELECT lang, words, phrase, w, a, unnest(range(1, words)) AS cut FROM c),
        parts AS (SELECT c.*, l.f AS l, r.f AS r, 1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS score FROM cuts c
                  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ')
                  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:words], ' ')),
        best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inner_ AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE words = 3),
        longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
        left_ AS (SELECT b.* FROM best b LEFT JOIN longest x ON x.lang = b.lang AND x.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM left_ JOIN n USING (lang) QUALIFY rank <= 2000""",
}
