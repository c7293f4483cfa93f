"""Text and URL queries: normalization, hashes, links, sections, quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quotes
from ..functions import text as X
from ..functions.chunking import chunked
from ..operators import graph
from ..session import table
from .registry import query

NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
SCHEME, HOST, PATH, QUERY = (
    r"lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))",
    r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))",
    r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)",
    r"regexp_extract({0}, '^[^?#]*\?([^#]*)', 1)",
)
CANON = f"CASE WHEN {SCHEME} IN ('http', 'https') THEN {SCHEME} || '://' || {HOST} || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || CASE WHEN len([p FOR p IN string_split({QUERY}, '&') IF p <> '' AND NOT regexp_matches(p, '^(utm_.*|fbclid|gclid|ref)=')]) > 0 THEN '?' || array_to_string([p FOR p IN string_split({QUERY}, '&') IF p <> '' AND NOT regexp_matches(p, '^(utm_.*|fbclid|gclid|ref)=')], '&') ELSE '' END ELSE '' END"
STATEMENT = r"regexp_replace(lower(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^ | $', '', 'g')), '\.+$', '')"


@query(f"SELECT page_id, {CANON.format('url')} AS canonical FROM pages")
def b01_url_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.canonical_url("url").alias("canonical"))


@query(f"SELECT doc_id, length({NORM.format('text')}) AS n_chars, 'sha256:' || sha256({NORM.format('text')}) AS content_hash, CASE WHEN regexp_replace(lower(text), '[^0-9a-z]+', '', 'g') <> '' THEN sha256(regexp_replace(lower(text), '[^0-9a-z]+', '', 'g')) END AS fingerprint FROM documents")
def b02_b03_b04_text_hashes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.normalized("text").alias("normal"), X.fingerprint("text").alias("fingerprint"))  # normalized once
    return docs.select("doc_id", F.length("normal").cast("long").alias("n_chars"), F.concat(F.lit("sha256:"), F.sha2("normal", 256)).alias("content_hash"), "fingerprint")


@query(f"""
    WITH l AS (SELECT page_id, host, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1), 1) - 1 AS pos FROM (SELECT page_id, html, {SCHEME.format('url')} || '://' || {HOST.format('url')} AS host FROM pages)),
    a AS (SELECT page_id, pos, CASE WHEN href LIKE '/%' THEN host || href ELSE href END AS u FROM l)
    SELECT page_id, {CANON.format('u')} AS link, CAST(min(pos) AS BIGINT) AS first_pos FROM a WHERE {CANON.format('u')} <> '' GROUP BY ALL""")
def b06_link_explode(spark, sf):
    pages = table(spark, sf, "pages")
    base = F.concat(X.scheme("url"), F.lit("://"), X.host("url"))
    links = pages.select("page_id", base.alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    full = links.select("page_id", "pos", F.when(F.col("href").startswith("/"), F.concat("base", "href")).otherwise(F.col("href")).alias("u"))
    return full.select("page_id", "pos", X.canonical_url("u").alias("link")).filter("link <> ''").groupBy("page_id", "link").agg(F.min("pos").cast("long").alias("first_pos"))


DROPPED = "html"
for _tag in X.DROPPED:
    DROPPED = f"regexp_replace({DROPPED}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', ' ', 'g')"
ARTICLE = rf"coalesce(nullif(regexp_extract({DROPPED}, '(?is)<article\b[^>]*>(.*)</article\s*>', 1), ''), nullif(regexp_extract({DROPPED}, '(?is)<body\b[^>]*>(.*)</body\s*>', 1), ''), {DROPPED})"
BARE = rf"regexp_replace(regexp_replace(regexp_replace({ARTICLE}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(?:{'|'.join(X.BLOCKS)})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _name, _char in X.REFERENCES.items():
    BARE = f"replace({BARE}, '&{_name};', '{_char}')"
MAIN = rf"trim(regexp_replace(regexp_replace(regexp_replace({BARE}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g'))"


@query(rf"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title, coalesce(nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), ''), 'en') AS lang, nullif(regexp_extract(html, '<time[^>]*datetime="([^"]*)"', 1), '') AS published, sha256({MAIN}) AS text_hash, CAST(length({MAIN}) AS BIGINT) AS n_chars FROM pages""")
def b07_page_metadata(spark, sf):
    """Title, language, date and main text of pages."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " "))
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    date = F.regexp_extract("html", '<time[^>]*datetime="([^"]*)"', 1)
    rows = table(spark, sf, "pages").select("page_id", title.alias("title"), F.when(lang == "", "en").otherwise(lang).alias("lang"), F.when(date != "", date).alias("published"), X.main_text("html").alias("body"))
    return rows.select("page_id", "title", "lang", "published", F.sha2("body", 256).alias("text_hash"), F.length("body").cast("long").alias("n_chars"))


@query(f"SELECT page_id, {HOST.format('url')} AS host, NOT regexp_matches(url, '[?&]page=') AND starts_with({PATH.format('url')}, '/en/') AS accepted FROM pages")
def b10_url_scope(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", X.host("url").alias("host"), X.in_scope("url", X.host("url"), "[?&]page=", None, "/en/").alias("accepted"))


@query(f"SELECT doc_id, 'sha256:' || sha256({STATEMENT.format('text')}) AS statement_hash FROM documents")
def b11_statement_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2(X.statement("text"), 256)).alias("statement_hash"))


@query(f"SELECT lower({HOST.format('url')} || regexp_replace({PATH.format('url')}, '/+$', '')) AS url_key, count(*) AS n_pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def b13_url_key(spark, sf):
    return table(spark, sf, "pages").groupBy(X.url_key("url").alias("url_key")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query(rf"""SELECT regexp_replace({HOST.format('url')}, '^www\.', '') AS host, count(*) AS n_pages,
    bool_or(regexp_replace({HOST.format('url')}, '^www\.', '') = 'example.org' OR regexp_replace({HOST.format('url')}, '^www\.', '') LIKE '%.example.org') AS preferred FROM pages GROUP BY 1""")
def b14_host_rollup(spark, sf):
    host = X.bare_host("url")
    return table(spark, sf, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n_pages"), F.bool_or(X.under(host, ["example.org"])).alias("preferred"))


@query(r"""SELECT part_id, core, negated FROM (SELECT p_partkey AS part_id, 'does not ' || lower(p_type) AS p FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, lower(p_type) || 's' FROM part WHERE p_partkey % 2 = 1),
    LATERAL (SELECT starts_with(p, 'does not ') AS negated), LATERAL (SELECT regexp_replace(p, '^does not ', '') AS r), LATERAL (SELECT regexp_extract(r, '^(\S*)', 1) AS f), LATERAL (SELECT substr(r, length(f) + 1) AS tail),
    LATERAL (SELECT CASE WHEN length(f) > 4 AND regexp_matches(f, '(ies|ied)$') THEN left(f, length(f) - 3) || 'y' WHEN length(f) > 4 AND regexp_matches(f, '(sses|shes|ches|xes|zes)$') THEN left(f, length(f) - 2) WHEN length(f) > 4 AND regexp_matches(f, '[^s]s$') THEN left(f, length(f) - 1) WHEN length(f) > 4 AND regexp_matches(f, 'ed$') THEN left(f, length(f) - 2) ELSE f END || tail AS core)""")
def g01_predicate_core(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("does not "), F.lower("p_type"))).otherwise(F.concat(F.lower("p_type"), F.lit("s"))).alias("p"))
    core, negated = X.predicate_core("p")
    return part.select(F.col("p_partkey").alias("part_id"), core.alias("core"), negated.alias("negated"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


def lines(spark, sf):
    """Each line as a section."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(rf"SELECT doc_id, CAST(pos AS BIGINT) AS pos, sha256('line ' || pos || chr(10) || trim(regexp_replace(line, '\s+', ' ', 'g'))) AS section_hash FROM ({LINES}) WHERE trim(line) <> ''")
def c04_section_hash(spark, sf):
    rows = lines(spark, sf).filter(F.trim("line") != "")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha2(F.concat(F.lit("line "), "pos", F.lit("\n"), F.trim(F.regexp_replace("line", r"\s+", " "))), 256).alias("section_hash"))


@query("SELECT doc_id, len(l) = 0 OR (len(l) >= 8 AND len([x FOR x IN l IF length(trim(x)) < 40]) > 0.8 * len(l)) AS boilerplate FROM (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS l FROM documents)")
def c05_boilerplate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.boilerplate("text").alias("boilerplate"))


@query()
def c01_c03_chunks(spark, sf):
    """Chunks of every document (a row function: heading stacks and greedy packing are beyond SQL)."""
    return chunked(table(spark, sf, "documents"), max_chars=2000).select("doc_id", "index", F.length("text").alias("n_chars"), "start", "end", "hash")


QUOTES = r"""
    forms AS (SELECT item_id, 0 AS form, trim(text) AS quote FROM benchmark WHERE trim(text) <> '' UNION ALL SELECT item_id, 1, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:8], ' ') FROM benchmark WHERE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) > 8),
    pat AS (SELECT item_id, form, quote, trim(regexp_replace(lower(quote), '\s+', ' ', 'g')) AS flat, '(?i)' || regexp_replace(regexp_escape(trim(regexp_replace(quote, '\s+', ' ', 'g'))), '(\\)? ', '\\s+', 'g') AS re FROM forms),
    met AS (SELECT item_id, form, quote, doc_id, text, re FROM pat JOIN documents ON contains(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), flat)),
    loc AS (SELECT item_id, doc_id, form, CASE WHEN form = 1 THEN 'head' WHEN contains(text, quote) THEN 'exact' ELSE 'tolerant' END AS name, CASE WHEN form = 0 AND contains(text, quote) THEN quote ELSE regexp_extract(text, re) END AS hit, text FROM met),
    best AS (SELECT item_id, doc_id, arg_min(name, form) AS form, arg_min(strpos(text, hit) - 1, form) AS start, arg_min(length(hit), form) AS n FROM loc WHERE hit <> '' GROUP BY 1, 2)"""


@query(f"WITH {QUOTES} SELECT item_id, doc_id, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS \"end\", form FROM best")
def c06_quote_location(spark, sf):
    """Benchmark passages in documents: exactly, with any case and white space, or by their first eight words; offsets are
    those of the document's own text."""
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return quotes.located(table(spark, sf, "documents"), passages).withColumnRenamed("quote_id", "item_id")


@query()
def c09_passages(spark, sf):
    """Windows around the mentions of a document's own first two words (a row function; tests hold it against a plain search)."""
    needles = F.array(F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))
    found = table(spark, sf, "documents").select("doc_id", quotes.passages("text", needles).alias("p"))
    return found.select("doc_id", F.size("p").alias("n"), F.transform("p", lambda x: F.length(x)).alias("lengths"), F.sha2(F.array_join("p", "\n"), 256).alias("digest"))


@query(f"""
    WITH d AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<link href="' || url || '?utm_a=1#x" rel="canonical">' || html WHEN 1 THEN '<meta content="' || url || '" property="og:url">' || html ELSE html END AS h, url FROM pages)
    SELECT page_id, nullif(CASE WHEN page_id % 3 = 2 THEN '' ELSE {CANON.format('url')} END, '') AS canonical FROM d""")
def b05_canonical_link(spark, sf):
    """The canonical link that two thirds of the pages are given, by a link or a meta element."""
    pages = table(spark, sf, "pages")
    link = F.concat(F.lit('<link href="'), "url", F.lit('?utm_a=1#x" rel="canonical">'), "html")
    meta = F.concat(F.lit('<meta content="'), "url", F.lit('" property="og:url">'), "html")
    return pages.select("page_id", X.canonical_link(F.when(F.col("page_id") % 3 == 0, link).when(F.col("page_id") % 3 == 1, meta).otherwise(F.col("html"))).alias("canonical"))


@query("SELECT page_id, CASE WHEN kind LIKE 'application/pdf%' OR regexp_matches(lower(path), '\\.pdf$') THEN 'pdf' ELSE 'html' END AS reader FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Application/PDF' ELSE 'text/html; charset=utf-8' END AS k, lower(k) AS kind, regexp_extract(url || CASE WHEN page_id % 7 = 0 THEN '.PDF' ELSE '' END, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)")
def b09_content_type(spark, sf):
    """Which reader a page wants, by its type and path."""
    kind = F.when(F.col("page_id") % 5 == 0, "Application/PDF").otherwise("text/html; charset=utf-8")
    url = F.concat("url", F.when(F.col("page_id") % 7 == 0, ".PDF").otherwise(""))
    return table(spark, sf, "pages").select("page_id", X.reader(kind, url).alias("reader"))


@query("""
    WITH a AS (SELECT o_orderkey AS id, (o_orderkey * 2654435761) % 4294967296 AS n FROM orders), q AS (SELECT id, n // 16777216 AS a, n // 65536 % 256 AS b, n // 256 % 256 AS c, n % 256 AS d FROM a)
    SELECT id, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR (a = 192 AND b = 88 AND c = 99)) AS public FROM q""")
def b16_address_class(spark, sf):
    """Addresses made from order numbers, spelt as numbers, in hexadecimal, or dotted: which ones may be fetched."""
    n = (F.col("o_orderkey") * 2654435761) % 4294967296
    dotted = F.concat_ws(".", *((F.floor(n / 256**k) % 256).cast("long").cast("string") for k in (3, 2, 1, 0)))
    spelt = F.when(F.col("o_orderkey") % 3 == 0, n.cast("string")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("0x"), F.hex(n))).otherwise(dotted)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.public_address(spelt).alias("public"))


LINKS = f"""link AS (SELECT DISTINCT page_id AS src, page_id * 2 + k AS dst FROM pages, (VALUES (0), (1)) v(k) WHERE page_id % 11 <> 3)"""


@query(f"""
    WITH RECURSIVE {LINKS}, ok AS (SELECT page_id FROM pages WHERE page_id % 13 <> 5), f AS (SELECT p.page_id AS seed, p.page_id, 0 AS depth FROM ok p WHERE p.page_id IN (1, 2) UNION SELECT f.seed, l.dst, f.depth + 1 FROM f JOIN link l ON l.src = f.page_id JOIN ok ON ok.page_id = l.dst WHERE f.depth < 6)
    SELECT seed, page_id, min(depth) AS depth FROM (SELECT seed, page_id, depth, row_number() OVER (PARTITION BY seed ORDER BY depth, page_id) AS n FROM (SELECT seed, page_id, min(depth) AS depth FROM f GROUP BY 1, 2)) WHERE n <= 40 GROUP BY 1, 2""")
def a03_frontier(spark, sf):
    """Pages that a crawl of two seeds visits, over links that page numbers make, within depth, scope and number."""
    pages = table(spark, sf, "pages").select("page_id")
    links = pages.filter("page_id % 11 <> 3").select(F.col("page_id").alias("src"), F.explode(F.array(F.col("page_id") * 2, F.col("page_id") * 2 + 1)).alias("dst"))
    scope = pages.filter("page_id % 13 <> 5")
    return graph.frontier(scope.filter("page_id IN (1, 2)"), links, scope, "page_id", 6, 40)


@query("SELECT p_partkey AS part_id, CAST(len(list_distinct([p_brand || ' ' || p_type || ' ' || p_name, p_brand || ' not ' || p_name, left(p_name, 200)])) AS BIGINT) AS n_queries, p_brand || ' not ' || p_name AS negated FROM part")
def c10_falsification_queries(spark, sf):
    made = F.array_distinct(F.array(F.concat_ws(" ", "p_brand", "p_type", "p_name"), F.concat_ws(" not ", "p_brand", "p_name"), F.left("p_name", F.lit(200))))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), F.size(made).cast("long").alias("n_queries"), made[1].alias("negated"))


@query(r"SELECT conv_id, turn, [regexp_replace(t, '^\.+|\.+$', '', 'g') FOR t IN regexp_extract_all(text, '([A-Za-z0-9][A-Za-z0-9_.+#-]*)', 1)] AS tokens FROM conversations")
def r01_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.tokens("text").alias("tokens"))


@query("""
    WITH t AS (SELECT DISTINCT lower(p_brand) AS b FROM part UNION SELECT DISTINCT 'multi' || lower(split_part(p_type, ' ', 1)) FROM part)
    SELECT b AS token, CASE WHEN contains(b, '-') THEN replace(b, '-', '') WHEN regexp_matches(b, '^(anti|bi|cross|multi|non|semi)[a-z]{6,}$') THEN regexp_replace(b, '^(anti|bi|cross|multi|non|semi)', '\\1-') END AS first_variant,
           CASE WHEN contains(b, '-') THEN replace(b, '-', ' ') WHEN regexp_matches(b, '^(anti|bi|cross|multi|non|semi)[a-z]{6,}$') THEN regexp_replace(b, '^(anti|bi|cross|multi|non|semi)', '\\1 ') END AS second_variant FROM t""".replace("\\\\", "\\"))
def r02_compounds(spark, sf):
    part = table(spark, sf, "part")
    t = part.select(F.lower("p_brand").alias("token")).union(part.select(F.concat(F.lit("multi"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))))).distinct()
    prefix = "^(anti|bi|cross|multi|non|semi)"

    def variant(mark: str):
        c = F.col("token")
        return F.when(c.contains("-"), F.replace(c, F.lit("-"), F.lit(mark.strip("-")))).when(c.rlike(prefix + "[a-z]{6,}$"), F.regexp_replace(c, prefix, f"$1{mark}"))

    return t.select("token", variant("-").alias("first_variant"), variant(" ").alias("second_variant"))
