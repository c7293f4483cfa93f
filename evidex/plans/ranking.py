"""Query analysis and ranking queries. Documents stand in as items, benchmark passages and users' turns as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ranking as K
from ..session import staged, table
from . import retrieval as P
from .registry import query

#: Openings that questions are given by number, so that intents, versions and identifiers occur.
OPENINGS = ["which ", "risks of ", "difference in ", "example of ", "syntax of ", "version 2.1 of ", "error in ", "not working: ", "how to ", "setting of ", "design of ", "what is ", "why ", ""]
TYPES = ["definition", "fact", "procedure", "limitation", "example"]
ROLES = ["foundation", "other", "dependent", "other", "example"]
#: A domain's own cues, tried first.
DECLARED = {"limitation": [r"\brisks?\b", r"^which la\b"]}
SOURCE_NUMBER = "coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS INT), 0)"


def picked(names: list[str], number):
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def questions(spark, sf):
    """Benchmark passages with an opening, every fifth with two identifiers."""
    tail = F.when(F.col("item_id") % 5 == 0, " CALCULATE RangeStart").otherwise("")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.concat(picked(OPENINGS, F.col("item_id")), F.coalesce("text", F.lit("")), tail).alias("text"))


def items(spark, sf):
    """Documents as items: the first one to three words are the subject, all else follows from id, source and labels."""
    id, source = F.col("doc_id"), F.expr(SOURCE_NUMBER)
    first = [F.regexp_extract(F.coalesce("text", F.lit("")), "^[^A-Za-z]*([A-Za-z]+)" + "[^A-Za-z]+([A-Za-z]+)" * k, k + 1) for k in range(3)]  # each reads no further than its word
    subject = F.array_join(F.filter(F.slice(F.array(*first), 1, (id % 3 + 1).cast("int")), lambda w: w != ""), " ")
    status = F.when(F.col("toxic") == 1, "CONFLICTED").when(F.col("quality") == 0, "STALE").when(F.col("quality").isNull(), "CANDIDATE").otherwise("VERIFIED")
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        id.alias("id"), subject.alias("subject"), F.col("text").alias("statement"), F.concat(F.lit("Area/"), subject).alias("topic"), picked(TYPES, id).alias("knowledge_type"), picked(ROLES, id).alias("role"),
        F.when(id % 5 == 3, "negative").otherwise("positive").alias("polarity"), (source * 4 + 10).alias("authority"), (id % 6).cast("int").alias("level"), (source % 5 == 0).alias("official"),
        F.when(id % 4 == 0, "2.1").when(id % 4 == 1, "3.0").alias("product_version"), status.alias("status"), (id % 11 == 0).alias("needs_review"), (id % 13 == 0).alias("needs_revalidation"), (id % 17 == 0).alias("validator_failed"),
        (1 / (1 + id % 50)).alias("confidence"))


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


def _plain(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '\s+', ' ', 'g'))"


def _bounded(cue: str) -> str:
    """A cue whose word bounds know letters beyond ASCII: they stand at its ends alone."""
    other = r"[^\p{L}\p{N}_]"
    cue = rf"(?:^|{other})" + cue[2:] if cue.startswith(r"\b") else cue
    return cue[:-2] + rf"(?:{other}|$)" if cue.endswith(r"\b") else cue


def _intent(text: str, declared: dict[str, list[str]] | None = None) -> str:
    parts = []
    for cues in (declared or {}, K.CUES):
        for name in K.CUES:
            hits = " OR ".join("regexp_matches({}, '{}')".format(text, _bounded(c).replace("'", "''")) for c in cues.get(name, []))
            parts += [f"WHEN {hits} THEN '{name}'"] if hits else []
    return "CASE " + " ".join(parts) + " END"


def _affine(found: str) -> str:
    columns = {"types": "knowledge_type", "roles": "role", "polarity": "polarity"}
    parts = []
    for name, want in K.PREFERRED.items():
        hits = " OR ".join("{} IN ({})".format(columns[k], ", ".join(f"'{x}'" for x in v)) for k, v in want.items())
        parts.append(f"({found} = '{name}' AND ({hits}))")
    return " OR ".join(parts)


VERSION = r"CASE WHEN contains({0}, 'version') THEN nullif(regexp_extract({1}, '(?i)\b(?:v(?:ersion)?\s*)?([0-9]{{4}}|[0-9]+\.[0-9]+(?:\.[0-9]+)?)\b', 1), '') END"
Q = f"q AS (SELECT item_id AS query, ({_list(OPENINGS)})[item_id % 14 + 1] || coalesce(text, '') || CASE WHEN item_id % 5 = 0 THEN ' CALCULATE RangeStart' ELSE '' END AS text FROM benchmark)"
ITEMS = f"""items AS (SELECT d.doc_id AS id, array_to_string((regexp_extract_all(coalesce(text, ''), '([A-Za-z]+)', 1))[1:d.doc_id % 3 + 1], ' ') AS subject, text AS statement, ({_list(TYPES)})[d.doc_id % 5 + 1] AS knowledge_type, ({_list(ROLES)})[d.doc_id % 5 + 1] AS role,
      CASE WHEN d.doc_id % 5 = 3 THEN 'negative' ELSE 'positive' END AS polarity, {SOURCE_NUMBER} * 4 + 10 AS authority, d.doc_id % 6 AS level, {SOURCE_NUMBER} % 5 = 0 AS official, CASE d.doc_id % 4 WHEN 0 THEN '2.1' WHEN 1 THEN '3.0' END AS product_version,
      CASE WHEN toxic = 1 THEN 'CONFLICTED' WHEN quality = 0 THEN 'STALE' WHEN quality IS NULL THEN 'CANDIDATE' ELSE 'VERIFIED' END AS status, 1.0::DOUBLE / (1 + d.doc_id % 50) AS confidence FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
FUNCTION = _list(K.FUNCTION_WORDS)
SHARE = "1 / (1 + log2(greatest(n_items, 1)))"
ENTITIES = rf"""
    sub AS (SELECT lower(subject) AS low, min(subject) AS canonical, count(*) AS n FROM items GROUP BY 1),
    tok AS (SELECT query, [regexp_replace(x, '^\.+|\.+$', '', 'g') FOR x IN regexp_extract_all(text, '([A-Za-z0-9][A-Za-z0-9_.+#-]*)', 1)] AS t FROM q),
    pos AS (SELECT query, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM tok, (VALUES (1), (2), (3), (4)) v(n) WHERE len(t) >= n),
    gr AS (SELECT query, lower(g) AS low, arg_min(g, pos) AS written FROM (SELECT query, i * 10 + n AS pos, array_to_string(t[i:i + n - 1], ' ') AS g FROM pos) WHERE length(g) >= 2 GROUP BY 1, 2),
    exact AS (SELECT query, low, written, canonical, 'subject' AS kind, n AS n_items FROM gr JOIN sub USING (low)),
    begun AS (SELECT array_to_string(string_split(low, ' ')[1:2], ' ') AS low, sum(n) AS n FROM sub WHERE len(string_split(low, ' ')) > 2 GROUP BY 1),
    pre AS (SELECT query, low, written, written AS canonical, 'prefix' AS kind, n AS n_items FROM gr JOIN begun USING (low) WHERE contains(low, ' ') AND length(low) >= 6 AND NOT list_contains({FUNCTION}, string_split(low, ' ')[1]) AND NOT list_contains({FUNCTION}, string_split(low, ' ')[-1])
      AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.query = gr.query AND e.low = gr.low)),
    ident AS (SELECT query, lower(x) AS low, min(x) AS id FROM (SELECT query, unnest(t) AS x FROM tok) WHERE regexp_matches(x, '^[A-Z][A-Z0-9_.]{{2,}}$') OR regexp_matches(x, '^[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]+)+$') GROUP BY 1, 2),
    both_ AS (SELECT * FROM exact UNION ALL SELECT * FROM pre),
    alle AS (SELECT coalesce(b.query, i.query) AS query, coalesce(b.low, i.low) AS low, coalesce(written, i.id) AS text, coalesce(canonical, i.id) AS canonical, CASE WHEN i.id IS NOT NULL THEN 'identifier' ELSE kind END AS kind, coalesce(n_items, 0) AS n_items FROM both_ b FULL JOIN ident i ON i.query = b.query AND i.low = b.low),
    kept AS (SELECT * FROM alle a WHERE kind = 'identifier' OR NOT EXISTS (SELECT 1 FROM both_ o WHERE o.query = a.query AND o.low <> a.low AND contains(o.low, a.low))),
    ent AS (SELECT *, weight < 0.2 AS common FROM (SELECT *, CASE WHEN kind = 'identifier' THEN greatest({SHARE}, 0.8) WHEN regexp_matches(text, '[ -]') THEN {SHARE} ELSE {SHARE} * 0.5 END AS weight FROM kept))"""


def found(spark, sf):
    return K.entities(questions(spark, sf), items(spark, sf))


@query(f"WITH {Q}, {ITEMS}, {ENTITIES} SELECT query, low, text, kind, CAST(n_items AS BIGINT) AS n_items, round(weight, 6) AS weight, common FROM ent")
def r05_r06_r25_entities(spark, sf):
    """The subjects, subject beginnings and identifiers that questions name, with their specificity."""
    return found(spark, sf).select("query", "low", "text", "kind", "n_items", F.round("weight", 6).alias("weight"), "common")


@query(f"WITH {Q}, {ITEMS}, {ENTITIES} SELECT query, id, entity, rank AS entity_rank FROM (SELECT e.query, i.id, e.low AS entity, row_number() OVER (PARTITION BY e.query, e.low ORDER BY confidence DESC, i.id) AS rank FROM (SELECT DISTINCT query, lower(canonical) AS low FROM ent) e JOIN items i ON lower(i.subject) = e.low) WHERE rank <= 30")
def r25_entity_channel(spark, sf):
    """The items filed under a question's entities, thirty for each."""
    return K.entity_channel(found(spark, sf), items(spark, sf)).withColumn("entity_rank", F.col("entity_rank").cast("long"))


TURNS = f"SELECT conv_id, turn, ({_list(OPENINGS)})[(conv_id + turn) % 14 + 1] || coalesce(text, '') AS question FROM conversations WHERE role = 'user'"


def turns(spark, sf):
    """Users' turns with an opening."""
    rows = table(spark, sf, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", F.concat(picked(OPENINGS, F.col("conv_id") + F.col("turn")), F.coalesce("text", F.lit(""))).alias("question"))


@query(f"SELECT conv_id, turn, {_intent('p', DECLARED)} AS intent, {VERSION.format('p', 'question')} AS version FROM (SELECT *, {_plain('question')} AS p FROM ({TURNS}))")
def r07_r08_intent(spark, sf):
    """The intent and version of users' turns, with a domain's declared cues before the core's."""
    return turns(spark, sf).select("conv_id", "turn", K.intent("question", DECLARED).alias("intent"), K.version("question").alias("version"))


@query("SELECT p_type AS knowledge_type, list_sort(list_distinct([w FOR w IN regexp_extract_all(lower(p_type || ' ' || p_type || ' of ' || brand), '([a-z0-9]+)', 1) IF length(w) >= 3])) AS terms FROM (SELECT p_type, min(p_brand) AS brand FROM part GROUP BY 1)")
def r09_type_terms(spark, sf):
    """Part types as declared knowledge types."""
    types = table(spark, sf, "part").groupBy(F.col("p_type").alias("knowledge_type")).agg(F.concat(F.lit("of "), F.min("p_brand")).alias("prefix"))
    return K.type_terms(types.withColumn("label", F.col("knowledge_type"))).select("knowledge_type", F.array_sort("terms").alias("terms"))


STEM = "CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, -3) WHEN length(w) > 5 AND w LIKE '%ies' THEN left(w, -3) || 'y' WHEN length(w) > 5 AND w LIKE '%es' THEN left(w, -2) WHEN length(w) > 5 AND w LIKE '%s' THEN left(w, -1) WHEN length(w) > 5 AND w LIKE '%ed' THEN left(w, -2) ELSE w END"


@query(f"SELECT DISTINCT conv_id, {STEM} AS stem FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9+#.-]*)', 1)) AS w FROM conversations)")
def r34_stems(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", F.explode(K.stemmed(F.col("text"))).alias("stem")).distinct()


MATCHED = f"""paths AS (SELECT DISTINCT lower('Area/' || array_to_string(w[1:2], ' ')) AS path FROM (SELECT regexp_extract_all(text, '([A-Za-z]+)', 1) AS w FROM benchmark WHERE item_id % 2 = 0) WHERE len(w) >= 2),
    leaf AS (SELECT DISTINCT path, word FROM (SELECT path, {STEM} AS word FROM (SELECT path, unnest(regexp_extract_all(split_part(path, '/', 2), '([a-z0-9][a-z0-9+#.-]*)', 1)) AS w FROM paths)) WHERE length(word) > 2),
    m AS (SELECT query, path, word, max(idf) AS idf FROM leaf JOIN w ON length(term) >= 3 AND (starts_with(word, term) OR starts_with(term, word)) GROUP BY 1, 2, 3),
    matched AS (SELECT query, path FROM (SELECT query, path, count(*) AS hit, min(idf) AS least FROM m GROUP BY 1, 2) JOIN (SELECT path, count(*) AS n FROM leaf GROUP BY 1) USING (path) WHERE hit = n AND (n >= 2 OR least >= 4))"""


def paths(spark, sf):
    """Areas: two-word names from every second passage."""
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    rows = table(spark, sf, "benchmark").filter("item_id % 2 = 0").select(w.alias("w")).filter(F.size("w") >= 2)
    return rows.select(F.concat(F.lit("Area/"), F.array_join(F.slice("w", 1, 2), " ")).alias("path")).distinct()


def weighted(spark, sf, parts=None):
    """Questions' terms with their idf over the documents."""
    t, _, idf = parts or P.searched(spark, sf)
    return staged(t.join(idf, "term").select("query", "term", "idf"), "terms")


@query(f"{P.LEXICAL}, {MATCHED} SELECT query, path FROM matched")
def r32_taxonomy_paths(spark, sf):
    """The areas that questions name."""
    return K.matching_paths(weighted(spark, sf), paths(spark, sf))


FIELDED = f"""{ITEMS}, f AS (SELECT id, term, max(k) AS k FROM (SELECT id, unnest(regexp_extract_all(lower(subject), '([a-z0-9]+)', 1)) AS term, 1.0::DOUBLE AS k FROM items UNION ALL SELECT id, unnest(regexp_extract_all(lower(coalesce(statement, '')), '([a-z0-9]+)', 1)), 0.4 FROM items UNION ALL SELECT id, unnest(regexp_extract_all(lower('Area/' || subject), '([a-z0-9]+)', 1)), 0.1 FROM items) GROUP BY 1, 2)"""


@query(f"{P.LEXICAL}, {FIELDED}, z AS (SELECT query, id, round(sum(idf * k) / (SELECT sum(idf) FROM w a WHERE a.query = w.query), 6) AS score FROM w JOIN f USING (term) GROUP BY query, id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS nth FROM z) SELECT query, count(*) AS n, round(max(score), 4) AS best FROM r WHERE nth <= 100 GROUP BY 1")
def r21_fielded_channel(spark, sf):
    """The lexical channel with its fields' weights: subject, statement, topic."""
    t = weighted(spark, sf)
    posts = K.weighted_postings(items(spark, sf).select("id", "subject", "statement", "topic"), {k: K.FIELDS[k] for k in ("subject", "statement", "topic")})
    hits = K.fielded_channel(t, posts.join(t.select("term").distinct(), "term", "left_semi"), 100)
    return hits.groupBy("query").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"))


@query(f"SELECT conv_id, turn, {_affine('intent')} AS affine FROM (SELECT conv_id, turn, {_intent('p')} AS intent, ({_list(TYPES)})[conv_id % 5 + 1] AS knowledge_type, ({_list(ROLES)})[conv_id % 5 + 1] AS role, CASE WHEN conv_id % 5 = 3 THEN 'negative' ELSE 'positive' END AS polarity FROM (SELECT *, {_plain('question')} AS p FROM ({TURNS}))) WHERE intent IS NOT NULL")
def r33_intent_affinity(spark, sf):
    """Whether an item of the conversation's type suits the intent of a user's turn."""
    rows = turns(spark, sf).select("conv_id", "turn", K.intent("question").alias("intent")).filter("intent IS NOT NULL")
    polarity = F.when(F.col("conv_id") % 5 == 3, "negative").otherwise("positive")
    return rows.select("conv_id", "turn", K.affine(F.col("intent"), picked(TYPES, F.col("conv_id")), picked(ROLES, F.col("conv_id")), polarity).alias("affine"))


def analysed(spark, sf, parts=None):
    """Questions with intent, version, entities, terms and paths."""
    q = questions(spark, sf).select("query", K.intent("text").alias("intent"), K.version("text").alias("version"))
    e = found(spark, sf).groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.lower("canonical").alias("low"), "kind", "weight", "common"))).alias("entities"))
    t = weighted(spark, sf, parts)
    terms = t.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("terms"))
    p = K.matching_paths(t, paths(spark, sf)).groupBy("query").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    out = q.join(e, "query", "left").join(terms, "query", "left").join(p, "query", "left")
    empty = {"entities": "array<struct<low:string,kind:string,weight:double,common:boolean>>", "terms": "array<struct<term:string,idf:double>>", "paths": "array<string>"}
    return staged(out.select("query", "intent", "version", *(F.coalesce(c, F.array().cast(k)).alias(c) for c, k in empty.items())), "questions")


def candidates(spark, sf, parts=None):
    """(the pool's items, the pool): only the pool's items carry their words."""
    pool = P.vectors(spark, sf).select("query", "id", "vec_rank").join(P.lexical(spark, sf, parts=parts).select("query", "id", "lex_rank"), ["query", "id"], "full_outer")
    pool = staged(pool.withColumn("rare_rank", F.lit(None).cast("long")), "pool")
    of = items(spark, sf).join(pool.select("id").distinct(), "id", "left_semi")
    return of.withColumn("words", F.array_distinct(X.words(F.concat_ws(" ", "subject", "statement")))).withColumn("type_terms", F.array("knowledge_type")), pool


ABOUT = "intent IS NULL OR intent IN ('definition', 'conceptual', 'syntax', 'comparison', 'architecture')"
SIGNALS = rf"""
    a AS (SELECT query, {_intent('p')} AS intent, {VERSION.format('p', 'text')} AS version FROM (SELECT *, {_plain('text')} AS p FROM q)),
    x AS (SELECT u.query, u.id, vec_rank, lex_rank, a.intent, a.version, i.subject, lower(trim(i.subject)) AS low, i.statement, i.knowledge_type, i.role, i.polarity, i.authority, i.level, i.official, i.product_version, i.status,
        lower(concat_ws(' ', i.subject, i.statement)) AS said, list_distinct(regexp_extract_all(lower(concat_ws(' ', i.subject, i.statement)), '([a-z0-9]+)', 1)) AS words FROM u JOIN a ON a.query = u.query JOIN items i ON i.id = u.id),
    own AS (SELECT x.query, x.id, min(e.weight) AS weight FROM x JOIN ent e ON e.query = x.query AND lower(e.canonical) = x.low GROUP BY 1, 2),
    opn AS (SELECT x.query, x.id, min(e.weight) AS weight FROM x JOIN ent e ON e.query = x.query AND e.kind = 'prefix' AND starts_with(x.low, lower(e.canonical) || ' ') GROUP BY 1, 2),
    men AS (SELECT query, id, weight, low FROM (SELECT x.query, x.id, e.weight, lower(e.canonical) AS low, row_number() OVER (PARTITION BY x.query, x.id ORDER BY e.weight DESC, lower(e.canonical) DESC) AS n FROM x JOIN ent e ON e.query = x.query AND NOT e.common AND contains(x.said, lower(e.canonical))) WHERE n = 1),
    cov AS (SELECT x.query, x.id, sum(CASE WHEN list_contains(words, term) THEN idf ELSE 0 END) AS got, sum(idf) AS total FROM x JOIN w ON w.query = x.query WHERE length(term) > 1 GROUP BY 1, 2),
    pth AS (SELECT DISTINCT x.query, x.id FROM x JOIN matched m ON m.query = x.query AND starts_with(lower('Area/' || x.subject), m.path)),
    sig AS (SELECT x.query, x.id, round(coalesce(0.6::DOUBLE / (15 + vec_rank), 0.15::DOUBLE / (15 + lex_rank), 0), 6) AS fusion,
      round(coalesce(CASE WHEN own.weight IS NOT NULL THEN 0.020::DOUBLE * own.weight WHEN opn.weight IS NOT NULL THEN 0.020::DOUBLE * opn.weight * 0.8 END * CASE WHEN intent = 'listing' THEN 0.2 WHEN {ABOUT} THEN 1.0 ELSE 0.5 END, 0), 6) AS entity_subject,
      round(coalesce(CASE WHEN own.weight IS NULL AND opn.weight IS NULL AND men.weight IS NOT NULL THEN 0.005::DOUBLE * CASE WHEN regexp_matches(men.low, '[ -]') THEN greatest(men.weight, 0.6) ELSE men.weight END * 2 END * CASE WHEN intent = 'listing' THEN 1.2 WHEN {ABOUT} THEN 0.4 ELSE 0.8 END, 0), 6) AS entity_mention,
      CASE WHEN own.weight IS NULL AND opn.weight IS NULL AND men.weight IS NOT NULL AND intent = 'listing' AND regexp_matches(trim(subject), '^(?:[A-Z][A-Z0-9_.]{{2,}}|[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]+)+)(?: \(.*\))?$') THEN 0.006 ELSE 0 END AS member,
      CASE WHEN pth.id IS NOT NULL THEN 0.008 ELSE 0 END AS topic, round(coalesce(0.020::DOUBLE * got / total, 0), 6) AS coverage, CASE WHEN {_affine('intent')} THEN 0.006 ELSE 0 END AS affinity,
      CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.query = x.query AND w.term = x.knowledge_type) THEN 0.006 ELSE 0 END AS type_match,
      round(0.005::DOUBLE * authority / 100, 6) + round(0.002::DOUBLE * least(level, 4) / 4, 6) + CASE WHEN official THEN 0.001 ELSE 0 END AS trust,
      CASE WHEN version IS NULL OR product_version IS NULL THEN 0 WHEN contains(lower(product_version), lower(version)) THEN 0.004 ELSE -0.006 END AS version_signal,
      CASE status WHEN 'CANDIDATE' THEN -0.008 WHEN 'STALE' THEN -0.006 WHEN 'CONFLICTED' THEN -0.004 ELSE 0 END + CASE WHEN x.id % 11 = 0 THEN -0.004 ELSE 0 END + CASE WHEN x.id % 13 = 0 THEN -0.002 ELSE 0 END + CASE WHEN x.id % 17 = 0 THEN -0.004 ELSE 0 END AS penalties
      FROM x LEFT JOIN own ON own.query = x.query AND own.id = x.id LEFT JOIN opn ON opn.query = x.query AND opn.id = x.id LEFT JOIN men ON men.query = x.query AND men.id = x.id LEFT JOIN cov ON cov.query = x.query AND cov.id = x.id LEFT JOIN pth ON pth.query = x.query AND pth.id = x.id)"""


@query(P.FUSED + f", {Q}, {ITEMS}, {ENTITIES}, {MATCHED}, {SIGNALS}" + " SELECT query, id, fusion, entity_subject, entity_mention, coverage, round((fusion + entity_subject + entity_mention + member + topic + coverage + affinity + type_match + trust + version_signal + penalties)::DOUBLE, 6) AS score FROM sig")
def r31_signals(spark, sf):
    """All 19 signals of a pool of candidates; the score is their sum."""
    parts = P.searched(spark, sf)
    of, pool = candidates(spark, sf, parts)
    scored = K.signals(pool.join(analysed(spark, sf, parts), "query").join(of, "id"))
    return scored.select("query", "id", *(F.col(f"signals.{k}").alias(k) for k in ("fusion", "entity_subject", "entity_mention")), F.col("signals.concept_coverage").alias("coverage"), F.round("score", 6).alias("score"))


@query()
def r38_staged_retrieval(spark, sf):
    """The whole pipeline, from the pool to the expansion (its diversity is sequential within a list, so beyond SQL)."""
    parts = P.searched(spark, sf)
    of, pool = candidates(spark, sf, parts)
    return K.retrieve(pool, analysed(spark, sf, parts), staged(of, "candidates"), found(spark, sf), 8)


@query(P.FUSED + f", {Q}, {ITEMS}, {ENTITIES}" + f""", r37 AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0), 9) DESC, id) AS rank FROM u),
    chosen AS (SELECT query, id FROM r37 WHERE rank <= 10), asked AS (SELECT query, {_intent(_plain('text'))} AS intent FROM q),
    two AS (SELECT query, lower(canonical) AS entity, row_number() OVER (PARTITION BY query ORDER BY length(text) DESC, text) AS nth FROM ent QUALIFY nth <= 2),
    pool AS (SELECT two.query, nth, i.id, i.role, i.polarity, row_number() OVER (PARTITION BY two.query, nth ORDER BY confidence DESC, i.id) AS place FROM two JOIN items i ON lower(i.subject) = entity QUALIFY place <= 20),
    held AS (SELECT pool.*, intent, c.id IS NOT NULL AS taken, max(CASE WHEN c.id IS NOT NULL AND role = 'foundation' THEN 1 ELSE 0 END) OVER (PARTITION BY pool.query, nth) = 1 AS has FROM pool JOIN asked ON asked.query = pool.query LEFT JOIN chosen c ON c.query = pool.query AND c.id = pool.id),
    wants AS (SELECT query, nth, id, place, 'foundation' AS why, 0 AS o FROM held WHERE NOT taken AND role = 'foundation' AND NOT has UNION ALL SELECT query, nth, id, place, 'negative', 1 FROM held WHERE NOT taken AND polarity = 'negative' AND intent IN ('limitation', 'troubleshooting', 'error')
      UNION ALL SELECT query, nth, id, place, 'example', 2 FROM held WHERE NOT taken AND role = 'example' AND intent = 'example'),
    one AS (SELECT query, nth, why, o, arg_min(id, place) AS id FROM wants GROUP BY ALL), once AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY nth, o) = 1)
    SELECT query, id, why FROM once QUALIFY row_number() OVER (PARTITION BY query ORDER BY nth, o) <= 3""")
def r37_bounded_expansion(spark, sf):
    """What is added to the ten results of the hybrid search: a foundation, a negative item, an example, three at most."""
    chosen = staged(P.r28_rrf_hybrid(spark, sf).select("query", "id"), "chosen")
    asked = questions(spark, sf).select("query", K.intent("text").alias("intent"))
    return K.expansion(chosen, found(spark, sf), asked, items(spark, sf))
