"""Retrieval and answer-planning queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks
from ..operators import retrieval as R
from ..operators import vectors as V
from ..session import staged, table
from .registry import query

WORDS = "regexp_extract_all(lower(text), '([a-z0-9]+)', 1)"
POSTS = f"SELECT DISTINCT doc_id AS id, unnest({WORDS}) AS term FROM documents"
TERMS = f"SELECT DISTINCT item_id AS query, unnest({WORDS}) AS term FROM benchmark"
IDF = "SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM post GROUP BY 1"


def posts(spark, sf):
    return R.postings(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), X.words("text"))


def terms(spark, sf):
    """Questions (benchmark passages) by their distinct words; the set is small and joined by term."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(X.words("text"))).alias("term"))


def n_docs(spark, sf):
    return table(spark, sf, "documents").count()


@query("""
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings),
    p AS (SELECT q.vec_id AS query, i.vec_id AS id, round(1 - list_inner_product(q.e, i.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(i.e, i.e))), 6) AS distance FROM v q JOIN v i ON q.label = i.label WHERE q.vec_id % 20 = 0 AND i.vec_id <> q.vec_id)
    SELECT query, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM p) WHERE rank <= 10""")
def r20_d05_vector_topk(spark, sf):
    """The ten nearest of the same topic for every twentieth vector."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return V.nearest(v.filter("id % 20 = 0").withColumnRenamed("id", "query"), v, 10, "label", others_only=True)


@query(f"WITH post AS ({POSTS}) SELECT term, df, round(idf, 6) AS idf FROM ({IDF})")
def r22_r23_df_idf(spark, sf):
    return R.document_frequency(posts(spark, sf), n_docs(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


LEXICAL = f"""
    WITH t AS ({TERMS}), post AS (SELECT * FROM ({POSTS}) WHERE term IN (SELECT term FROM t)), idf AS ({IDF}), w AS (SELECT query, t.term, idf FROM t JOIN idf USING (term)),
    s AS (SELECT query, id, round(sum(idf) / (SELECT sum(idf) FROM w a WHERE a.query = w.query), 6) AS coverage FROM w JOIN post USING (term) GROUP BY query, id),
    lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY coverage DESC, id) AS lex_rank FROM s) WHERE lex_rank <= 50)"""


def searched(spark, sf):
    """(terms, postings, idf) of the questions: texts are read once, and their postings of question terms are staged."""
    t = staged(terms(spark, sf), "terms")
    p = staged(posts(spark, sf).join(t.select("term").distinct(), "term", "left_semi"), "postings")
    return t, p, staged(R.document_frequency(p, n_docs(spark, sf)), "idf")


def lexical(spark, sf, k: int = 50, parts=None):
    t, p, idf = parts or searched(spark, sf)
    return R.lexical_channel(t, p, idf, k)


@query(LEXICAL + " SELECT query, count(*) AS n, round(max(coverage), 4) AS best, arg_min(id, lex_rank) AS first_id FROM lex GROUP BY 1")
def r21_lexical_channel(spark, sf):
    return lexical(spark, sf).groupBy("query").agg(F.count("*").alias("n"), F.round(F.max("coverage"), 4).alias("best"), F.min_by("id", "lex_rank").alias("first_id"))


@query(f"""
    WITH t AS ({TERMS}), post AS (SELECT * FROM ({POSTS}) WHERE term IN (SELECT term FROM t)), idf AS ({IDF}),
    r AS (SELECT query, term, df, idf, row_number() OVER (PARTITION BY query ORDER BY idf DESC, term) AS r, count(*) OVER (PARTITION BY query) AS n FROM t JOIN idf USING (term))
    SELECT query, term, df FROM r WHERE r <= greatest(1, n // 2) AND df < greatest(1, 0.15 * (SELECT count(*) FROM documents))""")
def r24_rare_terms(spark, sf):
    t = terms(spark, sf)
    p = posts(spark, sf).join(t.select("term").distinct(), "term", "left_semi")
    n = n_docs(spark, sf)
    return R.rare_terms(t, R.document_frequency(p, n), n).select("query", "term", "df")


VECTORS = """v AS (SELECT vec_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings),
    vec AS (SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS vec_rank FROM (SELECT q.vec_id AS query, i.vec_id AS id, round(1 - list_inner_product(q.e, i.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(i.e, i.e))), 9) AS distance FROM v q JOIN v i ON q.label = i.label JOIN benchmark ON item_id = q.vec_id)) WHERE vec_rank <= 50)"""


def vectors(spark, sf, k: int = 50):
    """Questions take the vector with their id; items lie within its topic."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("topic"), F.col("embedding").alias("vector"))
    q = v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), "id").select(F.col("id").alias("query"), "topic", "vector")
    return V.nearest(q, v, k, "topic", digits=9).withColumnRenamed("rank", "vec_rank")


FUSED = LEXICAL + ", " + VECTORS + ", u AS (SELECT coalesce(vec.query, lex.query) AS query, coalesce(vec.id, lex.id) AS id, vec_rank, lex_rank FROM vec FULL JOIN lex ON vec.query = lex.query AND vec.id = lex.id)"


@query(FUSED + """, r AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0), 9) AS score FROM u)
    SELECT query, id, vec_rank, lex_rank, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 10""")
def r28_rrf_hybrid(spark, sf):
    return R.hybrid(vectors(spark, sf), lexical(spark, sf), 10)


@query(FUSED + " SELECT query, id, round(coalesce(0.6::DOUBLE / (15 + vec_rank), 0.15::DOUBLE / (15 + lex_rank), 0), 9) AS score FROM u")
def r26_r30_pool_fusion(spark, sf):
    pool = vectors(spark, sf).select("query", "id", "vec_rank").join(lexical(spark, sf).select("query", "id", "lex_rank"), ["query", "id"], "full_outer")
    return pool.select("query", "id", F.round(R.vector_primary(F.col("vec_rank"), F.col("lex_rank"), F.lit(None)), 9).alias("score"))


RARE = """, rt AS (SELECT query, term, idf FROM (SELECT query, term, df, idf, row_number() OVER (PARTITION BY query ORDER BY idf DESC, term) AS r, count(*) OVER (PARTITION BY query) AS n FROM t JOIN idf USING (term)) WHERE r <= greatest(1, n // 2) AND df < greatest(1, 0.15 * (SELECT count(*) FROM documents))),
    rs AS (SELECT query, id, round(sum(idf) / (SELECT sum(idf) FROM rt a WHERE a.query = rt.query), 6) AS coverage FROM rt JOIN post USING (term) GROUP BY query, id),
    rare AS (SELECT query, id, rare_rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY coverage DESC, id) AS rare_rank FROM rs) WHERE rare_rank <= 50)"""


@query(FUSED + RARE + """, x AS (SELECT coalesce(u.query, rare.query) AS query, coalesce(u.id, rare.id) AS id, vec_rank, lex_rank, rare_rank FROM u FULL JOIN rare ON u.query = rare.query AND u.id = rare.id)
    SELECT query, id, round(coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0) + coalesce(1.0::DOUBLE / (60 + rare_rank), 0), 9) AS score FROM x""")
def r29_three_channel_rrf(spark, sf):
    """Vector, lexical and rare-term ranks, fused."""
    (t, p, idf), n = searched(spark, sf), n_docs(spark, sf)
    rare = R.lexical_channel(R.rare_terms(t, idf, n).select("query", "term"), p, idf, 50).select("query", "id", F.col("lex_rank").alias("rare_rank"))
    lex = R.lexical_channel(t, p, idf, 50).select("query", "id", "lex_rank")
    pool = vectors(spark, sf).select("query", "id", "vec_rank").join(lex, ["query", "id"], "full_outer").join(rare, ["query", "id"], "full_outer")
    return pool.select("query", "id", F.round(R.rrf(F.col("vec_rank"), F.col("lex_rank"), F.col("rare_rank")), 9).alias("score"))


@query(LEXICAL + """, d AS (SELECT doc_id AS id, source FROM documents)
    SELECT query, id, source AS subject, place FROM (SELECT query, id, source, lex_rank, row_number() OVER (PARTITION BY query, source ORDER BY lex_rank) AS place FROM lex JOIN d USING (id)) WHERE place <= 3""")
def r36_subject_cap(spark, sf):
    """At most three results per subject, in rank order."""
    found = lexical(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("subject")), "id")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query", "subject").orderBy("lex_rank")).cast("long")).filter("place <= 3").select("query", "id", "subject", "place")


@query()
def r36_diversified(spark, sf):
    """Greedy diversity over each question's list (sequential within a bounded list, so beyond SQL). Words go as hashes."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("subject"), "text")
    # Staged, the lists are known to be small, so that texts needn't be shuffled to meet them.
    found = staged(lexical(spark, sf).withColumnRenamed("lex_rank", "rank"), "found").join(docs, "id")
    return R.diversified(found.withColumn("words", F.array_distinct(F.transform(X.words("text"), lambda w: F.xxhash64(w)))).drop("text"))


@query(f"""
    WITH w AS (SELECT conv_id, turn, unnest({WORDS}) AS a, generate_subscripts({WORDS}, 1) AS p FROM conversations),
    b AS (SELECT conv_id, turn, a, lead(a) OVER (PARTITION BY conv_id, turn ORDER BY p) AS b FROM w)
    SELECT a || ' ' || b AS gram, count(DISTINCT conv_id) AS n_convs, count(*) AS n FROM b WHERE b IS NOT NULL AND NOT contains(a, b) AND NOT contains(b, a) GROUP BY 1 HAVING count(DISTINCT conv_id) >= 2""")
def p01_p02_p03_bigrams(spark, sf):
    """Adjacent word pairs, neither holding the other, that at least two conversations share."""
    w = X.words("text")
    pairs = F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b"))
    rows = table(spark, sf, "conversations").select("conv_id", F.explode(pairs).alias("p")).select("conv_id", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    rows = rows.filter(~F.col("a").contains(F.col("b")) & ~F.col("b").contains(F.col("a")))
    return rows.groupBy(F.concat_ws(" ", "a", "b").alias("gram")).agg(F.countDistinct("conv_id").alias("n_convs"), F.count("*").alias("n")).filter("n_convs >= 2")


@query(f"""
    WITH t AS (SELECT conv_id, turn, role, list_distinct({WORDS}) AS w FROM conversations)
    SELECT q.conv_id, q.turn, round(CASE WHEN len(q.w) = 0 THEN 1.0 ELSE len(list_intersect(q.w, a.w)) / len(q.w)::DOUBLE END, 3) AS score, len(q.w) - len(list_intersect(q.w, a.w)) < greatest(1, (len(q.w) + 1) // 2) AS ok
    FROM t q JOIN t a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant'""")
def p05_completeness(spark, sf):
    """The share of a question's words that the next answer covers."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.array_distinct(X.words("text")).alias("w"))
    a = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    n, hit = F.size("w"), F.size(F.array_intersect("w", "v"))
    return t.filter("role = 'user'").join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.when(n == 0, 1.0).otherwise(hit / n), 3).alias("score"), (n - hit < F.greatest(F.lit(1), F.floor((n + 1) / 2))).alias("ok"))


@query("""
    SELECT conv_id, count(*) AS n_blocks, CAST(max(used) AS BIGINT) AS n_chars FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) x
    WHERE used <= 1400 OR n = 1 GROUP BY conv_id""")
def p06_context_pack(spark, sf):
    """A conversation's first turns as context blocks, up to a number of characters."""
    return checks.packed(table(spark, sf, "conversations"), "conv_id", "turn", F.length("text"), 1400).groupBy("conv_id").agg(F.count("*").alias("n_blocks"), F.max("used").alias("n_chars"))


@query(r"""SELECT conv_id, 'Turns of conversation ' || conv_id || chr(10) || string_agg('[' || n || '] ' || role || ': ' || w, chr(10) ORDER BY turn) AS plan
    FROM (SELECT conv_id, turn, role, split_part(text, ' ', 1) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text IS NOT NULL) GROUP BY 1""")
def p12_plan_text(spark, sf):
    """A conversation's turns rendered as a numbered plan; a conversation is a bounded list."""
    point = F.concat_ws(": ", "role", F.split_part("text", F.lit(" "), F.lit(1)))
    turns = table(spark, sf, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", point.alias("p")))).alias("t"))
    return turns.select("conv_id", checks.plan_lines(F.concat(F.lit("Turns of conversation "), F.col("conv_id").cast("string")), F.col("t.p")).alias("plan"))


@query(r"SELECT conv_id, turn, list_sort(list_distinct([x::INT FOR x IN regexp_extract_all(text || ' [' || turn || '] [' || (turn + 1) || '] [99]', '\[([0-9]+)\]', 1) IF x::INT BETWEEN 1 AND 8])) AS citations FROM conversations")
def p07_citations(spark, sf):
    """Cited numbers within the list, distinct and sorted (markers appended: the texts hold none)."""
    marked = F.format_string("%s [%d] [%d] [99]", "text", "turn", F.col("turn") + 1)
    numbers = F.transform(F.regexp_extract_all(marked, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.between(1, 8)))).alias("citations"))


@query(r"""
    WITH t AS (SELECT conv_id, turn, trim(regexp_replace(lower(text || CASE WHEN turn % 4 = 2 THEN ' The base does not cover this.' ELSE '' END), '\s+', ' ', 'g')) AS f FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, length(f) <= 400 AND regexp_matches(f, 'does not contain|do not contain|not enough|insufficient|no verified information|does not cover|not covered|cannot answer|no information|not available in the knowledge|not possible to determine|not possible to answer') AS abstains FROM t""")
def p08_abstention(spark, sf):
    """Short answers that decline (a decline is appended to some: the texts hold none)."""
    said = F.concat("text", F.when(F.col("turn") % 4 == 2, " The base does not cover this.").otherwise(""))
    return table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", checks.abstains(said).alias("abstains"))
