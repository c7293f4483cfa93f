"""Hybrid retrieval: lexical channels, reciprocal rank fusion, ranking and diversity (vectors are in a module of their own).

A query set is small beside the data (golden questions, or every twentieth row): it is joined to the data by its terms or
its topic. Only postings of query terms are shuffled; per-query top lists are cut within tasks before they are exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

K = 60


def top(rows: DataFrame, query: str, order: list[Column], k: int, rank: str) -> DataFrame:
    """The first k rows per query, ranked from 1; Spark limits each task's groups before the exchange."""
    w = Window.partitionBy(query).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def postings(docs: DataFrame, words: Column) -> DataFrame:
    """(id, term): distinct words of each document."""
    return docs.select("id", F.explode(F.array_distinct(words)).alias("term"))


def document_frequency(posts: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf), idf = ln((N + 1) / (df + 1)) + 1."""
    return posts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(n_docs + 1) / (F.col("df") + 1)) + 1)


def lexical_channel(terms: DataFrame, posts: DataFrame, idf: DataFrame, k: int) -> DataFrame:
    """(query, id, coverage, lex_rank): any term matches; the share of the query's idf that a document covers. `posts` is
    read several times, so it should be staged.

    Common terms never list their documents. A document's sum over the rarer half of a query's terms is a lower bound, and
    the k-th best of these is a sum that the list's last can't fall below. Terms whose idf together stays below it can't
    bring a document into the list on their own: they are summed only for documents that another term has found and that
    could still reach it.
    """
    weighted = staged(terms.join(idf.select("term", "idf"), "term"), "weighted")
    w = Window.partitionBy("query")
    ranked = weighted.withColumn("_upto", F.sum("idf").over(w.orderBy("idf", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_all", F.sum("idf").over(w)).withColumn("_half", F.row_number().over(w.orderBy(F.desc("idf"), "term")) * 2 <= F.count("*").over(w) + 1)
    sure = staged(ranked.filter("_half").join(posts, "term").groupBy("query", "id").agg(F.sum("idf").alias("_sum")), "sure")
    last = top(sure, "query", [F.desc("_sum"), F.col("id")], k, "_r").groupBy("query").agg(F.when(F.count("*") >= k, F.min("_sum")).otherwise(0.0).alias("_least"))
    slack = F.col("_all") * 1e-5  # more than what rounding a share to six places can move
    bound = ranked.join(last, "query", "left").withColumn("_least", F.coalesce("_least", F.lit(0.0)) - slack)
    bound = staged(bound.withColumn("_common", ~F.col("_half") & (F.col("_upto") < F.col("_least"))), "bounds")
    found = sure.union(bound.filter("not _half and not _common").join(posts, "term").select("query", "id", F.col("idf").alias("_sum"))).groupBy("query", "id").agg(F.sum("_sum").alias("_sum"))
    rest = bound.groupBy("query").agg(F.sum(F.when(F.col("_common"), F.col("idf")).otherwise(0.0)).alias("_rest"), F.first("_least").alias("_least"), F.first("_all").alias("_all"))
    left = staged(found.join(rest, "query").filter(F.col("_sum") + F.col("_rest") >= F.col("_least")).select("query", "id", "_sum"), "candidates")
    common = bound.filter("_common").select("query", "term", "idf")
    some = posts.join(common.select("term").distinct(), "term", "left_semi").join(left, "id").join(common, ["query", "term"]).select("query", "id", F.col("idf").alias("_sum"))
    sums = left.union(some).groupBy("query", "id").agg(F.sum("_sum").alias("_sum")).join(rest.select("query", "_all"), "query")
    scored = sums.select("query", "id", F.round(F.col("_sum") / F.col("_all"), 6).alias("coverage"))
    return top(scored, "query", [F.desc("coverage"), F.col("id")], k, "lex_rank")


def rare_terms(terms: DataFrame, idf: DataFrame, n_docs: int, share: float = 0.15) -> DataFrame:
    """The upper half of each query's terms by idf, at least one, that fewer than a share of the documents hold."""
    w = Window.partitionBy("query").orderBy(F.desc("idf"), "term")
    ranked = terms.join(idf, "term").withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("query")))
    return ranked.filter((F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2))) & (F.col("df") < F.greatest(F.lit(1.0), F.lit(share * n_docs)))).select("query", "term", "df", "idf")


def rrf(*ranks: Column, k: int = K) -> Column:
    """Reciprocal rank fusion; a missing rank adds nothing."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(1 / (k + r), F.lit(0.0))
    return total


def vector_primary(vec_rank: Column, lex_rank: Column, rare_rank: Column, weight: float = 0.6, k: int = 15) -> Column:
    """The vector rank decides; an item it misses takes a quarter of that for its best lexical rank."""
    best = F.least(lex_rank, rare_rank)
    return F.coalesce(weight / (k + vec_rank), weight * 0.25 / (k + best), F.lit(0.0))


def hybrid(vectors: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """(query, id, vec_rank, lex_rank, score, rank): both channels joined in full, fused and cut."""
    both = vectors.select("query", "id", "vec_rank").join(lexical.select("query", "id", "lex_rank"), ["query", "id"], "full_outer")
    scored = both.withColumn("score", F.round(rrf(F.col("vec_rank"), F.col("lex_rank")), 9))
    return top(scored, "query", [F.desc("score"), F.col("id")], k, "rank")


def diversified(ranked: DataFrame, most: int = 3, k: int = 8, near: float = 0.75) -> DataFrame:
    """Greedy choice per query in rank order: an item is passed over if its stemmed subject is a chosen one's and their
    words overlap by `near`, or its subject already has `most`; passed-over items fill up. `ranked`: query, id, rank,
    subject, words. A query's list is a bounded pool, so one group is one list."""
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, passed, count = [], [], {}
        for r in pdf.sort_values(["rank", "id"]).itertuples(index=False):
            mine = set(r.words)
            alike = any(r.subject == c.subject and mine and len(mine & set(c.words)) / len(mine | set(c.words)) >= near for c in chosen)
            if len(chosen) < k and not alike and count.get(r.subject, 0) < most:
                chosen.append(r)
                count[r.subject] = count.get(r.subject, 0) + 1
            else:
                passed.append(r)
        rows = chosen + passed[: max(0, k - len(chosen))]
        return pd.DataFrame([(r.query, r.id, i + 1) for i, r in enumerate(rows)], columns=["query", "id", "place"])

    q, i = (ranked.schema[c].dataType.simpleString() for c in ("query", "id"))
    return ranked.groupBy("query").applyInPandas(pick, f"query {q}, id {i}, place int")
