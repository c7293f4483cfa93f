"""Checks of answers: citations, abstention, freshness, contradiction, version, and the rule over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases by which an answer declines.
DECLINES = ["does not contain", "do not contain", "not enough", "insufficient", "no verified information", "does not cover", "not covered", "cannot answer", "no information", "not available in the knowledge", "not possible to determine", "not possible to answer"]
#: Words that mention a stale or a contradicted item.
STALE_WORDS = ["stale", "outdated", "may be out of date", "no longer"]
CONFLICT_WORDS = ["conflict", "disagree", "contradict", "differ"]
#: A longer answer that declines and goes on is an answer.
SHORT = 400


def flat(text: Column | str) -> Column:
    """Lower-cased, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def mentions(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def abstains(answer: Column | str, phrases: list[str] = DECLINES, most: int = SHORT) -> Column:
    a = flat(F.coalesce(answer if isinstance(answer, Column) else F.col(answer), F.lit("")))
    return mentions(a, phrases) & (F.length(a) <= most)


def answer_kind(answer: Column | str, n_retrieved: Column, n_cited: Column) -> Column:
    """An abstention has nothing retrieved or declines shortly; other answers are cited or not."""
    return F.when((n_retrieved == 0) | abstains(answer), "abstention").when(n_cited > 0, "cited_answer").otherwise("uncited_answer")


def citations(cited: DataFrame, retrieved: DataFrame, question: list[str], id: str) -> DataFrame:
    """(question, n_cited, n_valid, ok) from `cited` (question, id, verified): every citation must be retrieved and
    verified. `retrieved`: the columns that tell what was retrieved, among them `id`."""
    known = retrieved.distinct().withColumn("_there", F.lit(True))
    rows = cited.join(known, [c for c in known.columns if c != "_there"], "left")
    valid = F.coalesce("_there", F.lit(False)) & F.col("verified")
    return rows.groupBy(*question).agg(F.count("*").alias("n_cited"), F.count_if(valid).alias("n_valid"), F.bool_and(valid).alias("ok"))


def flagged_if_cited(answer: Column, cites: Column, words: list[str]) -> Column:
    """Fine where no such item is cited, or where the answer says so."""
    return ~cites | mentions(flat(answer), words)


def names_version(answer: Column, expected: Column) -> Column:
    return (F.coalesce(expected, F.lit("")) == "") | flat(answer).contains(flat(expected))


def passed(gates: list[Column], judge_ok: Column, expect_abstain: Column) -> Column:
    """All gates, and the judge unless the question wants an abstention."""
    every = F.lit(True)
    for g in gates:
        every = every & g
    return every & (expect_abstain | judge_ok)


def first_failure(*named: tuple[str, Column], none: str = "none") -> Column:
    return F.coalesce(*(F.when(~ok, name) for name, ok in named), F.lit(none))


def retrieval_missed(n_retrieved: Column, recall: Column, precision: Column) -> Column:
    """Nothing retrieved, no authoritative source among it, or mostly other topics; unknown measures don't count."""
    return (n_retrieved == 0) | F.coalesce(recall == 0, F.lit(False)) | F.coalesce(precision < 0.5, F.lit(False))


def concept_rank(retrieved: DataFrame, concepts: DataFrame, question: str, statement: str, rank: str) -> DataFrame:
    """(question, mrr, hit): one over the rank of the first retrieved statement that holds any of the question's concepts,
    or 0. `concepts`: question, concepts (array)."""
    low = F.lower(statement)
    holds = F.exists("concepts", lambda c: low.contains(F.lower(c)) & (c != ""))
    first = retrieved.join(concepts, question).filter(holds).groupBy(question).agg(F.min(rank).alias("_first"))
    return concepts.select(question).join(first, question, "left").select(question, F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"), F.col("_first").isNotNull().alias("hit"))


def findings(results: DataFrame, causes: Column, question: str) -> DataFrame:
    """(cause, n, n_questions), for a list of what to do first."""
    return results.select(question, F.explode(causes).alias("cause")).groupBy("cause").agg(F.count("*").alias("n"), F.countDistinct(question).alias("n_questions"))


def packed(blocks: DataFrame, key: str, order: str, size: Column, limit: int) -> DataFrame:
    """The numbered blocks that fit into `limit` characters in order; the first stays whatever its size."""
    w = Window.partitionBy(key).orderBy(order)
    rows = blocks.withColumn("n", F.row_number().over(w)).withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.filter((F.col("used") <= limit) | (F.col("n") == 1))


def regenerated(first: Column, second: Column, complete: Column, n_cited: Column, covered_first: Column, covered_second: Column) -> Column:
    """Whether a second answer replaces the first: that one was incomplete and no abstention, and the second cites, covers
    strictly more, and is no echo."""
    return ~complete & ~abstains(first) & (n_cited > 0) & (covered_second > covered_first) & (flat(first) != flat(second))


def plan_lines(title: Column, points: Column) -> Column:
    """A plan as text: its title, then a numbered line per point."""
    return F.concat_ws("\n", title, F.array_join(F.transform(points, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n"))


def gate(problems: dict[str, DataFrame]) -> DataFrame:
    """(problem, n): how many rows break each rule of an export; all must be 0."""
    out = None
    for name, rows in problems.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.union(one)
    return out
