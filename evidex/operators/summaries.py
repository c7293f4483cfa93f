"""Sums over evidence, retrieved results and runs; and declared groups of synonyms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import automaton, quality

#: The authority of what a person provides without saying how good it is.
PROVIDED_AUTHORITY = 60


def evidence_summary(items: DataFrame, evidence: DataFrame, sources: DataFrame, id: str) -> DataFrame:
    """(id, n_sources, max_authority, validator_passed, human_approved) of every item.

    `evidence`: id, nth (order of time), kind (extraction, human, validator), source, excerpt, verified, provider, authority,
    passed, approved; `sources`: source, authority. Sources count that were first to say some excerpt in verified evidence,
    and people who provided evidence; the authority is the highest of all verified sources, independent or not, and of what
    people provided, 0 without any. Validators pass if there are any and none failed. An item without evidence has none.
    """
    quoted = evidence.filter("kind = 'extraction' AND verified AND source IS NOT NULL")
    first = quality.independent_sources(quoted, id, "excerpt", "source", "nth").withColumnRenamed("n_sources", "_first")
    best = quoted.select(id, "source").distinct().join(sources.select("source", "authority"), "source").groupBy(id).agg(F.max("authority").alias("_best"))
    provided = F.col("kind").eqNullSafe("human") & F.col("provider").isNotNull()
    checked = F.col("kind") == "validator"
    rest = evidence.groupBy(id).agg(
        F.countDistinct(F.when(provided, F.col("provider"))).alias("_people"),
        F.max(F.when(provided, F.coalesce("authority", F.lit(PROVIDED_AUTHORITY)))).alias("_said"),
        F.bool_and(F.when(checked, F.coalesce("passed", F.lit(False)))).alias("_passed"),
        F.bool_or((F.col("kind") == "human") & F.coalesce("approved", F.lit(False))).alias("_approved"),
    )
    out = items.select(id).join(first, id, "left").join(best, id, "left").join(rest, id, "left")
    zero = F.lit(0)
    return out.select(id, (F.coalesce("_first", zero) + F.coalesce("_people", zero)).alias("n_sources"), F.coalesce(F.greatest("_best", "_said"), zero).alias("max_authority"), F.coalesce("_passed", F.lit(False)).alias("validator_passed"), F.coalesce("_approved", F.lit(False)).alias("human_approved"))


def item_facts(items: DataFrame, evidence: DataFrame, asked: DataFrame, id: str, facts: list[str]) -> DataFrame:
    """(id, facts, evidence_verified, evidence_urls, validator_results) of the asked items that exist: columns of the item,
    whether any quoted evidence is verified, the evidence's addresses and the validators' results in order, empty without.
    `evidence`: id, nth, kind, verified, url, passed. An item's evidence is a bounded list."""
    some = items.join(asked.select(id).distinct(), id, "left_semi").select(id, *facts)
    mine = evidence.join(asked.select(id).distinct(), id, "left_semi")
    lists = mine.groupBy(id).agg(
        F.bool_or((F.col("kind") == "extraction") & F.coalesce("verified", F.lit(False))).alias("_verified"),
        F.array_sort(F.collect_list(F.when(F.col("url") != "", F.struct("nth", F.col("url").alias("x"))))).alias("_urls"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "validator", F.struct("nth", F.coalesce("passed", F.lit(False)).alias("x"))))).alias("_results"),
    )
    urls, results = F.coalesce("_urls.x", F.array().cast("array<string>")), F.coalesce("_results.x", F.array().cast("array<boolean>"))
    return some.join(lists, id, "left").select(id, *facts, F.coalesce("_verified", F.lit(False)).alias("evidence_verified"), urls.alias("evidence_urls"), results.alias("validator_results"))


def mean(value: Column, digits: int = 10) -> Column:
    """A mean over what is known, from exact sums, so that no order of addition changes it; null where nothing is known."""
    return F.round(F.sum(value.cast("decimal(28, 10)")).cast("double") / F.count(value), digits)


def offline_aggregate(results: DataFrame, dataset: str, measures: list[str], covered: str) -> DataFrame:
    """(dataset, questions, each measure's mean, fully_covered): unknown measures are left out of their mean, and a question
    is fully covered where `covered` is 1."""
    return results.groupBy(dataset).agg(F.count("*").alias("questions"), *(mean(F.col(m)).alias(m) for m in measures), F.count_if(F.col(covered) == 1).alias("fully_covered"))


def run_configuration(items: DataFrame, domain: str, status: str, settings: dict) -> DataFrame:
    """(domain, configuration): what a run ran with, as JSON by name: the settings, and how many items stood in each status."""
    per = items.groupBy(domain, status).agg(F.count("*").alias("_n"))
    counts = per.groupBy(domain).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(status).cast("string").alias("s"), "_n"))), lambda x: F.concat(F.lit('"'), x["s"], F.lit('":'), x["_n"].cast("string"))), ",").alias("_counts"))
    head = json.dumps(settings, sort_keys=True, separators=(",", ":"))[:-1]
    return counts.select(domain, F.concat(F.lit(head + ("," if settings else "") + '"knowledge_counts":{'), "_counts", F.lit("}}")).alias("configuration"))


def synonyms(questions: DataFrame, id: str, text: str, groups: DataFrame) -> DataFrame:
    """(id, added): the members of declared groups that a question lacks, where another member of the group occurs as a whole
    word, sorted. `groups`: group, member. Case doesn't count; a question without any has no row."""
    members = groups.select("group", F.lower(F.trim("member")).alias("member")).filter("member <> ''").distinct()
    low = questions.select(id, F.lower(text).alias("_text"))
    held = automaton.found(low, id, "_text", members.select("member").distinct().withColumn("phrase", F.col("member")), "member", "phrase", whole_words=True).select(id, "member")
    hit = held.join(members, "member").select(id, "group").distinct()
    missing = hit.join(members, "group").select(id, "member").distinct().join(held, [id, "member"], "left_anti")
    return missing.groupBy(id).agg(F.array_sort(F.collect_list("member")).alias("added"))  # at most the members of a question's groups
