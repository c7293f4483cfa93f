"""A prefix index: which keys begin with which, by equality joins alone.

The lengths that the shorter side has are known per group; a longer key is cut to just those lengths, and each cut meets its
equals. A key so gives one row a length that occurs, whatever the number of keys, and no pair of keys is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def url_key(url: Column | str) -> Column:
    """Host and path, lower-cased, without slashes at the end, parameters and fragment. What has no scheme is a path."""
    url = F.coalesce(url if isinstance(url, Column) else F.col(url), F.lit(""))
    bare = F.lower(F.regexp_replace(F.regexp_extract(url, "^([^?#]*)", 1), "/+$", ""))
    return F.when(X.scheme(url) == "", bare).otherwise(X.url_key(url))


def begins_with(longer: DataFrame, shorter: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, key, prefix): keys of `longer` with those of `shorter` in the same group that they begin with, themselves
    included. Both sides are sets of (group, key)."""
    lengths = shorter.groupBy(*group).agg(F.collect_set(F.length(key)).alias("_lengths"))  # no longer than the longest key
    cuts = longer.join(lengths, group).select(*group, key, F.explode(F.filter("_lengths", lambda n: n <= F.length(key))).alias("_n"))
    cuts = cuts.select(*group, key, F.expr(f"substring(`{key}`, 1, _n)").alias("prefix"))
    return cuts.join(shorter.select(*group, F.col(key).alias("prefix")), [*group, "prefix"]).select(*group, key, "prefix")


def authoritative_recall(questions: DataFrame, sources: DataFrame, retrieved: DataFrame, question: str, url: str) -> DataFrame:
    """(question, n_sources, n_found, value, ok): the share of each question's authoritative addresses that begin with an
    address among what was retrieved, or with which one begins.

    `sources` and `retrieved`: question, url, repeated rows allowed; a source listed twice counts twice. Without sources the
    value is null and the check passes; with them it passes from one found on.
    """
    asked = sources.select(question, url_key(url).alias("_key"))
    seen = retrieved.select(question, url_key(url).alias("_key")).distinct()
    each = asked.distinct()
    deeper = begins_with(seen, each, [question], "_key").select(question, F.col("prefix").alias("_key"))
    above = begins_with(each, seen, [question], "_key").select(question, "_key")
    found = deeper.union(above).distinct().withColumn("_found", F.lit(True))
    counts = asked.join(found, [question, "_key"], "left").groupBy(question).agg(F.count("*").alias("n_sources"), F.count("_found").alias("n_found"))
    out = questions.select(question).join(counts, question, "left")
    value = F.col("n_found") / F.col("n_sources")
    return out.select(question, F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("n_found", F.lit(0)).alias("n_found"), value.alias("value"), F.coalesce(value > 0, F.lit(True)).alias("ok"))
