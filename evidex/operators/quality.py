"""Deduplication, source independence, provenance and scoring of knowledge items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The weights of the quality score.
WEIGHTS = {"authority": 0.30, "verified": 0.15, "sources": 0.15, "specificity": 0.08, "taxonomy": 0.04, "validators": 0.13, "freshness": 0.08, "conflict": 0.05, "version": 0.02}
#: Source classes and the provenance they give.
PROVENANCE = {"official": "OFFICIAL", "external": "EXTERNAL", "community": "COMMUNITY", "organization": "ORGANIZATION"}


def exact_duplicates(rows: DataFrame, key: str, id: str) -> DataFrame:
    """(id, duplicate_of): rows whose key an earlier id has. A sum per key, then a join, so a hot key splits by AQE."""
    first = rows.groupBy(key).agg(F.min(id).alias("duplicate_of"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(first, key).filter(F.col(id) > F.col("duplicate_of")).select(id, "duplicate_of")


def folded(rows: DataFrame, key: str, id: str, evidence: list[str]) -> tuple[DataFrame, DataFrame]:
    """Duplicates folded into the row with the key's smallest id: (id, status, duplicate_of) of those rejected, and the
    survivors' evidence (id, evidence), once each, with what the duplicates cite re-attached."""
    dup = exact_duplicates(rows, key, id)
    moved = rows.join(dup, id).select(F.col("duplicate_of").alias(id), *evidence)
    own = rows.join(dup.select(F.col("duplicate_of").alias(id)).distinct(), id, "left_semi").select(id, *evidence)
    return dup.select(id, F.lit("REJECTED").alias("status"), "duplicate_of"), own.union(moved).distinct()


#: Least overlap of two statements, and greatest distance of their vectors, for near duplicates.
OVERLAP, DISTANCE = 0.6, 0.06


def same_objects(object_a: Column, all_a: Column, object_b: Column, all_b: Column) -> Column:
    """Whether each object's content words lie within the other's statement and object; all are word arrays."""
    return (F.size(F.array_except(object_a, all_b)) == 0) & (F.size(F.array_except(object_b, all_a)) == 0)


def near_duplicate(distance: Column, same_subject: Column, same_object: Column, overlap: Column, most: float = DISTANCE, least: float = OVERLAP) -> Column:
    return (distance <= most) & same_subject & same_object & (overlap >= least)


def mirrors(docs: DataFrame, id: str, source: str, signals: list[str]) -> DataFrame:
    """(id, mirror_of, signal): the earliest other document with the same first signal that any other document shares;
    none where that document has the same source. Two smallest ids per signal value are enough to know it."""
    parts = []
    for rank, signal in enumerate(signals):
        rows = docs.filter(F.col(signal).isNotNull()).select(id, signal)
        low = rows.groupBy(signal).agg(F.min(id).alias("_one"))
        second = rows.join(low, signal).filter(F.col(id) > F.col("_one")).groupBy(signal, "_one").agg(F.min(id).alias("_two"))
        found = rows.join(second, signal).select(id, F.lit(rank).alias("_rank"), F.when(F.col(id) == F.col("_one"), F.col("_two")).otherwise(F.col("_one")).alias("mirror_of"))
        parts.append(found)
    best = reduce(DataFrame.unionByName, parts).groupBy(id).agg(F.min(F.struct("_rank", "mirror_of")).alias("_best"))
    names = F.element_at(F.array(*map(F.lit, signals)), F.col("_best._rank") + 1)
    sources = docs.select(F.col(id).alias("mirror_of"), F.col(source).alias("_other"))
    picked = best.select(id, F.col("_best.mirror_of").alias("mirror_of"), names.alias("signal"))
    return picked.join(docs.select(id, source), id).join(sources, "mirror_of").filter(F.col(source) != F.col("_other")).select(id, "mirror_of", "signal")


def linked_mirrors(docs: DataFrame, id: str, source: str, signals: list[str], url: str, canonical: str, most_rounds: int = 200) -> DataFrame:
    """(id, mirror_of, signal): copies taken from another source, by three kinds of signal in order: equal values of a column
    of `signals`, then a declared canonical address that is another document's own (signal `canonical`).

    Ids are in the order of time. A document looks for the earliest earlier document that shares its first matching signal and
    is no mirror itself; if that one has another source, the document is its mirror, else it stands on its own. Nulls match
    nothing. Whether a document is a mirror depends on earlier ones alone, so each round settles all documents whose earliest
    open candidates are settled; a group waits for its first member only, and rounds are as many as the longest wait. Narrow
    rows meet by sums per signal value.
    """
    from ..session import staged

    asked = {s: (s, s) for s in signals} | {"canonical": (canonical, url)}
    rows = staged(docs.select(id, source, *signals, url, canonical), "signals")
    state = staged(rows.select(id, F.lit(None).cast("boolean").alias("_mirror")), "state")  # null: open
    links = None
    for _ in range(most_rounds):
        standing = rows.join(state, id).filter("_mirror IS NULL OR NOT _mirror")
        todo = standing.filter("_mirror IS NULL").drop("_mirror")
        parts = []
        for rank, (mine, theirs) in enumerate(asked.values()):
            held = standing.filter(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias("_v")).agg(F.min(F.struct(id, F.col("_mirror").isNull().alias("_open"), F.col(source).alias("_other"))).alias("_first"))
            hit = todo.filter(F.col(mine).isNotNull()).select(id, source, F.col(mine).alias("_v")).join(held, "_v").filter(F.col(f"_first.{id}") < F.col(id))
            parts.append(hit.select(id, source, F.lit(rank).alias("_rank"), "_first"))
        best = reduce(DataFrame.unionByName, parts).groupBy(id, source).agg(F.min(F.struct("_rank", "_first")).alias("_b"))
        best = staged(todo.select(id).join(best, id, "left"), "found")
        settled = best.filter("_b IS NULL OR NOT _b._first._open")
        other = F.coalesce(F.col("_b._first._other") != F.col(source), F.lit(False))
        now = staged(settled.select(id, other.alias("_now"), F.col(f"_b._first.{id}").alias("mirror_of"), F.col("_b._rank").alias("_rank")), "settled")
        if now.isEmpty():
            names = F.element_at(F.array(*map(F.lit, asked)), F.col("_rank") + 1)
            return links.select(id, "mirror_of", names.alias("signal"))
        more = now.filter("_now").drop("_now")
        links = more if links is None else links.unionByName(more)
        state = staged(state.join(now.select(id, "_now"), id, "left").select(id, F.coalesce("_now", "_mirror").alias("_mirror")), "state")
    raise RuntimeError("mirrors did not settle")


def independent_sources(evidence: DataFrame, item: str, excerpt: str, source: str, order: str) -> DataFrame:
    """(item, n_sources): the sources that were first to say some excerpt of the item."""
    owner = evidence.groupBy(item, excerpt).agg(F.min_by(source, order).alias("_owner"))
    return owner.groupBy(item).agg(F.countDistinct("_owner").alias("n_sources"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 where either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def freshness(seen: Column, stale: Column, now: Column) -> Column:
    """Steps by whole days of 24 hours since a source was last seen."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(seen)) / 86_400_000_000)
    steps = F.when(days < 30, 1.0).when(days < 90, 0.7).when(days < 180, 0.4).otherwise(0.2)
    return F.when(stale, 0.0).when(seen.isNull(), 0.5).otherwise(steps)


def specificity(statement: Column, has_code: Column) -> Column:
    n = F.length(statement)
    base = F.when(n < 40, 0.3).when(n < 90, 0.6).otherwise(0.8)
    return F.least(F.lit(1.0), base + F.when(statement.rlike("[0-9]"), 0.1).otherwise(0.0) + F.when(has_code, 0.1).otherwise(0.0))


def score(authority: Column, verified: Column, sources: Column, specific: Column, in_taxonomy: Column, validators: Column, fresh: Column, conflict: Column, version_ok: Column) -> tuple[Column, Column]:
    """(score, factors): the weighted sum of nine factors, rounded to 4 places, and the factors as a struct."""
    parts = {
        "authority": F.least(F.greatest(authority, F.lit(0.0)), F.lit(100.0)) / 100,
        "verified": F.when(verified, 1.0).otherwise(0.0),
        "sources": F.least(sources, F.lit(3)) / F.lit(3.0),
        "specificity": specific,
        "taxonomy": F.when(in_taxonomy, 1.0).otherwise(0.0),
        "validators": F.when(validators.isNull(), 0.5).when(validators, 1.0).otherwise(0.0),
        "freshness": fresh,
        "conflict": F.when(conflict, 0.3).otherwise(1.0),
        "version": F.when(version_ok, 1.0).otherwise(0.6),
    }
    total = reduce(lambda a, k: a + parts[k] * WEIGHTS[k], parts, F.lit(0.0))
    return F.round(total, 4), F.struct(*(v.alias(k) for k, v in parts.items()))


def level(approved: Column, sources: Column, authority: Column, validated: Column) -> Column:
    """Verification level 0 to 5."""
    some = F.greatest(F.lit(1), F.when(authority >= 80, 2).otherwise(1), F.when(sources >= 2, 3).otherwise(1), F.when(validated, 4).otherwise(1))
    return F.when(approved, 5).when(sources == 0, 0).otherwise(some)


def status_for(level_: Column, conflict: Column) -> Column:
    return F.when(conflict, "CONFLICTED").when(level_ >= 2, "VERIFIED").when(level_ >= 1, "SUPPORTED").otherwise("CANDIDATE")


#: The states an item advances through, one transition a step.
CHAIN = ["EXTRACTED", "CANDIDATE", "SUPPORTED", "VERIFIED"]


def steps_to(current: Column, target: Column) -> Column:
    """The transitions from one state of the chain to a later one; none where it isn't later."""
    chain = F.array(*map(F.lit, CHAIN))
    a, b = F.array_position(chain, current), F.array_position(chain, target)
    names = F.when((a > 0) & (b > a), F.slice(chain, a + 1, b - a)).otherwise(F.array().cast("array<string>"))
    return F.transform(names, lambda to, i: F.struct(F.element_at(chain, (a + i).cast("int")).alias("from_status"), to.alias("to_status")))


def rescored(current: Column, target: Column, verified: Column) -> Column:
    """The status after a rescore: final and conflicted states stay, a stale item needs verified evidence to come back,
    a conflict marks settled items, and otherwise an item only ever advances."""
    chain = F.array(*map(F.lit, CHAIN))
    ahead = F.array_position(chain, target) > F.array_position(chain, current)
    return (
        F.when(current.isin("REJECTED", "SUPERSEDED", "CONFLICTED"), current)
        .when(current == "STALE", F.when(verified, target).otherwise(current))
        .when(target == "CONFLICTED", F.when(current.isin("SUPPORTED", "VERIFIED"), target).otherwise(current))
        .when(ahead, target)
        .otherwise(current)
    )


def one_to_one(old: DataFrame, new: DataFrame, key: list[str], old_id: str, new_id: str) -> DataFrame:
    """(key, old_id, new_id) where a key has exactly one row on each side: two sums and a join, no windows."""
    a = old.groupBy(*key).agg(F.count("*").alias("_n"), F.min(old_id).alias(old_id)).filter("_n = 1").drop("_n")
    b = new.groupBy(*key).agg(F.count("*").alias("_n"), F.min(new_id).alias(new_id)).filter("_n = 1").drop("_n")
    return a.join(b, key)
