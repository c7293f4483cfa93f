"""Item lifecycle: transitions, versions, reviews, derived items, revalidation, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: What a review action makes of an item.
REVIEW = {"approve": "VERIFIED", "reject": "REJECTED", "stale": "STALE", "supersede": "SUPERSEDED"}
#: Shares of the weakest premise's confidence that a derived item has, with all premises live and without.
DISCOUNT, DEAD = 0.9, 0.5


def source_class(discovered: Column) -> Column:
    """Discovered sources belong to the community, others are external; authority plays no part."""
    return F.when(discovered, "community").otherwise("external")


def origin(validated: Column) -> Column:
    return F.when(validated, "EXPERIMENTALLY_VALIDATED").otherwise("DIRECT")


def illegal_transitions(log: DataFrame, key: str, order: str, state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """(key, order, before, state): consecutive states of a key that no allowed transition leads between."""
    w = Window.partitionBy(key).orderBy(order)
    legal = F.lit(False)
    for a, b in allowed:
        legal = legal | ((F.col("before") == a) & (F.col(state) == b))
    return log.withColumn("before", F.lag(state).over(w)).filter(F.col("before").isNotNull() & ~legal).select(key, order, "before", state)


def new_evidence(found: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Evidence that an item doesn't cite yet, once each."""
    return found.select(*key).distinct().join(known.select(*key).distinct(), key, "left_anti")


def confirmed(evidence: DataFrame, unchanged: DataFrame, item: str, source: str, kept: Column) -> DataFrame:
    """Items with kept evidence from a source that a crawl found unchanged."""
    return evidence.filter(kept).join(unchanged.select(source), source, "left_semi").select(F.col(item).alias("item")).distinct()


def rederived(items: DataFrame, evidence: DataFrame, sources: DataFrame, item: str, source: str, live: Column, verified: Column) -> DataFrame:
    """Live items with verified evidence from sources whose class has changed: their provenance is due."""
    touched = evidence.filter(verified).join(sources.select(source), source, "left_semi").select(item)
    return items.filter(live).join(touched, item, "left_semi").select(F.col(item).alias("item"))


def version_keys(items: DataFrame, key: list[str], id: str) -> DataFrame:
    """(key, n, latest): items that claim the same of the same subject, whatever the version."""
    return items.groupBy(*key).agg(F.count("*").alias("n"), F.max(id).alias("latest"))


def supersede_effect(pairs: DataFrame, dependents: DataFrame) -> DataFrame:
    """(src, dst, relation): a new item supersedes its old one, and what depended on the old depends on the new.
    `pairs`: old_id, new_id; `dependents`: item, depends_on."""
    moved = dependents.join(pairs, dependents.depends_on == pairs.old_id).select(F.col("item").alias("src"), F.col("new_id").alias("dst"), F.lit("depends_on").alias("relation"))
    return pairs.select(F.col("new_id").alias("src"), F.col("old_id").alias("dst"), F.lit("supersedes").alias("relation")).union(moved).distinct()


def review_log(events: DataFrame, item: str, at: str, resolved: Column, most: int = 50) -> DataFrame:
    """(item, first_flagged, n_log, n_resolved): a bounded log per item."""
    return events.groupBy(F.col(item).alias("item")).agg(F.min(at).alias("first_flagged"), F.least(F.count("*"), F.lit(most)).alias("n_log"), F.count_if(resolved).alias("n_resolved"))


def reviewed(items: DataFrame, id: str, status: Column, action: Column, open_conflict: Column) -> DataFrame:
    """(item, status, closes_conflicts) after review actions; reopening or no action keeps the status given, approval
    closes the item's open conflicts."""
    after = F.coalesce(*(F.when(action == a, s) for a, s in REVIEW.items()), status)
    return items.select(F.col(id).alias("item"), after.alias("status"), ((action == "approve") & open_conflict).alias("closes_conflicts"))


def resolved(conflicts: DataFrame, keep: Column) -> DataFrame:
    """(item, status): what keeping a, b, both or neither side of a conflict makes of its items. `conflicts`: a_id, b_id."""
    sides = []
    for own in ("a", "b"):
        status = F.when(keep.isin(own, "both"), "VERIFIED").when(keep == "neither", "REJECTED").otherwise("SUPERSEDED")
        sides.append(conflicts.select(F.col(f"{own}_id").alias("item"), status.alias("status")))
    return sides[0].union(sides[1])


def derived_scores(items: DataFrame, premises: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, confidence, level, status) of derived items, by fixpoint over their premises, which may be derived as well.

    `items`: id, confidence, level, status, superseded_by, approved; `premises`: id (of the derived item), premise. A
    superseded premise whose successor is a premise too is left out. With all premises live an item has DISCOUNT of the
    weakest confidence and the least level, 3 at most; else DEAD of it and level 0. It is SUPPORTED at most until approved
    (then level 5 and VERIFIED), and STALE once a premise dies that it was settled on. Each round is staged; a round that
    changes nothing ends it, and one beyond `most_rounds` raises, as premises then run in a circle.
    """
    derived = premises.select("id").distinct()
    own = items.join(derived, "id", "left_semi").select("id", F.col("status").alias("was"), "approved")
    now = staged(items.select("id", F.col("confidence").cast("double").alias("confidence"), F.col("level").cast("int").alias("level"), "status"), "derived")
    succeeded = premises.join(items.select(F.col("id").alias("premise"), "superseded_by"), "premise", "left")
    carried = premises.select("id", F.col("premise").alias("superseded_by"))
    used = staged(succeeded.join(carried.withColumn("_there", F.lit(True)), ["id", "superseded_by"], "left").filter("_there IS NULL").select("id", "premise"), "premises")
    for _ in range(most_rounds):
        of = used.join(now.withColumnRenamed("id", "premise"), "premise", "left")
        live = F.coalesce(F.col("status").isin("SUPPORTED", "VERIFIED"), F.lit(False))
        sums = of.groupBy("id").agg(F.min(F.coalesce("confidence", F.lit(0.0))).alias("weakest"), F.min(F.coalesce("level", F.lit(0))).alias("lowest"), F.bool_and(live).alias("alive"))
        rows = own.join(sums, "id", "left")
        alive = F.coalesce("alive", F.lit(False))
        level = F.when(F.col("approved"), 5).otherwise(F.when(alive, F.least("lowest", F.lit(3))).otherwise(0))
        target = F.when(F.col("approved"), "VERIFIED").when(alive & (level >= 1), "SUPPORTED").otherwise("CANDIDATE")
        settled = F.col("was").isin("SUPPORTED", "VERIFIED")
        status = (
            F.when(F.col("was").isin("REJECTED", "SUPERSEDED", "CONFLICTED"), F.col("was"))
            .when(F.col("was") == "STALE", F.when(alive & (target != "CANDIDATE"), target).otherwise("STALE"))
            .when((target == "CANDIDATE") & settled, "STALE")
            .when((F.col("was") == "VERIFIED") & (target == "SUPPORTED"), "VERIFIED")
            .otherwise(target)
        )
        made = rows.select("id", F.round(F.coalesce("weakest", F.lit(0.0)).cast("decimal(20,6)") * F.when(alive, F.lit(DISCOUNT).cast("decimal(3,2)")).otherwise(F.lit(DEAD).cast("decimal(3,2)")), 4).cast("double").alias("confidence"), level.cast("int").alias("level"), status.alias("status"))
        after = staged(now.join(derived, "id", "left_anti").unionByName(made), "derived")
        changed = not after.exceptAll(now).isEmpty()
        now = after
        if not changed:
            return now.join(derived, "id", "left_semi")
    raise RuntimeError("derived items run in a circle")


def entry_problems(entries: DataFrame, premises: DataFrame, items: DataFrame, types: list[str]) -> DataFrame:
    """(id, problems): what keeps a human or derived entry out. `entries`: id, statement, knowledge_type, origin, rationale;
    `premises`: id, premise; `items`: id, status. A derived entry wants a premise, a synthesized one two, both a rationale
    and live premises; every entry a statement, a known type, and no item with the same statement."""
    alive = items.filter(F.col("status").isin("SUPPORTED", "VERIFIED")).select(F.col("id").alias("premise"), F.lit(1).alias("_live"))
    counts = premises.distinct().join(alive, "premise", "left").groupBy("id").agg(F.count("*").alias("_n"), F.count("_live").alias("_alive"))
    rows = entries.join(counts, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_alive", F.coalesce("_alive", F.lit(0)))
    known = items.select(F.col("statement").alias("statement"), F.lit(True).alias("_known")).filter("statement IS NOT NULL").distinct()
    rows = rows.join(known, "statement", "left")
    made = F.col("origin").isin("DERIVED", "SYNTHESIZED")
    found = {
        "no statement": F.trim(F.coalesce("statement", F.lit(""))) == "",
        "unknown type": ~F.col("knowledge_type").isin(types),
        "no rationale": made & (F.trim(F.coalesce("rationale", F.lit(""))) == ""),
        "too few premises": F.col("_n") < F.when(F.col("origin") == "SYNTHESIZED", 2).when(F.col("origin") == "DERIVED", 1).otherwise(0),
        "premise not live": F.col("_alive") < F.col("_n"),
        "duplicate": F.coalesce("_known", F.lit(False)),
    }
    return rows.select("id", F.array_compact(F.array(*(F.when(c, name) for name, c in found.items()))).alias("problems"))


def pointless(done: DataFrame, changes: DataFrame, id: str, at: str) -> DataFrame:
    """(item, pointless): whether an item's last revalidation ended after its last change, so that another finds nothing new."""
    last = done.groupBy(id).agg(F.max(at).alias("_done"))
    changed = changes.groupBy(id).agg(F.max(at).alias("_changed"))
    return changed.join(last, id, "left").select(F.col(id).alias("item"), F.coalesce(F.col("_done") > F.col("_changed"), F.lit(False)).alias("pointless"))


def revalidated(items: DataFrame, failed: DataFrame, conflicts: DataFrame, open_dependencies: DataFrame) -> DataFrame:
    """(id, status, flag_cleared): flagged items after their validators, conflicts and dependencies were looked at again.
    A failed validator makes an item stale, a conflict marks it, and the flag goes only where no dependency is unresolved."""
    def has(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("id").distinct().withColumn(name, F.lit(True))

    rows = items.join(has(failed, "_failed"), "id", "left").join(has(conflicts, "_conflict"), "id", "left").join(has(open_dependencies, "_open"), "id", "left")
    status = F.when(F.col("_conflict"), "CONFLICTED").when(F.col("_failed"), "STALE").otherwise(F.col("status"))
    return rows.select("id", status.alias("status"), F.col("_open").isNull().alias("flag_cleared"))


def finalized(jobs: DataFrame, run: str, kind: str, amount: Column, unfinished: Column, dead: Column) -> DataFrame:
    """(run, kind, total, n_done, n_dead) of runs and kinds of which no job is unfinished. Sums are exact decimals."""
    out = jobs.groupBy(F.col(run).alias("run"), kind).agg(F.sum(amount.cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("n_done"), F.count_if(dead).alias("n_dead"), F.count_if(unfinished).alias("_left"))
    return out.filter("_left = 0").drop("_left")


def retries(sections: DataFrame, attempts: Column, failed: Column, most: int = 3, base: int = 120) -> DataFrame:
    """The failed sections that may be tried again, with the delay in seconds, doubled after each attempt."""
    return sections.filter(failed & (attempts <= most)).withColumn("delay_s", (base * F.pow(F.lit(2), attempts - 1)).cast("int"))


def single_flight(requests: DataFrame, key: list[str], id: str) -> DataFrame:
    """(key, accepted, n_rejected): of requests for the same the first runs."""
    return requests.groupBy(*key).agg(F.min(id).alias("accepted"), (F.count("*") - 1).alias("n_rejected"))


def layered(*layers: tuple[str, Column], default: str = "default") -> Column:
    """The name of the first layer whose value is set."""
    return F.coalesce(*(F.when(value, name) for name, value in layers), F.lit(default))
