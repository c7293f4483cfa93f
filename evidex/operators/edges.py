"""Relations between items: opposition, conflicts, derived and qualified edges, one-hop listings.

Pairs within a key are never all listed: items that are alike form a class, a class has its smallest id as representative,
and an item has its class and the number of its partners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opposing(core_a: Column, core_b: Column, negated_a: Column, negated_b: Column, object_a: Column, object_b: Column) -> Column:
    """Whether two claims with the same core differ in negation or polarity, or in their objects."""
    return (core_a == core_b) & ((negated_a != negated_b) | (object_a != object_b))


def partners(rows: DataFrame, id: str, key: list[str], differ: list[str]) -> DataFrame:
    """(id, class_id, n_partners) of rows that share `key` with rows that differ from them in every column of `differ`.

    A class is the rows with equal key and `differ`. Partners are counted by inclusion and exclusion over sums, never by
    listing pairs.
    """
    n = len(differ)
    out = rows.select(id, *key, *differ)
    classes = rows.groupBy(*key, *differ).agg(F.min(id).alias("class_id"))
    out = out.join(classes, [*key, *differ])
    total = F.lit(0)
    for mask in range(1 << n):
        same = [c for i, c in enumerate(differ) if mask >> i & 1]
        name = f"_n{mask}"
        out = out.join(rows.groupBy(*key, *same).agg(F.count("*").alias(name)), [*key, *same])
        total = total + F.col(name) * (-1) ** len(same)
    return out.select(id, "class_id", total.alias("n_partners")).filter("n_partners > 0")


def conflicts(items: DataFrame, id: str, key: list[str], object: str, many: int = 3) -> DataFrame:
    """(id, class_id, n_partners): items with the key's other objects against them. Keys with `many` objects or more hold
    lists of values, not conflicts."""
    lists = items.groupBy(*key).agg(F.countDistinct(object).alias("_objects")).filter(F.col("_objects") >= many).select(*key)
    return partners(items.join(lists, key, "left_anti"), id, key, [object])


def to_foundation(items: DataFrame, id: str, subject: str, role: Column, relation: Column) -> DataFrame:
    """(src, foundation, n_foundations, relation): a subject's dependents and its foundations, by their representative."""
    foundations = items.filter(role == "foundation").groupBy(subject).agg(F.min(id).alias("foundation"), F.count("*").alias("n_foundations"))
    return items.filter(role == "dependent").join(foundations, subject).select(F.col(id).alias("src"), "foundation", "n_foundations", relation.alias("relation"))


def new_edges(found: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Edges not yet known, once each, without loops; the first two columns of `key` are the ends."""
    return found.filter(F.col(key[0]) != F.col(key[1])).select(*key).distinct().join(known.select(*key).distinct(), key, "left_anti")


def one_hop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n_dependents, n_dependencies) from `edges` (src depends on dst), for every node."""
    inward = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("n_dependents"))
    outward = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n_dependencies"))
    return nodes.join(inward, "node", "left").join(outward, "node", "left").select("node", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_dependents", "n_dependencies")))


def listing(edges: DataFrame) -> DataFrame:
    """(node, direction, other, label): every edge as seen from both of its ends. `edges`: src, dst, label."""
    out = edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "label")
    return out.union(edges.select(F.col("dst"), F.lit("in"), F.col("src"), "label"))


def unresolved(dependencies: DataFrame, items: DataFrame, live: Column, flagged: Column) -> DataFrame:
    """(item, dependency, why): dependencies that are missing, not live, or flagged themselves. `items` has the id `dependency`."""
    marked = items.select("dependency", live.alias("_live"), flagged.alias("_flagged"))
    why = F.when(F.col("_live").isNull(), "missing").when(~F.col("_live"), "not live").when(F.col("_flagged"), "flagged")
    return dependencies.select("item", "dependency").distinct().join(marked, "dependency", "left").select("item", "dependency", why.alias("why")).filter("why IS NOT NULL")
