"""Dependency graphs: closure by distance, propagation, mirror chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def closure(edges: DataFrame, roots: DataFrame, most_hops: int = 50) -> DataFrame:
    """(root, node, hops, parent) for every node that depends, over any number of edges, on a root.

    `edges`: src depends on dst; `roots`: node. Breadth first: each round joins the frontier with the edges and drops
    pairs already reached, so diamonds and cycles are met once. The shortest distance counts; of parents at that
    distance the smallest. Rounds are staged, so the plan doesn't grow.
    """
    start = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("hops"), F.lit(None).cast(roots.schema["node"].dataType).alias("parent"))
    reached = frontier = staged(start.distinct(), "frontier")
    for hops in range(1, most_hops + 1):
        step = frontier.select("root", F.col("node").alias("dst")).join(edges.select("src", "dst"), "dst")
        new = step.groupBy("root", F.col("src").alias("node")).agg(F.min("dst").alias("parent")).select("root", "node", F.lit(hops).alias("hops"), "parent")
        frontier = staged(new.join(reached.select("root", "node"), ["root", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return reached.filter("hops > 0")
        reached = reached.unionByName(frontier)
    raise RuntimeError(f"the closure goes on beyond {most_hops} hops")


def reachable(edges: DataFrame, pairs: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(start, target, reachable) for `pairs`: whether the target depends, over any number of edges, on the start; a node
    reaches itself. Repeated pairs count once; nodes without edges reach nothing else; cycles end.

    Each pair has two frontiers, one up from the target along what it depends on, one down from the start along its
    dependents, and only the one with the fewer edges ahead moves. A pair is settled when its sides meet or one of them has
    nowhere to go, so a node of many dependents is never opened for a pair that the other side settles.
    """
    links = staged(edges.select("src", "dst").distinct(), "links")
    up, down = links.select(F.col("src").alias("node"), F.col("dst").alias("next")), links.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    sides = {"up": up, "down": down}
    degree = {k: staged(e.groupBy("node").agg(F.count("*").alias("_ahead")), "degrees") for k, e in sides.items()}
    asked = staged(pairs.select("start", "target").distinct(), "pairs")
    settled = asked.filter("start = target").select("start", "target", F.lit(True).alias("reachable"))
    live = asked.filter("start <> target")
    front = {"up": live.select("start", "target", F.col("target").alias("node")), "down": live.select("start", "target", F.col("start").alias("node"))}
    front = seen = {k: staged(f, "frontier") for k, f in front.items()}
    key = ["start", "target"]
    for _ in range(most_rounds):
        cost = None
        for k in sides:  # edges ahead of each side of each pair that is still open
            ahead = front[k].join(degree[k], "node", "left").groupBy(*key).agg(F.sum(F.coalesce("_ahead", F.lit(0))).alias(k))
            cost = ahead if cost is None else cost.join(ahead, key, "full_outer")
        cost = staged(cost.select(*key, *(F.coalesce(k, F.lit(0)).alias(k) for k in sides)), "costs")
        if cost.isEmpty():
            return settled
        ended = cost.filter("up = 0 OR down = 0").select(*key, F.lit(False).alias("reachable"))
        moving = {"up": cost.filter("up > 0 AND down > 0 AND up <= down").select(*key), "down": cost.filter("down > 0 AND down < up").select(*key)}
        new, met = {}, None
        for k, other in (("up", "down"), ("down", "up")):
            step = front[k].join(moving[k], key, "left_semi").join(sides[k], "node").select(*key, F.col("next").alias("node")).distinct()
            new[k] = staged(step.join(seen[k], [*key, "node"], "left_anti"), "frontier")
            both = new[k].join(seen[other], [*key, "node"], "left_semi").select(*key)
            met = both if met is None else met.union(both)
        met = staged(met.distinct(), "met")
        settled = settled.union(ended).union(met.select(*key, F.lit(True).alias("reachable")))
        open_ = staged(moving["up"].union(moving["down"]).join(met, key, "left_anti"), "open")
        stay = {"up": moving["down"], "down": moving["up"]}
        seen = {k: staged(seen[k].union(new[k]).join(open_, key, "left_semi"), "seen") for k in sides}
        front = {k: staged(new[k].union(front[k].join(stay[k], key, "left_semi")).join(open_, key, "left_semi"), "frontier") for k in sides}
    raise RuntimeError(f"pairs are open after {most_rounds} rounds")


def frontier(seeds: DataFrame, links: DataFrame, scope: DataFrame, id: str, max_depth: int, max_pages: int) -> DataFrame:
    """(seed, id, depth) of the pages that a crawl visits from each seed: breadth first along `links` (src, dst) within
    `scope` (id), a page once, down to `max_depth`, and the first `max_pages` by depth and id."""
    start = seeds.select(F.col(id).alias("seed"), id, F.lit(0).alias("depth"))
    seen = layer = staged(start, "frontier")
    for depth in range(1, max_depth + 1):
        step = layer.select("seed", F.col(id).alias("src")).join(links, "src").select("seed", F.col("dst").alias(id)).distinct()
        layer = staged(step.join(scope.select(id), id, "left_semi").join(seen.select("seed", id), ["seed", id], "left_anti").select("seed", id, F.lit(depth).alias("depth")), "frontier")
        if layer.isEmpty():
            break
        seen = seen.unionByName(layer)
    nth = F.row_number().over(Window.partitionBy("seed").orderBy("depth", id))
    return seen.withColumn("_n", nth).filter(F.col("_n") <= max_pages).drop("_n")


def flag_dependents(closed: DataFrame, items: DataFrame, labels: str = "status") -> DataFrame:
    """(node, root, hops, reason) for reached items that are neither rejected nor superseded; the nearest root gives the reason."""
    live = closed.join(items.select("node", labels), "node").filter(~F.col(labels).isin("REJECTED", "SUPERSEDED"))
    near = live.groupBy("node").agg(F.min(F.struct("hops", "root", "parent")).alias("n"))
    reason = F.left(F.format_string("depends on %s through %s (%d hops)", F.col("n.root"), F.col("n.parent"), F.col("n.hops")), F.lit(500))
    return near.select("node", F.col("n.root").alias("root"), F.col("n.hops").alias("hops"), reason.alias("reason"))


def chain_roots(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) of chains node -> parent by pointer jumping: distances double each round. On a cycle the smallest node
    that the jumps reach is the root. Raises if chains are longer than `most_rounds` doublings reach."""
    now = staged(links.select("node", F.col("parent").alias("root")), "chains")
    for _ in range(most_rounds):
        up = now.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        far = staged(now.join(up, now.root == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("next"), "root"), "chains")
        if far.filter("next <> root AND next <> node").isEmpty():
            return now
        now = far.select("node", F.when(F.col("next") == F.col("node"), F.least("root", "node")).otherwise(F.col("next")).alias("root"))
    raise RuntimeError("chains did not settle")


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component): connected components of undirected edges (a, b), named by their smallest node.

    Alternating stars: a round ties each node's larger neighbours, then its smaller ones, to the smallest node around, until
    every node is tied to its component's smallest. Edges stay as many as they were, and a round is two sums by node.
    """


    def state(rows: DataFrame):
        h = F.xxhash64("a", "b")
        return rows.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 30)))).first()

    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    was = state(now)
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("_m", "a").alias("_m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        large = staged(large, "stars")
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("_m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_m").alias("b"))
        after = staged(small.filter("a <> b").distinct(), "stars")
        is_ = state(after)
        if is_ == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        now, was = after, is_
    raise RuntimeError("components did not settle")
