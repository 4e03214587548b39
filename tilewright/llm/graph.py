"""Connected components of a table of links, without gathering any group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import saved


#: A node with over a hundredth of all links is a hub: there are at most a hundred for each direction.
HUB, LEAST_HUB = 100, 10_000


def with_least(links: DataFrame, total: int) -> DataFrame:
    """(a, b, m) for links in both directions: m is the least of a and all its neighbours. Counted before the shuffle, and joined back by
    a; hubs, whose number is bounded, are sent to all instead, so that no task gets a hub's links."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
    if total < LEAST_HUB:
        return links.join(least.drop("_n").hint("merge"), "a")
    hub = F.col("_n") > total // HUB
    hubs = F.broadcast(least.filter(hub).drop("_n"))
    known = links.join(hubs.withColumnRenamed("m", "_h"), "a", "left")
    rest = known.filter("_h IS NULL").drop("_h").join(least.filter(~hub).drop("_n").hint("merge"), "a")
    return known.filter("_h IS NOT NULL").select("a", "b", F.col("_h").alias("m")).unionByName(rest)


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): every node of `links` (two long columns a, b) with the least node that it reaches.

    Alternates two steps until nothing changes: each node's larger neighbours are tied to the least one (large star), then
    its smaller neighbours and itself (small star). In the end each node is tied to its component's least alone. Every
    round's links are written to the shared folder. Nulls and links of a node with itself are left out; such a node has no row.
    """
    now = saved(links.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, total = None, now.count()
    for _ in range(rounds):
        both = with_least(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * total)
        large = both.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = with_least(large, 2 * total)
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        now = saved(small, "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        total = state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
