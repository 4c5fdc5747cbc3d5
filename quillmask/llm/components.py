"""Connected components of links between numbers, as rounds of joins (large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


#: Hubs at once: each has more than this part of the links. Below so many links in all, a task can hold any hub's.
HUBS, HUB_LINKS = 1000, 1_000_000


def _star(edges: DataFrame, links: int, large: bool, hub_links: int) -> DataFrame:
    """Each node's neighbours are tied to the smallest of them and the node: the larger neighbours (large) or the others (small). links is how many edges there are."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    if links < hub_links:
        tied = both.join(least, "u")
    else:  # a hub's links look its minimum up in a table of fewer than HUBS rows, by arithmetic; all others meet theirs in a join
        is_hub = F.col("n") * HUBS > links * (2 if large else 1)
        hubs = F.broadcast(least.where(is_hub).select("u", "m"))
        tied = both.join(hubs, "u").select("u", "v", "m").union(both.join(hubs, "u", "left_anti").join(least.where(~is_hub), "u").select("u", "v", "m"))
    if large:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 60, hub_links: int = HUB_LINKS) -> DataFrame:
    """(node, component) for every node of edges (u, v), any integers: the component is the smallest node that can be reached.

    A round is two joins on the links left, which end up as one link from each node to its component; a node's minimum is found by partial aggregation, and no hub's links meet in one task beyond hub_links. Each round's links are written to the shared folder, the round before is removed. Raises if the rounds don't suffice, rather than return half a result.
    """
    now = cut(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    total = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()[:2]
    before = total(now)
    for _ in range(rounds):
        # the first star leaves a link for each of its rows at most, so its count serves for both
        new = cut(_star(_star(now, before[0], True, hub_links), before[0], False, hub_links))
        drop(now)
        now, after = new, total(new)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError(f"the components didn't settle in {rounds} rounds")
