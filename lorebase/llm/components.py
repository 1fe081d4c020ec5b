"""Pairwise matches to groups by seed-tree pruning.

Every vertex proposes the smallest vertex of its neighbourhood to all of that neighbourhood. A vertex that nobody proposes is done: it leaves the graph
and hangs below the smallest vertex proposed to it, in a propagation forest. The smallest proposals of a vertex are linked with its
others for the next round. When no link is left, the vertices that remain are seeds, and their ids flow down the forest, doubling the
distance each round.

Vertices are ids (strings). Joins are on vertices of the current graph; minima and distinct proposals are aggregated before they are shuffled, so
a hub costs its links once and never meets in one task. Rounds are written to the shared folder.

Defined results: null, blank and self links are no links; repeated links and both directions are one; a member list links its distinct members;
the group id is the smallest id; vertices without a link have no row; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.ids import canonical_id, said
from lorebase.session import Scratch, is_empty


def match_links(pairs: DataFrame) -> DataFrame:
    """(u, v) of the pairs judged the same."""
    return pairs.filter(said("relation") == "same").select(canonical_id("a_id").alias("u"), canonical_id("b_id").alias("v"))


def member_links(proposals: DataFrame) -> DataFrame:
    """(u, v): each member of an open or applied duplicate proposal with the smallest one, which links them all."""
    ids = F.array_distinct(F.filter(F.transform("member_ids", canonical_id), lambda x: x.isNotNull()))
    live = proposals.filter((said("kind") == "duplicate") & said("status").isin("pending", "applied"))
    return live.select(ids.alias("m")).select(F.array_min("m").alias("u"), F.explode("m").alias("v"))


def _both_ways(links: DataFrame) -> DataFrame:
    one = links.filter("u is not null and v is not null and u <> v")
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def connected(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links: (u, v). Gives (group_id, mem_id): one row for each vertex, group_id the smallest vertex it is linked to."""
    scratch = Scratch(spark, "components")
    graph = scratch.keep(_both_ways(links))
    forest: list[DataFrame] = []
    vertices = graph
    while not is_empty(graph):
        low = graph.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        # (v, low): the minimum of u's neighbourhood, proposed to each neighbour v and to u itself
        offered = graph.join(low, "u").select("v", "low").unionByName(low.select(F.col("u").alias("v"), "low"))
        offered = scratch.keep(offered.distinct())
        least = offered.groupBy("v").agg(F.min("low").alias("least"), F.max(F.col("low") == F.col("v")).alias("stays"))
        least = scratch.keep(least)
        forest.append(least.filter("not stays").select(F.col("v").alias("id"), F.col("least").alias("parent")))
        links = offered.join(least, "v").filter("low <> least").select(F.col("low").alias("u"), F.col("least").alias("v"))
        new = scratch.keep(_both_ways(links))
        scratch.drop(offered, graph if graph is not vertices else None)
        graph = new
    if not forest:
        return vertices.select(F.col("u").alias("group_id"), F.col("v").alias("mem_id"))
    tree = forest[0]
    for f in forest[1:]:
        tree = tree.unionByName(f)
    # seeds flow down: every vertex's pointer doubles its distance until it is a seed
    active, pointers, done = scratch.keep(tree.select("id", F.col("parent").alias("ptr"))), None, []
    pointers = active
    while True:
        ahead = pointers.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"))
        moved = scratch.keep(active.join(ahead, "ptr", "left").select("id", F.coalesce("far", "ptr").alias("ptr"), F.col("far").isNull().alias("at_seed")))
        done.append(moved.filter("at_seed").select("id", "ptr"))
        active = moved.filter("not at_seed").select("id", "ptr")
        if is_empty(active):
            break
        pointers = active
        for d in done:
            pointers = pointers.unionByName(d)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.select(F.col("ptr").alias("group_id"), F.col("id").alias("mem_id"))
    seeds = out.select("group_id").distinct().select("group_id", F.col("group_id").alias("mem_id"))
    return out.unionByName(seeds)


def groups(spark: SparkSession, pairs: DataFrame, proposals: DataFrame) -> DataFrame:
    return connected(spark, match_links(pairs).unionByName(member_links(proposals)))
