"""Graph reads by joins on edges: links, siblings, neighbours, version history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.session import Scratch, is_empty

NEIGHBOURS_DEFAULT, NEIGHBOURS_MOST = 50, 200
HISTORY_DEPTH = 50


def links(m: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, other, relation, way): the edges of each record in both directions."""
    ids = m.select("id")
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "relation", F.lit("out").alias("way"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "relation", F.lit("in").alias("way"))
    return out.unionByName(back).join(ids, "id", "left_semi").select("id", "other", "relation", "way")


def siblings(edges: DataFrame, relation: str = "derived_from", seeds: DataFrame | None = None) -> DataFrame:
    """(id, sibling, via): records derived from the same one. With seeds (id) only their rows."""
    e = edges.filter(F.col("relation") == relation).select(F.col("src").alias("id"), F.col("dst").alias("via"))
    left = e.join(seeds.select("id"), "id", "left_semi") if seeds is not None else e
    return left.join(e.withColumnRenamed("id", "sibling"), "via").filter("id <> sibling").select("id", "sibling", "via")


def to_insert(new: DataFrame, edges: DataFrame, m: DataFrame) -> DataFrame:
    """(src, dst, relation): of new edges those to insert, once each: between two different known records, and not there yet."""
    ids = m.select("id")
    e = new.filter("src is not null and dst is not null and src <> dst and relation is not null").select("src", "dst", "relation").distinct()
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.join(edges.select("src", "dst", "relation"), ["src", "dst", "relation"], "left_anti").select("src", "dst", "relation")


def derived_from(m: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent, mem_type, status): where each record comes from."""
    parents = m.select(F.col("id").alias("parent"), "mem_type", "status")
    return edges.filter("relation = 'derived_from'").select(F.col("src").alias("id"), F.col("dst").alias("parent")).join(parents, "parent").select("id", "parent", "mem_type", "status")


def adjacency(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(id, other, relation, via): one step out, one step in, and siblings."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "relation", F.lit("out").alias("via"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "relation", F.lit("in").alias("via"))
    both = out.unionByName(back)
    if seeds is not None:
        both = both.join(seeds.select("id"), "id", "left_semi")
    sib = siblings(edges, seeds=seeds).select("id", F.col("sibling").alias("other"), F.lit("derived_from").alias("relation"), F.lit("sibling").alias("via"))
    return both.unionByName(sib).distinct()


def neighbours(live: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, other, relation, via, created_at): live neighbours in the scopes a seed sees (the user's and its own), the seeds of the same id left out.

    seeds: (id, scope).
    """
    near = adjacency(edges, seeds)
    target = live.select(F.col("id").alias("other"), F.col("scope").alias("other_scope"), "created_at")
    seen = near.join(seeds.select("id", "scope"), "id").join(target, "other")
    return seen.filter("(other_scope = 'user' or other_scope = scope) and other <> id").select("id", "other", "relation", "via", "created_at")


def history(spark: SparkSession, m: DataFrame, seeds: DataFrame, most: int = HISTORY_DEPTH) -> DataFrame:
    """(seed, id, depth): versions before (negative depth, along supersedes) and after (positive, all that supersede it) each seed, and itself.

    Pointers of 1, 2, 4, ... steps are made by joining each with itself; every depth is a sum of such steps, so a logarithm of joins reaches them all.
    ``most`` steps each way, which also ends cycles. An id reached both ways has the shorter, on a tie the earlier one.
    """
    scratch = Scratch(spark, "history")
    known = m.select(F.col("id").alias("supersedes"))
    jump = scratch.keep(m.filter("supersedes is not null").join(known, "supersedes", "left_semi").select("id", F.col("supersedes").alias("far")))
    start = scratch.keep(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")))
    parts, step = [start], 1
    while True:
        seen = reduce(DataFrame.unionByName, parts)
        back = seen.filter("depth <= 0").join(jump.select("id", F.col("far").alias("next")), "id").select("seed", F.col("next").alias("id"), (F.col("depth") - step).alias("depth"))
        forth = seen.filter("depth >= 0").join(jump.select(F.col("far").alias("id"), F.col("id").alias("next")), "id").select("seed", F.col("next").alias("id"), (F.col("depth") + step).alias("depth"))
        # what is known stays where it is; only the new depths are written
        parts.append(scratch.keep(back.unionByName(forth)))
        step *= 2
        if step > most or is_empty(parts[-1]):
            break
        on = jump.select(F.col("id").alias("far"), F.col("far").alias("further"))
        jump = scratch.keep(jump.join(on, "far").select("id", F.col("further").alias("far")))
    both = scratch.together(parts).filter(F.abs("depth") <= most)
    return both.groupBy("seed", "id").agg(F.min_by("depth", F.struct(F.abs("depth").alias("a"), "depth")).alias("depth"))
