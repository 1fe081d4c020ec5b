"""Parent-child links to full hierarchies by pointer doubling.

Every node starts with a pointer to its parent. A round joins the pointers of all unresolved nodes with the pointers of the nodes they point to, so
the distance doubles and the path segments are joined. A node is resolved when its pointer is a root. A tree of depth d resolves nodes of every
depth up to d, so the first round that resolves nothing leaves only nodes that run into a cycle.

Defined results: the newest version of an id counts (latest ``updated_at``, then largest ``line_no``); a parent that is null, blank or unknown makes a
root; a node that is its own parent is a cycle of one; nodes on or above a cycle get depth -1, as root the smallest id of the
cycle and no path; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.ids import canonical_id
from lorebase.session import Scratch, is_empty


def newest_links(memories: DataFrame) -> DataFrame:
    """id, parent of the newest version of each id; parent is null where it names nothing known."""
    newest = (
        memories.select(canonical_id("id").alias("id"), "updated_at", "line_no", canonical_id("supersedes").alias("p"))
        .filter("id is not null")
        .groupBy("id")
        .agg(F.max(F.struct("updated_at", "line_no", "p")).getField("p").alias("p"))
    )
    return newest


def known_links(nodes: DataFrame) -> DataFrame:
    """(id, p) of nodes whose parent is a node: the parent is looked up among all ids."""
    ids = nodes.select(F.col("id").alias("p"))
    return nodes.filter("p is not null").join(ids, "p", "left_semi").select("id", F.col("p").alias("parent"))


def resolve(
    spark: SparkSession, links: DataFrame, paths: bool = False, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame]:
    """links: (id, parent), one row per id, parents known. Gives (trees, cycles):

    trees (id, root, depth and, if asked for, path: from the parent up to the root), stuck (id, ptr): the nodes that run into a cycle, and how far
    their pointers came.
    """
    scratch = scratch or Scratch(spark, "hierarchy")
    segment = F.array("parent") if paths else F.lit(None).cast("array<string>")
    # ptr: the node reached, jump: steps to it, seg: the nodes on the way
    active = links.select("id", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("jump"), segment.alias("seg"))
    done: list[DataFrame] = []
    pointers = active
    while True:
        ahead = pointers.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("jump").alias("more"), F.col("seg").alias("rest"))
        moved = active.join(ahead, "ptr", "left")
        both = scratch.keep(
            moved.select(
                "id",
                F.coalesce("far", "ptr").alias("ptr"),
                (F.col("jump") + F.coalesce("more", F.lit(0))).alias("jump"),
                (F.concat("seg", F.coalesce("rest", F.array().cast("array<string>"))) if paths else F.col("seg")).alias("seg"),
                F.col("far").isNull().alias("at_root"),
            )
        )
        n_done, n_left = both.agg(F.count_if("at_root"), F.count_if(~F.col("at_root"))).first()
        active = both.filter("not at_root").drop("at_root")
        if not n_done or not n_left:
            left = active
            done += [both.drop("at_root")] if n_done else []
            break
        # a node that is done keeps its final pointer: others may still point to it
        done.append(both.filter("at_root").drop("at_root"))
        pointers = active.unionByName(_all(done))
    trees = _all(done) if done else left.limit(0)
    trees = trees.select("id", F.col("ptr").alias("root"), F.col("jump").alias("depth"), F.col("seg").alias("path"))
    return trees, left.select("id", "ptr")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cycle_roots(links: DataFrame, stuck: DataFrame, scratch: Scratch) -> DataFrame:
    """stuck: (id, ptr), all running into cycles. Gives (id, root): the smallest id of the cycle.

    The pointers go on doubling until the set of nodes they reach stays the same: that set is the nodes of the cycles. Doubling over
    these alone then carries the minimum round; when it is the same at both ends of every jump, the whole cycle has it.
    """
    if is_empty(stuck):
        return stuck.select("id", F.col("ptr").alias("root"))
    reached = stuck.select("ptr").distinct().count()
    while True:
        moved = stuck.join(stuck.select(F.col("id").alias("ptr"), F.col("ptr").alias("far")), "ptr")
        stuck = scratch.keep(moved.select("id", F.col("far").alias("ptr")))
        before, reached = reached, stuck.select("ptr").distinct().count()
        if reached == before:
            break
    on = stuck.select(F.col("ptr").alias("id")).distinct()
    ring = scratch.keep(links.join(on, "id", "left_semi").select("id", F.col("parent").alias("ptr"), F.least("id", "parent").alias("low")))
    while True:
        ahead = ring.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("low").alias("low2"))
        both = ring.join(ahead, "ptr")
        low = F.least("low", "low2").alias("low")
        moved = scratch.keep(both.select("id", F.col("far").alias("ptr"), low, (F.col("low") != F.col("low2")).alias("uneven")))
        ring = moved.drop("uneven")
        if is_empty(moved.filter("uneven")):
            break
    return stuck.join(ring.select(F.col("id").alias("ptr"), F.col("low").alias("root")), "ptr").select("id", "root")


def hierarchy(spark: SparkSession, memories: DataFrame, paths: bool = False) -> DataFrame:
    """One row per id that has a parent: id, root, depth, is_cycle and, if asked for, path (parent first, root last)."""
    scratch = Scratch(spark, "hierarchy")
    nodes = scratch.keep(newest_links(memories))
    links = scratch.keep(known_links(nodes))
    trees, stuck = resolve(spark, links, paths, scratch)
    rings = cycle_roots(links, stuck, scratch)
    found = trees.select("id", "root", "depth", "path", F.lit(False).alias("is_cycle")).unionByName(
        rings.select("id", "root", F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path"), F.lit(True).alias("is_cycle"))
    )
    return found if paths else found.drop("path")


def full_hierarchy(spark: SparkSession, memories: DataFrame) -> DataFrame:
    """One row per memory: id, root, depth, path from the root down to the node, n_descendants, is_cycle."""
    scratch = Scratch(spark, "hierarchy-all")
    found = scratch.keep(hierarchy(spark, memories, paths=True))
    ids = newest_links(memories).select("id")
    below = found.filter("not is_cycle").select(F.explode("path").alias("id")).groupBy("id").agg(F.count("*").alias("n_descendants"))
    out = ids.join(found, "id", "left").join(below, "id", "left")
    return out.select(
        "id",
        F.coalesce("root", "id").alias("root"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        F.when(F.coalesce("is_cycle", F.lit(False)), F.lit(None).cast("string"))
        .otherwise(F.concat_ws("/", F.reverse(F.coalesce("path", F.array().cast("array<string>"))), "id"))
        .alias("path"),
        F.coalesce("n_descendants", F.lit(0).cast("long")).alias("n_descendants"),
        F.coalesce("is_cycle", F.lit(False)).alias("is_cycle"),
    )


def descendants(spark: SparkSession, memories: DataFrame) -> DataFrame:
    """All pairs (ancestor, descendant, distance) of the trees."""
    found = hierarchy(spark, memories, paths=True).filter("not is_cycle")
    return found.select(F.posexplode("path").alias("at", "ancestor"), F.col("id").alias("descendant")).select(
        "ancestor", "descendant", (F.col("at") + 1).cast("long").alias("distance")
    )
