"""Context for a reader within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.lifecycle import latest_handoff
from lorebase.operators.records import stale_ids, topk_per
from lorebase.sources.records import live

BUDGET, BUDGET_LEAST, BUDGET_MOST = 2000, 200, 32_000
READER_BYTES = 20_000
SECTION_MOST, EPISODES, EPISODE_CHARS = 50, 3, 800


def token_estimate(content: Column, scope: Column, steps: Column | None = None) -> Column:
    """Bytes of content, scope and steps (four more each) by three, and 40."""
    n = F.octet_length(F.coalesce(content, F.lit(""))) + F.octet_length(F.coalesce(scope, F.lit("")))
    if steps is not None:
        n = n + F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + F.octet_length(x) + 4), F.lit(0))
    return (F.floor(n / 3) + 40).cast("int")


def budget_take(items: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """keys, ord, id, tokens of what fits, taken in order; what is too big is skipped and later, smaller rows still taken. A repeated id counts once.

    A fold over the rows of a key: its sections are capped (at most SECTION_MOST rows each), so a key's array is small whatever the table's size.
    """
    rows = F.array_sort(F.collect_list(F.struct("ord", "id", "tokens")))
    empty = F.array().cast("array<struct<ord:bigint,id:string,tokens:int>>")
    start = F.struct(empty.alias("got"), F.lit(0).alias("used"), F.lit(False).alias("cut"))

    def step(s: Column, x: Column) -> Column:
        seen = F.exists(s["got"], lambda g: g["id"] == x["id"])
        fits = s["used"] + x["tokens"] <= budget
        return (
            F.when(seen, s)
            .when(fits, F.struct(F.concat(s["got"], F.array(x)).alias("got"), (s["used"] + x["tokens"]).alias("used"), s["cut"].alias("cut")))
            .otherwise(F.struct(s["got"].alias("got"), s["used"].alias("used"), F.lit(True).alias("cut")))
        )

    rows_of = items.select(*keys, F.col("ord").cast("long").alias("ord"), "id", "tokens")
    taken = rows_of.groupBy(*keys).agg(F.aggregate(rows, start, step).alias("s"))
    return taken.select(*keys, F.explode("s.got").alias("g"), F.col("s.cut").alias("truncated")).select(*keys, "g.ord", "g.id", "g.tokens", "truncated")


def sections(m: DataFrame, refs: DataFrame) -> DataFrame:
    """(scope, section, ord, id, tokens) for each project scope: the user's and its preferences, its open handoff, recent episodes, its rules (stale ones last)."""
    a = live(m)
    scopes = a.filter(F.col("scope").startswith("project:")).select("scope").distinct()
    new = [F.desc("created_at"), F.desc("id")]
    prefs = a.filter("mem_type = 'preference'")
    # the user's own preferences are capped before every scope gets them
    mine = topk_per(prefs.filter("scope = 'user'").withColumn("one", F.lit(0)), ["one"], new, SECTION_MOST)
    # at most SECTION_MOST rows are broadcast
    shared = scopes.withColumn("own", F.lit("user")).join(F.broadcast(mine.select("id", "content", F.col("scope").alias("own"), "created_at")), "own")
    both = shared.select("scope", "id", "content", "own", "created_at").unionByName(prefs.filter("scope <> 'user'").select("scope", "id", "content", F.col("scope").alias("own"), "created_at"))
    p = topk_per(both, ["scope"], new, SECTION_MOST).withColumn("section", F.lit(1))
    h = latest_handoff(m, unresumed=True).join(a.select("id", "content"), "id").select("scope", "id", "content", F.col("scope").alias("own"), F.lit(1).alias("rank"), F.lit(2).alias("section"))
    e = topk_per(a.filter("mem_type = 'episodic'"), ["scope"], new, EPISODES)
    e = e.select("scope", "id", F.substring("content", 1, EPISODE_CHARS).alias("content"), F.col("scope").alias("own"), "rank", F.lit(3).alias("section"))
    stale = stale_ids(refs).withColumn("stale", F.lit(1))
    rules = a.filter(F.col("mem_type").isin("project", "codebase", "semantic")).join(stale, "id", "left").withColumn("stale", F.coalesce("stale", F.lit(0)))
    r = topk_per(rules, ["scope"], [F.asc("stale"), *new], SECTION_MOST).select("scope", "id", "content", F.col("scope").alias("own"), "rank", F.lit(4).alias("section"))
    every = p.select("scope", "id", "content", "own", "rank", "section").unionByName(h).unionByName(e).unionByName(r).join(scopes, "scope", "left_semi")
    return every.select("scope", "section", (F.col("section") * 1000 + F.col("rank")).alias("ord"), "id", token_estimate(F.col("content"), F.col("own")).alias("tokens"))


def assemble(m: DataFrame, refs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(scope, ord, id, tokens, truncated): the context of each project scope."""
    return budget_take(sections(m, refs), ["scope"], min(max(budget, BUDGET_LEAST), BUDGET_MOST))


def reader_context(hits: DataFrame, docs: DataFrame, budget: int = READER_BYTES) -> DataFrame:
    """(query_id, id, place, is_hit, used_bytes): the hits that fit the budget of bytes in order of rank, then the records before and after each hit in its session
    that still fit; in the order of the sessions' first hits, and of time within a session.

    hits: query_id, id, place (from 1), few a query; docs: id, scope, source_session, content, created_at. Without a session a hit has no neighbours.
    """
    # records without a session are no group
    session = F.struct("scope", "source_session", F.when(F.col("source_session").isNull(), F.col("id")).alias("alone")).alias("session")
    d = docs.select("id", "created_at", session, F.octet_length(F.coalesce("content", F.lit(""))).alias("tokens"))
    w = Window.partitionBy("session").orderBy("created_at", "id")
    d = d.withColumn("position", F.row_number().over(w)).withColumn("it", F.struct("id", "tokens", "position"))
    d = d.select("id", "session", F.array(F.col("it"), F.lag("it").over(w), F.lead("it").over(w)).alias("near"))
    h = hits.select("query_id", "id", "place").join(d, "id").withColumn("first", F.min("place").over(Window.partitionBy("query_id", "session")))
    # every hit comes before any neighbour
    each = h.select("query_id", "place", "first", F.posexplode("near").alias("k", "n")).filter("n is not null")
    rank = F.col("place").cast("long") * 2 + F.when(F.col("k") == 0, 0).otherwise(F.lit(1 << 40) + F.col("k") - 1)
    items = each.select("query_id", rank.alias("ord"), "n.id", "n.tokens", "n.position", "first", (F.col("k") == 0).alias("is_hit"))
    where = items.groupBy("query_id", "id").agg(F.min("first").alias("first"), F.min("position").alias("position"), F.max("is_hit").alias("is_hit"))
    taken = budget_take(items, ["query_id"], budget).select("query_id", "id", "tokens").join(where, ["query_id", "id"])
    order = Window.partitionBy("query_id").orderBy("first", "position", "id")
    used = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return taken.select("query_id", "id", F.row_number().over(order).alias("place"), "is_hit", used.alias("used_bytes"))
