"""Reads over records: lists, lookups, predicates, top-k, counts, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.sources.records import live
from lorebase.sources.records import unexpired as unexpired_at

TYPES = ("preference", "semantic", "episodic", "project", "codebase", "temporary")
STATUSES = ("proposed", "active", "superseded", "deleted")
LIST_DEFAULT, LIST_MOST, OFFSET_MOST = 50, 500, 100_000


def clamp(n: int | None, default: int, most: int) -> int:
    """A limit: the default where there is none, never more than most."""
    return default if not n or n <= 0 else min(n, most)


def stale_refs(refs: DataFrame) -> DataFrame:
    """References that make a record stale: gone, or changed where a symbol is named."""
    return refs.filter((F.col("state") == "missing") | ((F.col("state") == "changed") & (F.col("symbol") != "")))


def stale_ids(refs: DataFrame) -> DataFrame:
    return stale_refs(refs).select(F.col("memory_id").alias("id")).distinct()


def list_records(
    m: DataFrame,
    statuses: tuple[str, ...] = ("active",),
    scopes: tuple[str, ...] | None = None,
    types: tuple[str, ...] | None = None,
    unexpired: bool = True,
    stale_of: DataFrame | None = None,
    oldest_first: bool = False,
    limit: int | None = None,
    offset: int = 0,
    at: Column | None = None,
) -> DataFrame:
    """The filtered list: a top-k feature, in order of creation, ties by id."""
    m = m.filter(F.col("status").isin(*statuses))
    if scopes is not None:
        m = m.filter(F.col("scope").isin(*scopes))
    if types is not None:
        m = m.filter(F.col("mem_type").isin(*types))
    if unexpired:
        m = m.filter(unexpired_at(at))
    if stale_of is not None:
        m = m.join(stale_ids(stale_of), "id", "left_semi")
    order = [F.asc("created_at"), F.asc("id")] if oldest_first else [F.desc("created_at"), F.desc("id")]
    return m.orderBy(*order).offset(min(max(0, offset), OFFSET_MOST)).limit(clamp(limit, LIST_DEFAULT, LIST_MOST))


def by_ids(m: DataFrame, ids: DataFrame) -> DataFrame:
    return m.join(ids, "id", "left_semi")


def latest_per(m: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key as a partial aggregate: no window, so a hot key costs no more than others."""
    v = F.max(F.struct("created_at", "id", *columns)).alias("v")
    return m.groupBy(*keys).agg(v).select(*keys, "v.id", *(f"v.{c}" for c in columns))


def topk_per(m: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key. The rank limit is pushed below the shuffle, so a hot key sends k rows a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return m.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def classified(m: DataFrame, kind: Column, confidence: Column) -> DataFrame:
    """(id, mem_type, confidence): a classifier's answer made to fit: a record of the user's scope belongs to no project, confidences lie in 0..1, none is 0."""
    fits = F.when(kind.isin("project", "codebase") & (F.col("scope") == "user"), "semantic").otherwise(kind)
    return m.select("id", fits.alias("mem_type"), F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def judge_route(blank: Column, kind: Column) -> Column:
    """Which question a judge is asked: abstain where there is no answer to expect, the kind's own, else standard."""
    return F.when(blank, "abstain").otherwise(F.coalesce(kind, F.lit("standard")))


def scope_counts(m: DataFrame) -> DataFrame:
    """(scope, n_active, n_proposed)"""
    return m.groupBy("scope").agg(
        F.count_if(F.col("status") == "active").alias("n_active"), F.count_if(F.col("status") == "proposed").alias("n_proposed")
    )


def scope_overview(m: DataFrame) -> DataFrame:
    """Active and proposed records per scope, the user's scope first."""
    by = scope_counts(m)
    return by.orderBy(F.desc(F.col("scope") == "user"), "scope")


def violations(m: DataFrame) -> DataFrame:
    """(id, rule): the integrity rules each record breaks."""
    rules = {
        "type": F.col("mem_type").isNull() | ~F.col("mem_type").isin(*TYPES),
        "status": F.col("status").isNull() | ~F.col("status").isin(*STATUSES),
        "trust": F.col("trust").isNull() | ~F.col("trust").isin("user", "agent", "external"),
        "content": F.col("content").isNull() | (F.trim("content") == ""),
        "scope": F.col("scope").isNull() | ~F.col("scope").rlike("^(user|(project|repo):.+)$"),
        "confidence": F.col("confidence").isNull(),
        "validity": F.col("valid_to") < F.col("valid_from"),
        "expiry": (F.col("mem_type") == "temporary") & F.col("expires_at").isNull(),
        "self": F.col("supersedes") == F.col("id"),
        "agent": F.col("source_agent").isNull() | ~F.col("source_agent").rlike("^[a-z0-9][a-z0-9._-]{0,63}$"),
    }
    broken = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))
    return m.select("id", F.explode(F.array_compact(broken)).alias("rule"))


def live_by_type(m: DataFrame) -> DataFrame:
    return live(m).groupBy("mem_type").agg(F.count("*").alias("n"))
