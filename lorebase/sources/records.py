"""Typed views over the raw tables: the newest version of each record, clean edges, references and proposals.

Defined results: ids in canonical spelling; rows without an id, edges with a null end or a loop are left out; repeated rows are one; a null or odd status stays as it
is and is never live; confidences outside 0..1 are null; creation times after the row's arrival are the arrival's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.ids import canonical_id, said
from lorebase.sources.tables import table

#: The registered queries judge expiry and age at this time; operators take another as ``at``.
AS_OF = "2026-01-01 00:00:00"

MEMORY_COLUMNS = (
    "line_no", "mem_type", "scope", "content", "attrs", "source_agent", "source_session", "evidence_uri", "trust", "confidence", "status", "supersedes",
    "valid_from", "valid_to", "expires_at", "created_at", "updated_at",
)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def clean_scope(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.col(c)), r"\s+", ""), "/+", "/")


def memory(spark: SparkSession, folder: str, columns: tuple[str, ...] = MEMORY_COLUMNS) -> DataFrame:
    """One row per id: its newest version (latest updated_at, then largest line_no)."""
    return newest(table(spark, folder, "memories"), columns)


def newest(memories: DataFrame, columns: tuple[str, ...] = MEMORY_COLUMNS) -> DataFrame:
    """``columns``: those of the result beside id; what is not asked for is not shuffled either."""
    made = {
        "scope": clean_scope("scope"), "trust": said("trust"), "confidence": F.when((F.col("confidence") >= 0) & (F.col("confidence") <= 1), F.col("confidence")),
        "status": said("status"), "supersedes": canonical_id("supersedes"), "created_at": F.least("created_at", "loaded_at"),
    }
    fields = [c for c in MEMORY_COLUMNS if c in columns and c not in ("updated_at", "line_no")]
    rows = memories.select(canonical_id("id").alias("id"), F.struct("updated_at", "line_no", *(made[c].alias(c) if c in made else F.col(c) for c in fields)).alias("v"))
    return rows.filter("id is not null").groupBy("id").agg(F.max("v").alias("v")).select("id", *(f"v.{c}" for c in columns))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (src, relation, dst)."""
    raw = table(spark, folder, "memory_edges").select(canonical_id("src").alias("src"), canonical_id("dst").alias("dst"), "relation", "weight", "created_at")
    both = raw.filter("src is not null and dst is not null and src <> dst and relation is not null")
    return both.groupBy("src", "relation", "dst").agg(F.max("weight").alias("weight"), F.min("created_at").alias("created_at"))


REF_COLUMNS = ("line_no", "scope", "state", "resolved_path", "anchor_hash", "anchor_commit", "checked_commit", "checked_at", "created_at")


def refs(spark: SparkSession, folder: str, columns: tuple[str, ...] = REF_COLUMNS) -> DataFrame:
    """One row per (memory_id, path, symbol): the last to arrive. ``columns``: those of the result beside these; what is not asked for is not shuffled either."""
    made = {"scope": clean_scope("scope")}
    raw = table(spark, folder, "memory_refs").select(
        canonical_id("memory_id").alias("memory_id"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("symbol", F.lit("")).alias("symbol"),
        F.struct("line_no", *(made[c].alias(c) if c in made else F.col(c) for c in REF_COLUMNS if c in columns and c != "line_no")).alias("v"),
    )
    last = raw.filter("memory_id is not null").groupBy("memory_id", "path", "symbol").agg(F.max("v").alias("v"))
    return last.select("memory_id", "path", "symbol", *(f"v.{c}" for c in columns))


PROPOSAL_COLUMNS = ("kind", "scope", "keep_id", "content", "reason", "model", "status", "result_id", "decided_by", "decided_at", "created_at", "updated_at")


def proposals(spark: SparkSession, folder: str) -> DataFrame:
    """One row per proposal; member_ids sorted, distinct and canonical."""
    raw = table(spark, folder, "proposals")
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("member_ids", canonical_id), lambda x: x.isNotNull())))
    v = F.struct("updated_at", ids.alias("member_ids"), *(canonical_id(c).alias(c) if c in ("keep_id", "result_id") else F.col(c) for c in PROPOSAL_COLUMNS if c != "updated_at"))
    last = raw.groupBy("proposal_id").agg(F.max(v).alias("v"))
    return last.select("proposal_id", "v.member_ids", *(f"v.{c}" for c in PROPOSAL_COLUMNS))


def unexpired(at: Column | None = None) -> Column:
    """Whether a record has not expired at a time, AS_OF unless told otherwise."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > (as_of() if at is None else at))


def live(m: DataFrame, at: Column | None = None) -> DataFrame:
    """Active and not expired."""
    return m.filter((F.col("status") == "active") & unexpired(at))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """id, vec: one embedding for each memory line that has one (vec_id names the line)."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("line_no"), F.col("embedding").alias("vec"))
