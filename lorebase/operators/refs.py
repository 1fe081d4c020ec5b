"""References of records to code: targets to check, results of checks, backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions.coderef import code_references

SYNC_MOST = 500
REFS_A_RECORD, FIELD_BYTES = 16, 300


def targets(refs: DataFrame) -> DataFrame:
    """Distinct targets with the time of their oldest check (null: one was never checked)."""
    by = refs.groupBy("scope", "path", "symbol", F.coalesce("anchor_commit", F.lit("")).alias("anchor"))
    oldest = F.when(F.count("*") == F.count("checked_at"), F.min("checked_at"))
    return by.agg(F.count("*").alias("n_refs"), oldest.alias("oldest"))


def sync_targets(refs: DataFrame, most: int = SYNC_MOST) -> DataFrame:
    """What to check next: never checked first, then the oldest check."""
    return targets(refs).orderBy(F.asc_nulls_first("oldest"), "scope", "path", "symbol", "anchor").limit(most)


def apply_checks(refs: DataFrame, checks: DataFrame) -> DataFrame:
    """refs with next_state and next_anchor after the checks (path, symbol, found, hash); references without a check stay as they are.

    Without an anchor a found target becomes current and anchored, one not found unresolved. With one it is missing when not found, current when the
    hash is the same, else changed.
    """
    c = checks.select("path", "symbol", "found", "hash").dropDuplicates(["path", "symbol"])
    j = refs.join(c, ["path", "symbol"], "left")
    anchored = F.col("anchor_hash").isNotNull()
    state = (
        F.when(F.col("found").isNull(), F.col("state"))
        .when(~anchored & F.col("found"), "current")
        .when(~anchored, "unresolved")
        .when(~F.col("found"), "missing")
        .when(F.col("hash") == F.col("anchor_hash"), "current")
        .otherwise("changed")
    )
    anchor = F.when(~anchored & F.coalesce("found", F.lit(False)), F.col("hash")).otherwise(F.col("anchor_hash"))
    return j.withColumn("next_state", state).withColumn("next_anchor", anchor).drop("found", "hash")


def check_tally(checked: DataFrame) -> DataFrame:
    """Counts of a check: references per state before and after, and newly anchored ones."""
    return checked.groupBy("state", "next_state").agg(
        F.count("*").alias("n"), F.count_if(F.col("anchor_hash").isNull() & F.col("next_anchor").isNotNull()).alias("n_anchored")
    )


def extract_refs(m: DataFrame) -> DataFrame:
    """(id, scope, ord, path, symbol): references named in the contents of project records, in order of mention."""
    rows = m.filter(F.col("scope").startswith("project:") | F.col("scope").startswith("repo:")).filter(F.col("mem_type").isin("codebase", "project", "semantic"))
    each = rows.select("id", "scope", F.posexplode(code_references(F.coalesce("content", F.lit("")))).alias("ord", "r"))
    small = (F.octet_length("r.path") <= FIELD_BYTES) & (F.octet_length("r.symbol") <= FIELD_BYTES)
    return each.filter((F.col("ord") < REFS_A_RECORD) & small).select("id", "scope", "ord", "r.path", "r.symbol")


def backfill(m: DataFrame, refs: DataFrame) -> DataFrame:
    """References for active project records that have none."""
    return extract_refs(m.filter("status = 'active'").join(refs.select(F.col("memory_id").alias("id")), "id", "left_anti"))
