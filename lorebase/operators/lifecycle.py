"""State changes as pure functions: records and requests in, change rows out. Nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import jsonx, secrets
from lorebase.operators.records import latest_per
from lorebase.sources.records import live

CHANGE = ("id", "old_status", "new_status")


def supersede(m: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, old_status, new_status): pairs (id, supersedes) of new active records retire their active targets in the same scope, each once."""
    target = m.select(F.col("id").alias("supersedes"), F.col("scope").alias("tscope"), F.col("status").alias("old_status"))
    ok = pairs.join(m.select("id", "scope", "status"), "id").filter("status = 'active'").join(target, "supersedes")
    hit = ok.filter("old_status = 'active' and scope = tscope and id <> supersedes")
    return hit.select(F.col("supersedes").alias("id"), "old_status", F.lit("superseded").alias("new_status")).distinct()


def approve(m: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, old_status, new_status, new_trust) of approving requests (id): proposed becomes active and trusted as the user's own, its active target superseded; others are left alone."""
    asked = m.join(requests.select("id").distinct(), "id", "left_semi").filter("status = 'proposed'")
    now = asked.select("id", F.lit("proposed").alias("old_status"), F.lit("active").alias("new_status"), F.lit("user").alias("new_trust"))
    targets = asked.filter("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()
    retired = m.join(targets, "id", "left_semi").filter("status = 'active'").select("id", F.lit("active").alias("old_status"), F.lit("superseded").alias("new_status"), F.col("trust").alias("new_trust"))
    return now.unionByName(retired)


def approve_replacing(m: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, target, outcome): what approving records in place of others (id, target) does: approved, or why not: not_proposed, itself, other_scope, target_not_active."""
    a = m.select("id", F.col("status").alias("s"), F.col("scope").alias("sc"))
    t = m.select(F.col("id").alias("target"), F.col("status").alias("ts"), F.col("scope").alias("tsc"))
    j = requests.select("id", "target").join(a, "id").join(t, "target", "left")
    outcome = (
        F.when(~F.coalesce(F.col("s") == "proposed", F.lit(False)), "not_proposed")
        .when(F.col("id") == F.col("target"), "itself")
        .when(~F.coalesce(F.col("ts") == "active", F.lit(False)), "target_not_active")
        .when(~F.col("sc").eqNullSafe(F.col("tsc")), "other_scope")
        .otherwise("approved")
    )
    return j.select("id", "target", outcome.alias("outcome"))


def expired_for(m: DataFrame, days: int, at: Column) -> DataFrame:
    """(id): records that expired more than so many days before a time."""
    return m.filter(F.col("expires_at") < at - F.make_dt_interval(days=F.lit(days))).select("id")


def reject(m: DataFrame, requests: DataFrame) -> DataFrame:
    asked = m.join(requests.select("id").distinct(), "id", "left_semi").filter("status = 'proposed'")
    return asked.select("id", F.lit("proposed").alias("old_status"), F.lit("deleted").alias("new_status"))


def soft_delete(m: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, attrs): attributes after deletion: who and why are merged in, the reason only where there is one. requests: id, by, reason."""
    asked = m.filter("status <> 'deleted'").join(requests, "id")
    extra = F.map_filter(F.map_from_arrays(F.array(F.lit("forgotten_by"), F.lit("reason")), F.array("by", "reason")), lambda _, v: v.isNotNull())
    return asked.select("id", jsonx.to_object(jsonx.merge(jsonx.as_map(F.col("attrs")), extra)).alias("attrs"))


def rewrite(m: DataFrame, at: Column, reason: str) -> DataFrame:
    """(id, content, attrs, has_vector): records that hold a secret, in their text or anywhere in their attributes, as they are written again: redacted, stamped with when and why,
    and without the vector that still knows the old text."""
    clean = secrets.redact_json(m.select("id", "attrs"), "id", "attrs")
    j = m.select("id", "content").join(clean, "id").withColumn("text", secrets.redact(F.col("content")))
    hit = j.filter((F.size("found") > 0) | ~F.col("text").eqNullSafe(F.col("content")))
    stamp = F.map_from_arrays(F.array(F.lit("redacted_at"), F.lit("reason")), F.array(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(reason)))
    return hit.select("id", F.col("text").alias("content"), jsonx.to_object(jsonx.merge(jsonx.as_map(F.col("redacted")), stamp)).alias("attrs"), F.lit(False).alias("has_vector"))


def latest_handoff(m: DataFrame, unresumed: bool = False) -> DataFrame:
    """(scope, id): the newest live handoff of each scope."""
    h = live(m).filter(F.get_json_object("attrs", "$.kind") == "handoff")
    if unresumed:
        h = h.filter(F.get_json_object("attrs", "$.resumed_at").isNull())
    return latest_per(h, ["scope"], []).select("scope", "id")


def create_handoff(m: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, id, retired): what a new handoff in each scope (scope) retires; the latest of them is its predecessor."""
    h = live(m).filter(F.get_json_object("attrs", "$.kind") == "handoff").join(scopes, "scope", "left_semi").select("scope", "id")
    last = latest_handoff(m).withColumnRenamed("id", "last")
    return h.join(last, "scope").select("scope", "id", (F.col("id") == F.col("last")).alias("is_predecessor"))


def find_session_memory(m: DataFrame) -> DataFrame:
    """(scope, mem_type, source_agent, source_session, id): the newest active record of each session, which a new episode replaces."""
    a = m.filter("status = 'active' and source_session is not null")
    return latest_per(a, ["scope", "mem_type", "source_agent", "source_session"], []).select("scope", "mem_type", "source_agent", "source_session", "id")


def to_embed(m: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id): live records that still need a vector."""
    return live(m).join(vectors.select("line_no"), "line_no", "left_anti").select("id")


def claim(jobs: DataFrame, n: int, lease_seconds: int = 600, attempts: int = 5) -> DataFrame:
    """The jobs a worker takes next: pending, due again or with a lease that ran out; oldest first; one attempt more.

    jobs: job_id, status, attempts, created_at, locked_until, next_attempt_at, now.
    """
    due = (
        (F.col("status") == "pending")
        | ((F.col("status") == "failed") & (F.col("next_attempt_at") <= F.col("now")))
        | ((F.col("status") == "running") & (F.col("locked_until") < F.col("now")))
    )
    got = jobs.filter(due & (F.col("attempts") < attempts)).orderBy("created_at", "job_id").limit(n)
    return got.select("job_id", (F.col("attempts") + 1).alias("attempts"), (F.col("now") + F.make_dt_interval(secs=F.lit(lease_seconds))).alias("locked_until"))
