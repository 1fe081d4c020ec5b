"""Consolidation: pairs to judge, proposals and their liveness, digests, and what a decision changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions.similarity import jaccard, trigram_pairs, trigrams, vector_pairs
from lorebase.operators.records import topk_per
from lorebase.session import Scratch, free_plans
from lorebase.sources.records import as_of, live

DIGEST_LEAST, DIGEST_MOST = 6, 10
TEXT_LEAST, COSINE_LEAST, NEAREST = 0.5, 0.75, 3


def members(proposals: DataFrame) -> DataFrame:
    return proposals.select("proposal_id", F.explode("member_ids").alias("id"))


def liveness(proposals: DataFrame, m: DataFrame) -> DataFrame:
    """(proposal_id, is_live, n_members): live while every member is."""
    alive = live(m).select("id", F.lit(True).alias("alive"))
    by = members(proposals).join(alive, "id", "left").groupBy("proposal_id")
    return by.agg(F.coalesce(F.bool_and(F.coalesce("alive", F.lit(False))), F.lit(False)).alias("is_live"), F.count("*").alias("n_members"))


def digest_candidates(m: DataFrame) -> DataFrame:
    kind = F.coalesce(F.get_json_object("attrs", "$.kind"), F.lit(""))
    return live(m).filter((F.col("mem_type") == "episodic") & (kind != "digest") & (F.col("created_at") < as_of() - F.expr("INTERVAL 30 DAYS")))


def digest_groups(m: DataFrame, proposals: DataFrame, least: int = DIGEST_LEAST, most: int = DIGEST_MOST) -> DataFrame:
    """(scope, id, place): the oldest records of each scope that has enough and that no digest holds yet."""
    used = members(proposals.filter("kind = 'digest'")).select("id")
    free = digest_candidates(m).join(used, "id", "left_anti").select("scope", "id", "created_at")
    enough = free.groupBy("scope").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("scope")
    return topk_per(free.join(enough, "scope", "left_semi"), ["scope"], [F.asc("created_at"), F.asc("id")], most, "place").select("scope", "id", "place")


def candidate_pairs(scratch: Scratch, m: DataFrame, vectors: DataFrame, proposals: DataFrame, least_text: float = TEXT_LEAST, least_cosine: float = COSINE_LEAST) -> DataFrame:
    """(a, b, sim): similar live records of one scope and type that nobody has judged and no open proposal holds; the older is a.

    Similar by trigrams (exact at and above the threshold), or by vector: the NEAREST of each record that reach the threshold.
    The larger similarity counts. vectors: id, vec.
    """
    rows = live(m).filter(~F.col("mem_type").isin("episodic", "temporary")).select("id", F.struct("scope", "mem_type").alias("block"), F.col("content").alias("text"))
    rows = scratch.keep(rows)
    waiting = scratch.keep(members(proposals.filter("status = 'pending'")).select("id").distinct())
    near = scratch.keep(vector_pairs(rows.join(vectors, "id").select("id", "block", "vec"), least_cosine, NEAREST))
    free_plans(scratch.spark)
    # the text of such a pair counts too, as copies are not paired with each other by trigrams; only these pairs carry texts
    x, y = (rows.select(F.col("id").alias(end), F.coalesce("text", F.lit("")).alias(f"t{end}")) for end in ("a", "b"))
    ga, gb = trigrams(F.col("ta")), trigrams(F.col("tb"))
    near = near.join(x, "a").join(y, "b").withColumns({"ga": ga, "gb": gb})
    text = F.when((F.size("ga") > 0) & (F.size("gb") > 0), F.round(jaccard(F.col("ga"), F.col("gb")), 9))
    near = scratch.keep(near.select("a", "b", F.greatest("sim", F.when(text >= least_text, text)).alias("sim")))
    alike = trigram_pairs(scratch, rows.filter("text is not null"), least_text, waiting).join(near, ["a", "b"], "left_anti")
    free = near.join(waiting.withColumnRenamed("id", "a"), "a", "left_anti").join(waiting.withColumnRenamed("id", "b"), "b", "left_anti")
    judged = proposals.filter(F.size("member_ids") == 2).select(F.element_at("member_ids", 1).alias("a"), F.element_at("member_ids", 2).alias("b"))
    return alike.select("a", "b", "sim").unionByName(free.select("a", "b", "sim")).join(judged, ["a", "b"], "left_anti").select("a", "b", "sim")


def apply_decisions(m: DataFrame, proposals: DataFrame) -> DataFrame:
    """(proposal_id, id, change): what applying the pending proposals does. Not live: stale. Duplicate and conflict: all but the kept one
    are superseded. Digest: every member is superseded by the digest."""
    pending = proposals.filter("status = 'pending'")
    alive = liveness(pending, m).select("proposal_id", "is_live")
    each = members(pending).join(pending.select("proposal_id", "kind", "keep_id"), "proposal_id").join(alive, "proposal_id")
    change = (
        F.when(~F.col("is_live"), "stale")
        .when(F.col("kind") == "digest", "superseded_by_digest")
        .when(F.col("keep_id").isNull(), "undecided")
        .when(F.col("keep_id") == F.col("id"), "kept")
        .otherwise("superseded")
    )
    return each.select("proposal_id", "id", change.alias("change"))


def to_propose(judged: DataFrame, proposals: DataFrame) -> DataFrame:
    """(a, b, kind, status): proposals for judged pairs (a, b, verdict) whose set of members has none yet; a distinct pair is dismissed at once."""
    known = proposals.filter(F.size("member_ids") == 2).select(F.element_at("member_ids", 1).alias("a"), F.element_at("member_ids", 2).alias("b"))
    kind = F.when(F.col("verdict") == "same", "duplicate").otherwise(F.col("verdict"))
    status = F.when(F.col("verdict") == "distinct", "dismissed").otherwise("pending")
    return judged.join(known, ["a", "b"], "left_anti").select("a", "b", kind.alias("kind"), status.alias("status"))


def reject(proposals: DataFrame, requests: DataFrame) -> DataFrame:
    """(proposal_id, old_status, new_status) of rejecting requests (proposal_id): pending ones only."""
    asked = proposals.filter("status = 'pending'").join(requests.select("proposal_id").distinct(), "proposal_id", "left_semi")
    return asked.select("proposal_id", F.lit("pending").alias("old_status"), F.lit("rejected").alias("new_status"))


def periods(proposals: DataFrame, m: DataFrame) -> DataFrame:
    """(proposal_id, period): the day of a proposal's members, or the first and the last."""
    each = members(proposals).join(m.filter("created_at is not null").select("id", "created_at"), "id")
    by = each.groupBy("proposal_id").agg(F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("b"))
    return by.select("proposal_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws(" to ", "a", "b")).alias("period"))


def judge(pairs: DataFrame) -> DataFrame:
    """(a, b, verdict, n): verdict of all judgements of a pair in either order, unclear where they disagree. pairs: a_id, b_id, relation."""
    from lorebase.functions.ids import canonical_id, said

    p = pairs.select(canonical_id("a_id").alias("x"), canonical_id("b_id").alias("y"), said("relation").alias("r")).filter("x is not null and y is not null and x <> y and r is not null")
    by = p.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = F.min("r") == F.max("r")
    return by.agg(F.when(same, F.min("r")).otherwise("unclear").alias("verdict"), F.count("*").alias("n"))
