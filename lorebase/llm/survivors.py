"""The best representative of each duplicate group, built field by field.

1. *Skyline.* A member is undominated for a field when no member with a value for it is as good in trust, confidence and recency and better in one (of equals the
   smaller id stands first). Completeness is the first dimension: only a member that has a value can offer it.
2. *Layers.* The undominated members of all fields are peeled into dominance layers over trust, confidence and recency: layer 1 is what no other of them dominates,
   layer 2 what only layer 1 dominates, and so on. A member lies below another only for a field that the other lacks, so there are at most as many layers as fields.
3. *Fill.* Each layer offers, for each field, its first member by the lexicographic policy (trust, confidence, recency, smaller id). The survivor starts with layer 1,
   and what it lacks is filled from the successive layers; of two layers' offers the policy's counts, so a deeper member of more trust is not passed over.

A skyline needs no pairs: with members in order of confidence, one is dominated exactly when an earlier one with as much trust is as recent; a running
maximum per level of trust tells. Of equal trust and confidence only the most recent is kept before anything is shuffled by group. A group of more than PART rows is
cut at quantiles of its confidences into parts; the parts' maxima are run up first (one row a part), so no task holds more than a part.

Defined results: unknown and deleted members do not count; members named twice count once; rows of a proposal that come again change nothing; null
trust is below external; a confidence that is null, NaN or outside 0..1 and a time that is null or after the row's own arrival come
last; a field without a value has no row; a proposal without a valid member has none; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.ids import canonical_id, said
from lorebase.session import Scratch, is_empty

FIELDS = ("keep_id", "source_session", "evidence_uri", "valid_from", "valid_to")
# fixed values: words that only say there is no value
NO_VALUE = ("none", "null", "n/a", "na", "nil", "unknown", "undefined", "nan", "tbd", "-", "--", "?", "")
LEVELS = 4
#: Rows of a group that one task takes, and parts that a larger group is cut into.
PART, PARTS = 100_000, 1024


def _value(c: str) -> Column:
    """The text of a field, null where it has no value."""
    plain = F.trim(F.regexp_replace(F.col(c).cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(~F.lower(plain).isin(*NO_VALUE), F.col(c).cast("string"))


def newest_members(memories: DataFrame, wanted: DataFrame) -> DataFrame:
    """The newest version of each wanted id (wanted: mem_id) with the policy's keys; deleted ones are left out."""
    rows = memories.select(
        canonical_id("id").alias("mem_id"),
        F.struct(
            "updated_at", "line_no", said("status").alias("status"), said("trust").alias("trust"), "confidence", "created_at", "loaded_at",
            *(_value(f).alias(f) for f in FIELDS[1:]),
        ).alias("v"),
    )
    newest = rows.join(wanted, "mem_id", "left_semi").groupBy("mem_id").agg(F.max("v").alias("v")).select("mem_id", "v.*")
    sure = F.when((F.col("confidence") >= 0) & (F.col("confidence") <= 1), F.col("confidence"))  # NaN is above 1
    recent = F.when((F.col("created_at") > F.col("loaded_at")), F.lit(None).cast("timestamp")).otherwise(F.col("created_at"))
    return newest.filter("status is null or status <> 'deleted'").select(
        "mem_id",
        F.when(F.col("trust") == "user", 0).when(F.col("trust") == "agent", 1).when(F.col("trust") == "external", 2).otherwise(3).alias("level"),
        F.coalesce(sure, F.lit(-1.0)).alias("sure"),
        F.coalesce(F.unix_micros(recent), F.lit(-(2**63)).cast("long")).alias("recent"),
        F.col("mem_id").alias("keep_id"),
        *FIELDS[1:],
    )


def members(proposals: DataFrame, memories: DataFrame, kind: str = "duplicate") -> DataFrame:
    """(proposal_id, member's keys and fields), one row for each valid member of each proposal of this kind."""
    named = (
        proposals.filter(said("kind") == kind)
        .select("proposal_id", F.explode("member_ids").alias("m"))
        .select("proposal_id", canonical_id("m").alias("mem_id"))
        .filter("mem_id is not null")
        .distinct()
    )
    return named.join(newest_members(memories, named.select("mem_id").distinct()), "mem_id")


def _running(keys: list[str], before: list[str] | None = None) -> Column:
    """Whether no earlier row of the same keys, in order of confidence, has as much trust and is as recent. ``before``: maxima of the parts before, per level."""
    earlier = Window.partitionBy(*keys).orderBy(F.desc("sure"), F.desc("recent"), "level", "mem_id").rowsBetween(Window.unboundedPreceding, -1)
    best = F.lit(None).cast("long")
    for n in range(LEVELS):
        seen = F.max(F.when(F.col("level") <= n, F.col("recent"))).over(earlier)
        best = F.when(F.col("level") == n, F.greatest(seen, F.col(before[n])) if before else seen).otherwise(best)
    return best.isNull() | (best < F.col("recent"))


def flag_undominated(scratch: Scratch, rows: DataFrame, keys: list[str], part: int | None = None) -> DataFrame:
    """rows (keys, mem_id, level, sure, recent, ...) with top: whether no row of the same keys dominates it; rows must be cheap to read twice."""
    part = part or PART
    large = scratch.keep(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > part).select(*keys))
    if is_empty(large):
        return rows.withColumn("top", _running(keys))
    small = rows.join(large, keys, "left_anti").withColumn("top", _running(keys))
    rest = rows.join(large, keys, "left_semi")
    cuts = rest.groupBy(*keys).agg(F.percentile_approx("sure", [k / PARTS for k in range(1, PARTS)], 10 * PARTS).alias("_cuts"))
    # equal confidences are in one part; at most a row per level of trust has each
    rest = scratch.keep(rest.join(cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c > F.col("sure")))).drop("_cuts"))
    tops = rest.groupBy(*keys, "_part").agg(*(F.max(F.when(F.col("level") <= n, F.col("recent"))).alias(f"_m{n}") for n in range(LEVELS)))
    past = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = [f"_b{n}" for n in range(LEVELS)]
    tops = tops.select(*keys, "_part", *(F.max(f"_m{n}").over(past).alias(before[n]) for n in range(LEVELS)))
    rest = rest.join(tops, [*keys, "_part"]).withColumn("top", _running([*keys, "_part"], before))
    return small.unionByName(rest.select(small.columns))


def fronts(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(proposal_id, field_name, mem_id, level, sure, recent, value): the undominated members of each field. rows: as :func:`members` gives them."""
    each = rows.select(
        "proposal_id", "mem_id", "level", "sure", "recent",
        F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS))).alias("f"),
    ).select("proposal_id", "mem_id", "level", "sure", "recent", "f.*").filter("value is not null")
    # ~x falls as x rises, and has no overflow
    latest = F.min(F.struct(F.bitwise_not("recent").alias("past"), "mem_id", "value")).alias("v")
    best = each.groupBy("proposal_id", "field_name", "level", "sure").agg(latest)
    best = best.select("proposal_id", "field_name", "v.mem_id", "level", "sure", F.bitwise_not("v.past").alias("recent"), "v.value")
    return flag_undominated(scratch, scratch.keep(best), ["proposal_id", "field_name"]).filter("top").drop("top")


def layers(scratch: Scratch, front: DataFrame) -> DataFrame:
    """(proposal_id, mem_id, layer): the undominated members peeled into dominance layers, at most one a field."""
    left = scratch.keep(front.select("proposal_id", "mem_id", "level", "sure", "recent").distinct())
    peeled = []
    while True:
        flagged = scratch.keep(flag_undominated(scratch, left, ["proposal_id"]))
        peeled.append(flagged.filter("top").select("proposal_id", "mem_id", F.lit(len(peeled) + 1).alias("layer")))
        left = flagged.filter("not top").drop("top")
        if is_empty(left):
            return reduce(DataFrame.unionByName, peeled)


def providers(proposals: DataFrame, memories: DataFrame) -> DataFrame:
    """(proposal_id, field_name, member_id, value, layer): who provides each field of each survivor, and from which layer."""
    scratch = Scratch(proposals.sparkSession, "survivors")
    front = scratch.keep(fronts(scratch, members(proposals, memories)))
    rows = front.join(layers(scratch, front), ["proposal_id", "mem_id"])
    policy = F.struct("level", (-F.col("sure")).alias("unsure"), F.bitwise_not("recent").alias("past"), "mem_id", "value")
    offers = rows.groupBy("proposal_id", "field_name", "layer").agg(F.min(policy).alias("offer"))
    filled = offers.groupBy("proposal_id", "field_name").agg(F.min(F.struct("offer", "layer")).alias("best"))
    return filled.select("proposal_id", "field_name", F.col("best.offer.mem_id").alias("member_id"), "best.offer.value", "best.layer")


def survivors(proposals: DataFrame, memories: DataFrame) -> DataFrame:
    """One row per proposal: the surviving record and, for each field, the member and the layer it comes from."""
    got = providers(proposals, memories)
    cells = []
    for f in FIELDS:
        at = F.col("field_name") == f
        cells += [F.max(F.when(at, F.col("value"))).alias(f), F.max(F.when(at, F.col("member_id"))).alias(f"{f}_from"), F.max(F.when(at, F.col("layer"))).alias(f"{f}_layer")]
    return got.groupBy("proposal_id").agg(*cells).drop("keep_id_from", "keep_id_layer")


def front_sizes(proposals: DataFrame, memories: DataFrame) -> DataFrame:
    """(proposal_id, n_members, n_undominated) over the members as they are, a report of how much the policy has to decide."""
    scratch = Scratch(proposals.sparkSession, "fronts")
    rows = scratch.keep(members(proposals, memories))
    return flag_undominated(scratch, rows, ["proposal_id"]).groupBy("proposal_id").agg(F.count("*").alias("n_members"), F.count_if("top").alias("n_undominated"))
