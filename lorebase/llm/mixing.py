"""Mixing of sources to target shares of tokens by a low-discrepancy schedule.

1. Every document is counted in tokens; sources in other spelling are one source.
2. The size of the mix is the largest at which every source that has documents reaches its share within its repeats (or the size asked for; then
   sources that run out give less, which the report shows). A source without documents leaves its share to the others in proportion.
3. Each source is shuffled by a keyed hash, once per repeat, and cut at its quota into blocks of about equal tokens.
4. Slot i is the point frac(i * golden ratio); mapped through the cumulative weights it names a source. The j-th slot of a source takes
   its j-th block.

Running sums and ranks are cut by buckets (:func:`lorebase.session.spread_cumsum`), so a source of any share never meets in one task. Only the
per-source totals (one row per target) come to the driver.

Defined results: null, empty and blank sources and sources without a target are left out; null and empty texts have no tokens and are left out; a null or
non-positive share takes no part; null repeats mean one; a source ends with the document that comes nearest to its quota; repeated rows count each; empty
tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.tokens import BYTE_BPE, VOCABULARY_FOLDER, token_counts
from lorebase.session import Scratch, spread_cumsum

GOLDEN = 0.6180339887498949
BLOCK_TOKENS = 8192
#: Documents in a bucket of a source's shuffled order (about), and slots in a bucket of the schedule.
ORDER_BUCKET = 1 << 14
SLOT_BUCKET = 1 << 14
#: A golden-ratio sequence gives each source its number of slots but for a few; so many more are made for the rarest.
SPARE_SLOTS = 32


def same_source(c: str) -> Column:
    """The one spelling of a source: lower case, no outer blanks, underscores for hyphens; null where blank."""
    plain = F.regexp_replace(F.lower(F.trim(F.col(c))), "-", "_")
    return F.when(F.length(plain) > 0, plain)


@dataclass(frozen=True)
class Quota:
    source: str
    share: float
    weight: float
    tokens: int
    repeats: int
    quota: int


def plan_quotas(targets: list[tuple[str, float, int]], tokens: dict[str, int], size: int | None = None) -> tuple[int, list[Quota]]:
    """targets: (source, share, most repeats). Gives the size of the mix and each source's quota of tokens."""
    live = [(s, w, max(1, r or 1)) for s, w, r in targets if s and w and w > 0 and tokens.get(s, 0) > 0]
    total = sum(w for _, w, _ in live)
    if not live:
        return 0, []
    if size is None:
        size = int(min(tokens[s] * r / (w / total) for s, w, r in live))
    out = []
    for s, w, r in live:
        quota = min(int(size * w / total), tokens[s] * r)
        out.append(Quota(s, w, w / total, tokens[s], r, quota))
    return size, out


def sized(documents: DataFrame, folder: str = VOCABULARY_FOLDER, name: str = BYTE_BPE) -> DataFrame:
    """(doc_id, source, n_tokens) of documents that have a source and tokens."""
    rows = documents.withColumn("source", same_source("source")).filter("source is not null and text is not null and text <> ''")
    return token_counts(rows, ["doc_id", "source"], folder, name)


def mix(
    spark: SparkSession,
    documents: DataFrame,
    targets: DataFrame,
    size: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 0,
    folder: str = VOCABULARY_FOLDER,
) -> tuple[DataFrame, DataFrame]:
    """Gives the mix (slot, at, doc_id, source, repeat, n_tokens), in order of (slot, at), and the report
    (source, target_share, actual_share, n_tokens, source_tokens, times, max_repeats), one row per target."""
    scratch = Scratch(spark, "mixing")
    # whole targets: one row per source, spellings joined; the table is fixed and small, its size is the number of sources
    goals = targets.select(same_source("source").alias("source"), "target_share", "max_repeats").filter("source is not null")
    goals = goals.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most"))
    wanted = [(r.source, r.share, r.most) for r in goals.collect()]
    docs = scratch.keep(sized(documents, folder).filter(F.col("source").isin([s for s, _, _ in wanted])))
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()
    tokens = {r.source: r.n for r in totals}
    # a bucket is the first bits of the key: as many as cut the largest source into buckets of about ORDER_BUCKET documents
    bits = max(1, math.ceil(math.log2(max((r.k for r in totals), default=1) / ORDER_BUCKET + 1)))
    size, quotas = plan_quotas(wanted, tokens, size)
    rows = [(q.source, q.quota, -(-q.quota // q.tokens)) for q in quotas]
    quota = spark.createDataFrame(rows, "source string, quota long, rounds int")

    # one copy per repeat, each in an order of its own
    copies = docs.join(F.broadcast(quota), "source").withColumn("repeat", F.explode(F.sequence(F.lit(1), "rounds")))
    key = F.xxhash64("doc_id", "repeat", F.lit(seed))
    ranked = copies.withColumn("key", key).withColumn(
        "bucket", F.col("repeat") * (1 << bits) + F.shiftright(F.col("key"), 64 - bits) + (1 << (bits - 1))
    )
    placed = spread_cumsum(ranked, ["source"], "bucket", ["key", "doc_id"], "n_tokens", "before").filter("before + n_tokens / 2 <= quota")
    blocks = scratch.keep(
        placed.select("source", F.floor(F.col("before") / block_tokens).alias("block"), "before", "doc_id", "repeat", "n_tokens")
    )
    schedule = slots(spark, quotas, block_tokens)
    # a block without a slot must not vanish: there are more slots than blocks, and where there are not the job ends
    slot = F.when(F.col("slot").isNotNull(), F.col("slot")).otherwise(F.raise_error(F.lit("a block has no slot")).cast("long")).alias("slot")
    mixed = blocks.join(schedule, ["source", "block"], "left").select(
        slot, (F.col("before") - F.col("block") * block_tokens).alias("at"), "doc_id", "source", "repeat", "n_tokens"
    )
    return mixed, _report(spark, blocks, wanted, tokens)


def slots(spark: SparkSession, quotas: list[Quota], block_tokens: int) -> DataFrame:
    """(slot, source, block): which block of which source each slot takes."""
    if not quotas:
        return spark.createDataFrame([], "slot long, source string, block long")
    total = sum(q.quota for q in quotas)
    weights = [q.quota / total for q in quotas]
    needed = -(-total // block_tokens) + len(quotas)
    n = needed + int(SPARE_SLOTS / min(w for w in weights if w > 0)) if total else 0
    point = F.col("slot") * F.lit(GOLDEN)
    point = point - F.floor(point)
    name, edge = F.lit(quotas[-1].source), 1.0
    for q, w in reversed(list(zip(quotas, weights))[:-1]):
        edge -= weights[quotas.index(q) + 1]
        name = F.when(point < edge, q.source).otherwise(name)
    drawn = spark.range(n).select(F.col("id").alias("slot"), F.floor(F.col("id") / SLOT_BUCKET).alias("bucket"), F.lit(1).alias("one")).withColumn("source", name)
    return spread_cumsum(drawn, ["source"], "bucket", ["slot"], "one", "block").select("slot", "source", "block")


def _report(spark: SparkSession, blocks: DataFrame, wanted: list, tokens: dict[str, int]) -> DataFrame:
    """One row per target: only totals per source come to the driver."""
    taken = {r.source: r.n for r in blocks.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(taken.values())
    rows = []
    for source, share, most in wanted:
        n, have = taken.get(source, 0), tokens.get(source, 0)
        rows.append(
            (source, None if share is None else float(share), round(n / total, 6) if total else 0.0, n, have, round(n / have, 6) if have else 0.0, most)
        )
    return spark.createDataFrame(
        rows, "source string, target_share double, actual_share double, n_tokens long, source_tokens long, times double, max_repeats int"
    )
