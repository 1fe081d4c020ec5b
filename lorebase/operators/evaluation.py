"""Evaluation of rankings and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, recall5, hit5, rr10) for queries with a relevant record. ranked: query_id, id, place; relevant: query_id, id."""
    rel = relevant.select("query_id", "id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    found = rel.join(ranked.select("query_id", "id", "place"), ["query_id", "id"])
    by = found.groupBy("query_id").agg(F.count_if(F.col("place") <= 5).alias("f5"), F.min("place").alias("p"))
    j = n.join(by, "query_id", "left").select("query_id", "n", F.coalesce("f5", F.lit(0)).alias("f5"), "p")
    return j.select(
        "query_id",
        F.round(F.col("f5") / F.least("n", F.lit(5)), 6).alias("recall5"),
        (F.col("f5") > 0).cast("int").alias("hit5"),
        F.round(F.when(F.col("p") <= 10, 1.0 / F.col("p")).otherwise(0.0), 6).alias("rr10"),
    )


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("recall5"), 6).alias("recall5"), F.round(F.avg("hit5"), 6).alias("hit5"), F.round(F.avg("rr10"), 6).alias("mrr10")
    )


def regressions(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """(query_id, recall5, base5): queries that are worse than the baseline."""
    b = baseline.select("query_id", F.col("recall5").alias("base5"))
    return metrics.join(b, "query_id").filter("recall5 < base5").select("query_id", "recall5", "base5")


def token_f1(pairs: DataFrame, key: str, gold: Column, answer: Column) -> DataFrame:
    """(key, f1): multiset overlap of normalised tokens. Tokens are counted per pair, the counts are joined."""
    from lorebase.functions.text import normalize_answer

    a = pairs.select(key, F.explode(normalize_answer(gold)).alias("t")).groupBy(key, "t").agg(F.count("*").alias("g"))
    b = pairs.select(key, F.explode(normalize_answer(answer)).alias("t")).groupBy(key, "t").agg(F.count("*").alias("p"))
    j = a.join(b, [key, "t"], "full").groupBy(key)
    by = j.agg(F.sum(F.coalesce("g", F.lit(0))).alias("g"), F.sum(F.coalesce("p", F.lit(0))).alias("p"), F.sum(F.coalesce(F.least("g", "p") * F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1), F.lit(0))).alias("c"))
    f1 = F.when((F.col("c") > 0), 2.0 * F.col("c") / (F.col("g") + F.col("p"))).otherwise(0.0)
    return by.select(key, F.round(f1, 6).alias("f1"))


def parts_f1(pairs: DataFrame, key: str, gold: Column, answer: Column) -> DataFrame:
    """(key, f1) for answers that are lists: both sides are cut at commas, each part of the gold answer counts with the best of the answer's parts, and the mean is taken."""
    from lorebase.functions.text import normalize_answer

    cut = lambda c: F.transform(F.split(c, ","), lambda x: normalize_answer(F.trim(x)))
    rows = pairs.select(key, cut(gold).alias("gs"), cut(answer).alias("ps"))
    times = lambda ts, t: F.size(F.filter(ts, lambda x: x == t))

    def one(g: Column, p: Column) -> Column:
        both = F.aggregate(F.array_distinct(g), F.lit(0), lambda s, t: s + F.least(times(g, t), times(p, t)))
        return F.when(both > 0, 2.0 * both / (F.size(g) + F.size(p))).otherwise(F.lit(0.0))

    best = F.transform("gs", lambda g: F.array_max(F.transform("ps", lambda p: one(g, p))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size("gs")
    return rows.select(key, F.round(mean, 6).alias("f1"))


def stratified(rows: DataFrame, stratum: str, key: str, size: int) -> DataFrame:
    """(stratum, key): ``size`` rows shared among strata by largest remainder, the lowest keys of each. (A sampling operator: the limit is the feature.)"""
    n = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    # one row per stratum: these windows hold as many rows as there are strata
    all_ = Window.partitionBy(F.lit(0))
    share = n.withColumn("total", F.sum("n").over(all_)).withColumn("x", F.col("n") * size / F.col("total"))
    share = share.withColumn("base", F.floor("x")).withColumn("left", F.lit(size) - F.sum(F.floor("x")).over(all_))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("x") - F.col("base"), 9)), stratum))
    quota = share.withColumn("quota", F.least("n", F.col("base") + F.when(place <= F.col("left"), 1).otherwise(0))).select(stratum, "quota")
    from lorebase.operators.records import topk_per

    first = topk_per(rows.select(stratum, key), [stratum], [F.asc(key)], size)
    return first.join(F.broadcast(quota), stratum).filter(F.col("rank") <= F.col("quota")).select(stratum, key)


def evidence_recall(retrieved: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, recall): share of a query's evidence (query_id, item) among what was retrieved (query_id, item); -1 where it has none (a null item)."""
    e = evidence.select("query_id", "item").distinct()
    hit = e.join(retrieved.select("query_id", "item").distinct().withColumn("hit", F.lit(1)), ["query_id", "item"], "left")
    by = hit.groupBy("query_id").agg(F.count("item").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("k"))
    return by.select("query_id", F.round(F.when(F.col("n") == 0, -1.0).otherwise(F.col("k") / F.col("n")), 6).alias("recall"))


def pair_confusion(judged: DataFrame, wanted: DataFrame) -> DataFrame:
    """(outcome, n): correct, false_retire (called the same or conflicting without being so), missed. judged: a, b, verdict; wanted: a, b, want."""
    j = wanted.join(judged, ["a", "b"], "left")
    retires = F.col("verdict").isin("same", "conflict")
    outcome = F.when(F.col("verdict") == F.col("want"), "correct").when(retires & (F.col("want") == "distinct"), "false_retire").otherwise("missed")
    return j.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
