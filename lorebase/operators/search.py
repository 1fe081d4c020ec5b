"""Search and ranking: lexical and vector rankings, reciprocal rank fusion, graph expansion, rerank, staleness and recency.

All searches are batches of queries: (query_id, text, scope, vec). A query sees the user's scope and its own, so candidates come from joins on
scope first. Rank ties go to the larger id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.functions.similarity import PART, cosine, in_parts
from lorebase.operators import models
from lorebase.operators.lexical import best
from lorebase.operators.models import Score
from lorebase.session import Scratch, free_plans
from lorebase.sources.records import as_of

RRF_K = 60
LIMIT_DEFAULT, LIMIT_MOST, POOL = 10, 50, 30
DISTANCE_MOST = 0.55
SEEDS, GRAPH_SHARE, GRAPH_BONUS = 8, 0.5, 0.1
RERANK_TOP = 15
MISSING_FACTOR, CHANGED_FACTOR = 0.05, 0.6
INTENT_DAYS, EPISODIC_DAYS, EPISODIC_LOSS = 7.0, 30.0, 0.4
SCORE_LEAST = 1e-6


def terms(c: Column) -> Column:
    """Lower-case runs of letters or digits, no stop words, no stems."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def candidates_per_ranker(limit: int) -> int:
    return max(50, 4 * limit)


def _joined(text: str, name: str, once: bool) -> Column:
    """A text's terms set apart by blanks, which no term has."""
    ts = terms(F.col(text))
    return F.array_join(F.array_distinct(ts) if once else ts, " ").alias(name)


def seen_scopes(queries: DataFrame) -> DataFrame:
    """Queries, once for each scope they see."""
    return queries.withColumn("scope", F.explode(F.array_distinct(F.array(F.lit("user"), F.coalesce("scope", F.lit("user"))))))


def lexical(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, lex, rank): any query term may match; the k best of each query. A term's gain is the sum of 1 / j**2 over its occurrences: it saturates, and knows no other record."""
    return _ranks(_lexical_hits(queries, docs, k), k)


def _lexical_hits(queries: DataFrame, docs: DataFrame, k: int, *along: str) -> DataFrame:
    """(query_id, id, lex): the k best of each query are among them, with more columns of docs if asked for."""
    return _hits(seen_scopes(queries.select("query_id", "scope", _joined("text", "ts", True))), docs.select("id", "scope", _joined("content", "ts", False), *along), k)


def lexical_everywhere(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """As :func:`lexical`, over the records of all scopes."""
    one = F.lit("").alias("scope")
    return _ranks(_hits(queries.select("query_id", one, _joined("text", "ts", True)), docs.select("id", one, _joined("content", "ts", False)), k), k)


def _hits(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return best(queries.filter("query_id is not null and ts <> ''"), docs.filter("id is not null and ts <> ''"), k)


def _ranks(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("lex"), F.desc("id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector(queries: DataFrame, docs: DataFrame, k: int, most: float = DISTANCE_MOST, *along: str) -> DataFrame:
    """(query_id, id, dist, rank): exact nearest neighbours by cosine, the k nearest first, then those within ``most``; with more columns of docs if asked for.

    A scope is cut into parts of bounded size, and only the k nearest of a task leave it; :mod:`lorebase.operators.vectorindex` reads less.
    """
    by = ["embedding_model"] if _same_model(queries, docs) else []
    q = seen_scopes(queries.filter("vec is not null").select("query_id", "scope", F.col("vec").alias("qv"), *by))
    d = docs.filter("vec is not null").select("id", "scope", "vec", *by, *along)
    dist = F.round(1 - cosine(F.col("qv"), F.col("vec")), 9).alias("dist")
    w = Window.partitionBy("query_id").orderBy("dist", F.desc("id"))
    each, cut, keys = in_parts(q, d, ["scope", *by])
    near = each.join(cut, keys).filter("id <> query_id").select("query_id", "id", dist, *along)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).filter(F.col("dist") <= most)


def nearest_of_all(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, dist, rank): the k nearest of all rows (id, vec) to each query (query_id, vec), which meets every part of the rows once."""
    d = rows.filter("vec is not null").select("id", "vec")
    parts = d.agg(F.ceil(F.count("*") / PART)).first()[0] or 1  # a number comes to the driver
    each = queries.filter("vec is not null").select("query_id", F.col("vec").alias("qv"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1))).alias("_part"))
    cut = d.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    near = each.join(cut, "_part").filter("id <> query_id").select("query_id", "id", F.round(1 - cosine(F.col("qv"), F.col("vec")), 9).alias("dist"))
    w = Window.partitionBy("query_id").orderBy("dist", F.desc("id"))
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(*rankings: DataFrame) -> DataFrame:
    """(query_id, id, score): reciprocal rank fusion, scaled so that first everywhere is 1."""
    ranks = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        ranks = ranks.unionByName(r.select("query_id", "id", "rank"))
    return ranks.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))) * (RRF_K + 1) / len(rankings), 9).alias("score"))


def _same_model(queries: DataFrame, docs: DataFrame) -> bool:
    """Whether vectors carry the name of their model (embedding_model); then both sides must, and only vectors of one model are compared."""
    named = ["embedding_model" in f.columns for f in (queries, docs)]
    if any(named) and not all(named):
        raise ValueError("vectors of a named model need the name on both sides: embedding_model")
    return all(named)


def hybrid(queries: DataFrame, docs: DataFrame, limit: int = LIMIT_DEFAULT, most: float = DISTANCE_MOST, vectors: bool = True) -> DataFrame:
    """(query_id, id, score, place): lexical and vector rankings fused, or the lexical one alone. docs: id, scope, content, created_at, vec."""
    limit = min(limit, LIMIT_MOST)
    k = candidates_per_ranker(limit)
    # all that a query needs from here on comes with its hits, so they are shuffled once
    hits = _lexical_hits(queries, docs, k, "created_at").withColumn("vrank", F.lit(None).cast("int"))
    if vectors:
        near = vector(queries, docs, k, most, "created_at").select("query_id", "id", F.lit(None).cast("double").alias("lex"), "created_at", F.col("rank").alias("vrank"))
        hits = hits.unionByName(near)
    hits = hits.repartition("query_id")
    by_lex = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("lex"), F.desc("id"))
    ranked = hits.withColumn("rank", F.coalesce("vrank", F.row_number().over(by_lex))).filter(F.col("rank") <= k)
    score = F.round(F.sum(1.0 / (RRF_K + F.col("rank"))) * (RRF_K + 1) / (1 + vectors), 9).alias("score")
    return _placed(ranked.groupBy("query_id", "id").agg(score, F.first("created_at").alias("created_at")), limit)


def _fused(rankings: list[DataFrame], docs: DataFrame, limit: int) -> DataFrame:
    return _placed(fuse(*rankings).join(docs.select("id", "created_at"), "id"), limit)


def _placed(fused: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_at"), F.desc("id"))
    return fused.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("query_id", "id", "score", "place")


# ---- the pipeline's stages

# fixed values: words that ask for the recent, not as the first part of a compound; in Korean wherever they stand
INTENT_WORDS = ("last", "latest", "recent", "recently", "most recent", "previous", "yesterday", "today", "this week", "this morning", "lately", "just now")
INTENT_KOREAN = ("최근", "지난번", "지난 ?세션", "저번", "마지막", "어제", "오늘", "방금", "요즘", "최신", "이번 ?주")
INTENT = rf"(?i)\b(?:{'|'.join(INTENT_WORDS)})\b(?:[^-]|$)|{'|'.join(INTENT_KOREAN)}"


def temporal_intent(text: Column) -> Column:
    """Whether a query asks for what is recent."""
    return F.coalesce(text.rlike(INTENT), F.lit(False))


def stale_factors(refs: DataFrame) -> DataFrame:
    """(id, factor): the smallest factor over a record's references."""
    f = F.when(F.col("state") == "missing", MISSING_FACTOR).when((F.col("state") == "changed") & (F.col("symbol") != ""), CHANGED_FACTOR).otherwise(1.0)
    return refs.groupBy(F.col("memory_id").alias("id")).agg(F.min(f).alias("factor"))


def recency(intent: Column, mem_type: Column, reranked: Column, age_days: Column) -> Column:
    """The factor of a record's age: strong where the query asks for the recent, mild for reranked episodes, else none."""
    age = F.greatest(age_days, F.lit(0.0))
    mild = 1 - EPISODIC_LOSS * (1 - F.pow(F.lit(2.0), -age / EPISODIC_DAYS))
    return F.when(intent, F.pow(F.lit(2.0), -age / INTENT_DAYS)).when((mem_type == "episodic") & reranked, mild).otherwise(1.0)


def overlap_reranker(text: Column, content: Column) -> Column:
    """The default reranker: share of the query's terms that the record has."""
    q = F.array_distinct(terms(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms(content))) / F.size(q)).otherwise(0.0)


def clamp_score(s: Column) -> Column:
    return F.least(F.greatest(F.coalesce(F.nanvl(s, F.lit(0.0)), F.lit(0.0)), F.lit(SCORE_LEAST)), F.lit(1.0))


def expand(first: DataFrame, queries: DataFrame, docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id, graph): neighbours of the best SEEDS hits of each query, scored by half of the seed's score (the best seed counts). What a hub joins is met by scope, so its
    records outside the scopes that a query sees are no pairs."""
    seeds = first.filter(F.col("place") <= SEEDS).select("query_id", F.col("id").alias("seed"), "score")
    seen = seen_scopes(queries.select("query_id", "scope"))
    at = docs.select("id", "scope")
    both = edges.select(F.col("src").alias("seed"), F.col("dst").alias("id")).unionByName(edges.select(F.col("dst").alias("seed"), F.col("src").alias("id")))
    direct = seeds.join(both, "seed").groupBy("query_id", "id").agg(F.max("score").alias("score")).join(at, "id").join(seen, ["query_id", "scope"], "left_semi").select("query_id", "id", "score")
    up = edges.filter("relation = 'derived_from'").select(F.col("src").alias("seed"), "dst")
    held = up.select("dst", F.col("seed").alias("id")).join(at, "id")
    sib = seeds.join(up, "seed").join(seen, "query_id").join(held, ["dst", "scope"]).filter("id <> seed").select("query_id", "id", "score")
    return direct.unionByName(sib).filter("id <> query_id").groupBy("query_id", "id").agg((F.max("score") * GRAPH_SHARE).alias("graph"))


def _pool(first: DataFrame, queries: DataFrame, docs: DataFrame, edges: DataFrame | None) -> DataFrame:
    """The hits of the hybrid search, with what the graph adds where there are edges, in their order before any rerank (pre)."""
    pool = first.select("query_id", "id", F.col("score").alias("first"))
    if edges is not None:
        reached = expand(first, queries, docs, edges)
        pool = pool.join(reached, ["query_id", "id"], "full").select("query_id", "id", F.coalesce("first", F.lit(0.0)).alias("first"), F.coalesce("graph", F.lit(0.0)).alias("graph"))
    else:
        pool = pool.withColumn("graph", F.lit(0.0))
    pre = F.when(F.col("first") > 0, F.col("first") + GRAPH_BONUS * F.col("graph")).otherwise(F.col("graph"))
    rows = pool.withColumn("score", F.round(pre, 9)).join(docs.select("id", "mem_type", "created_at"), "id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_at"), F.desc("id"))
    rows = rows.withColumn("pre", F.row_number().over(w))
    return rows.join(queries.select("query_id", temporal_intent(F.col("text")).alias("intent")), "query_id")


def _top_texts(rows: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, id, text, content) of what is reranked: only these rows carry texts."""
    top = rows.filter(F.col("pre") <= RERANK_TOP).select("query_id", "id")
    return top.join(docs.select("id", "content"), "id").join(queries.select("query_id", "text"), "query_id").select("query_id", "id", "text", "content")


def _overlaps(scratch: Scratch, rows: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows, with the overlap of those that are reranked."""
    got = _kept(scratch, _top_texts(rows, queries, docs).select("query_id", "id", overlap_reranker(F.col("text"), F.col("content")).alias("overlap")))
    return rows.join(got, ["query_id", "id"], "left")


def _kept(scratch: Scratch, df: DataFrame) -> DataFrame:
    """Kept, and what was shuffled for it let go of."""
    out = scratch.keep(df)
    free_plans(scratch.spark)
    return out


def _age(at: Column | None) -> Column:
    return (F.unix_micros(as_of() if at is None else at) - F.unix_micros("created_at")) / 86_400_000_000.0


def pipeline(
    spark: SparkSession,
    queries: DataFrame,
    docs: DataFrame,
    edges: DataFrame,
    refs: DataFrame,
    limit: int = LIMIT_DEFAULT,
    most: float = DISTANCE_MOST,
    rerank: bool = True,
    graph: bool = True,
    use_recency: bool = True,
    use_stale: bool = True,
    vectors: bool = True,
    score: Score | None = None,
    at: Column | None = None,
    trace: list[DataFrame] | None = None,
) -> DataFrame:
    """(query_id, id, score, place, reranked): hybrid pool, graph expansion, rerank of the top, staleness and recency.

    Without a reranker there is no expansion. docs: id, scope, mem_type, content, created_at, vec. ``score`` is a reranker's batch function (:func:`lorebase.operators.models.rerank`),
    word overlap without one; a query that it fails on keeps its order and loses what only the graph found. ``at``: the time that ages are judged at. ``trace`` takes (stage, n) frames.
    """
    scratch = Scratch(spark, "search")
    first = _kept(scratch, hybrid(queries, docs, max(POOL, limit), most, vectors))
    rows = _pool(first, queries, docs, edges if rerank and graph else None)
    if rerank:
        rows = _kept(scratch, rows)
    if rerank and score is not None:
        got = models.rerank(_top_texts(rows, queries, docs), score)
        ok = got.select("query_id").distinct().withColumn("ok", F.lit(True))
        rows = rows.join(got, ["query_id", "id"], "left").join(ok, "query_id", "left").filter("ok or first > 0")
        rows = rows.withColumn("reranked", F.col("rerank").isNotNull()).withColumn("score", F.coalesce("rerank", F.when(F.col("ok"), F.col("score")).otherwise(F.col("first"))))
    elif rerank:
        rows = _overlaps(scratch, rows, queries, docs).withColumn("reranked", F.col("pre") <= RERANK_TOP)
        rows = rows.withColumn("score", F.when(F.col("reranked"), F.col("overlap")).otherwise(F.col("score")))
    else:
        rows = rows.withColumn("reranked", F.lit(False))
    if use_stale:
        rows = rows.join(stale_factors(refs), "id", "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0)))
    if use_recency:
        rows = rows.withColumn("score", F.col("score") * recency(F.col("intent"), F.col("mem_type"), F.col("reranked"), _age(at)))
    rows = rows.withColumn("score", F.round(clamp_score(F.col("score")), 6))
    if trace is not None:
        rows = scratch.keep(rows)
        stages = (("first", first), ("graph", rows.filter("graph > 0")), ("pool", rows), ("reranked", rows.filter("reranked")))
        trace += [f.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, f in stages]
    last = Window.partitionBy("query_id").orderBy(F.desc("reranked"), F.desc("score"), F.desc("created_at"), F.desc("id"))
    return rows.withColumn("place", F.row_number().over(last)).filter(F.col("place") <= min(limit, LIMIT_MOST)).select("query_id", "id", "score", "place", "reranked")


def ablation(
    spark: SparkSession,
    queries: DataFrame,
    docs: DataFrame,
    edges: DataFrame,
    refs: DataFrame,
    configurations: dict[str, dict[str, bool]],
    limit: int = LIMIT_DEFAULT,
    most: float = DISTANCE_MOST,
    at: Column | None = None,
) -> DataFrame:
    """(config, query_id, id, place): :func:`pipeline` under several configurations (its switches by name). Each ranking, and each pool with all signals, is computed once."""
    scratch = Scratch(spark, "ablation")
    size = min(max(POOL, limit), LIMIT_MOST)
    k = candidates_per_ranker(size)
    on = {name: {"rerank": True, "graph": True, "use_recency": True, "use_stale": True, "vectors": True} | options for name, options in configurations.items()}
    pool_of = {name: (o["vectors"], o["rerank"] and o["graph"]) for name, o in on.items()}
    rankings = [_kept(scratch, lexical(queries, docs, k))]
    if any(vectors for vectors, _ in pool_of.values()):
        rankings.append(_kept(scratch, vector(queries, docs, k, most)))
    first = {v: _kept(scratch, _fused(rankings if v else rankings[:1], docs, size)) for v in {v for v, _ in pool_of.values()}}
    scratch.drop(*rankings)
    out = []
    for pool in dict.fromkeys(pool_of.values()):
        base = _kept(scratch, _pool(first[pool[0]], queries, docs, edges if pool[1] else None))
        rows = _overlaps(scratch, base, queries, docs).join(stale_factors(refs), "id", "left")
        top = F.col("pre") <= RERANK_TOP
        each = []
        for name in (n for n, p in pool_of.items() if p == pool):
            o = on[name]
            reranked = top if o["rerank"] else F.lit(False)
            score = F.when(reranked, F.col("overlap")).otherwise(F.col("score"))
            score = score * F.coalesce("factor", F.lit(1.0)) if o["use_stale"] else score
            score = score * recency(F.col("intent"), F.col("mem_type"), reranked, _age(at)) if o["use_recency"] else score
            each.append(F.struct(F.lit(name).alias("config"), reranked.alias("reranked"), F.round(clamp_score(score), 6).alias("score")))
        rows = rows.select("query_id", "id", "created_at", F.explode(F.array(*each)).alias("c")).select("query_id", "id", "created_at", "c.*")
        w = Window.partitionBy("config", "query_id").orderBy(F.desc("reranked"), F.desc("score"), F.desc("created_at"), F.desc("id"))
        rows = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= min(limit, LIMIT_MOST)).select("config", "query_id", "id", "place")
        out.append(_kept(scratch, rows))
        scratch.drop(base)
    return scratch.together(out)
