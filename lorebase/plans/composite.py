"""Registered queries that compose several operators: overviews, checks of written texts, the vector index, reader contexts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorebase.functions import secrets
from lorebase.operators import consolidate, context, extract, graph, records, search, vectorindex
from lorebase.plans.book import Book
from lorebase.plans.retrieval import _STORED, DISTANCE, _asked_of, _docs_of, _kept, _store
from lorebase.plans.scalars import _collapse
from lorebase.plans.sqlviews import AS_OF, EDGE, LIVE, MEM, PROP, REF, STALE, with_views
from lorebase.session import spread_cumsum
from lorebase.sources import records as S
from lorebase.sources.tables import table

book = Book()


@book.query(
    with_views(MEM, LIVE, PROP, REF, STALE)
    + """SELECT 'status ' || coalesce(status, 'none') k, count(*) n FROM mem GROUP BY ALL UNION ALL SELECT 'type ' || mem_type, count(*) FROM live GROUP BY ALL
    UNION ALL SELECT 'proposals ' || status, count(*) FROM prop GROUP BY ALL UNION ALL SELECT 'stale', count(*) FROM mem WHERE status = 'active' AND id IN (SELECT id FROM stale)"""
)
def overview(spark, folder):
    m = S.memory(spark, folder)
    stale = m.filter("status = 'active'").join(records.stale_ids(S.refs(spark, folder)), "id", "left_semi")
    n = F.count("*").alias("n")
    return (
        m.groupBy(F.concat(F.lit("status "), F.coalesce("status", F.lit("none"))).alias("k")).agg(n)
        .unionByName(S.live(m).groupBy(F.concat(F.lit("type "), "mem_type").alias("k")).agg(n))
        .unionByName(S.proposals(spark, folder).groupBy(F.concat(F.lit("proposals "), "status").alias("k")).agg(n))
        .unionByName(stale.groupBy(F.lit("stale").alias("k")).agg(n))
    )


@book.query(
    with_views(MEM, LIVE, PROP)
    + """, v AS (SELECT proposal_id, bool_and(i IN (SELECT id FROM live)) ok FROM (SELECT proposal_id, unnest(member_ids) i FROM prop WHERE status = 'pending') GROUP BY ALL)
SELECT kind, id FROM (SELECT 'memory' kind, id, created_at FROM mem WHERE status = 'proposed' UNION ALL SELECT 'proposal', proposal_id, created_at FROM prop JOIN v USING (proposal_id) WHERE ok) ORDER BY created_at, kind, id LIMIT 100"""
)
def review(spark, folder):
    """The first hundred of the review queue, oldest first: proposed records and live pending proposals."""
    m, p = S.memory(spark, folder), S.proposals(spark, folder).filter("status = 'pending'")
    ok = consolidate.liveness(p, m).filter("is_live").select("proposal_id")
    a = m.filter("status = 'proposed'").select(F.lit("memory").alias("kind"), "id", "created_at")
    b = p.join(ok, "proposal_id", "left_semi").select(F.lit("proposal").alias("kind"), F.col("proposal_id").alias("id"), "created_at")
    return a.unionByName(b).orderBy("created_at", "kind", "id").limit(100).select("kind", "id")


@book.query(
    with_views(MEM, EDGE, REF)
    + "SELECT m.id, (SELECT count(*) FROM edge e WHERE e.src = m.id OR e.dst = m.id) n_links, (SELECT count(*) FROM ref r WHERE r.memory_id = m.id AND state <> 'unresolved') n_refs, (SELECT count(*) FROM mem x WHERE x.supersedes = m.id) n_newer FROM mem m WHERE m.line_no % 50 = 0"
)
def memory_detail(spark, folder):
    """What a page about each asking record counts."""
    m = S.memory(spark, folder)
    s = m.filter(F.col("line_no") % 50 == 0).select("id")
    n = F.count("*")
    links = graph.links(s, S.edges(spark, folder)).groupBy("id").agg(n.alias("n_links"))
    refs = S.refs(spark, folder).filter("state <> 'unresolved'").groupBy(F.col("memory_id").alias("id")).agg(n.alias("n_refs"))
    newer = m.filter("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(n.alias("n_newer"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.join(links, "id", "left").join(refs, "id", "left").join(newer, "id", "left").select("id", zero("n_links"), zero("n_refs"), zero("n_newer"))


_SPANS = "list_filter(list_concat({each}), lambda x: length(x) >= 40)"


def _spans(x: str) -> str:
    return _SPANS.format(each=", ".join(f"regexp_extract_all({x}, '{q}', 1)" for q in extract.QUOTES))


_T = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2)"


@book.query(
    """WITH s AS (SELECT session_id, max(session) session FROM sessions WHERE session IS NOT NULL GROUP BY ALL), c AS (SELECT line_no, content, session FROM memories JOIN s ON s.session_id = memories.source_session WHERE content IS NOT NULL),
"""
    + f"t AS (SELECT line_no, content, session, {_T.format(x='content')} a, list_distinct({_T.format(x='session')}) b FROM c)"
    + """ SELECT line_no, (contains(lower(trim(regexp_replace(session, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g'))), lower(trim(regexp_replace(content, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g'))))
    OR CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a) ELSE 0 END >= 0.7) grounded FROM t"""
)
def grounded(spark, folder):
    """Whether each record stands in the session it comes from."""
    s = table(spark, folder, "sessions").filter("session is not null").groupBy("session_id").agg(F.max("session").alias("session"))
    m = table(spark, folder, "memories").filter("content is not null").select("line_no", "content", F.col("source_session").alias("session_id"))
    return m.join(s, "session_id").select("line_no", extract.grounded(F.col("content"), F.col("session")).alias("grounded"))


def _secret_sql(x: str) -> str:
    """Whether a text breaks a rule; what a rule only looks ahead to is part of the match here."""
    return " OR ".join(f"regexp_matches({x}, '{rule.replace(chr(39), chr(39) * 2).replace('(?=@)', '@')}')" for _, rule in secrets.RULES)


def _inside_sql(source: str) -> str:
    """Whether a text (plain, of tokens a) stands in a source (of tokens h), as it is or with most of its tokens."""
    return f"(contains(lower({_collapse(source)}), lower(plain)) OR CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: list_contains(h, x)))::DOUBLE / len(a) ELSE 0 END >= 0.7)"


@book.query(
    f"""WITH s AS (SELECT session_id, max(session) source FROM sessions WHERE session IS NOT NULL GROUP BY ALL),
c AS (SELECT line_no cand_id, session_id, source, confidence, {_collapse("coalesce(content, '')")} plain FROM memories JOIN s ON s.session_id = source_session),
g AS (SELECT cand_id, {_inside_sql('source')} ok FROM (SELECT cand_id, plain, source, {_T.format(x='plain')} a, {_T.format(x='source')} h FROM c)),
q AS (SELECT cand_id, bool_or(len(a) > 0 AND {_inside_sql('q')}) quoted FROM (SELECT cand_id, plain, q, {_T.format(x='plain')} a, {_T.format(x='q')} h FROM (SELECT cand_id, plain, unnest({_spans('source')}) q FROM c)) GROUP BY ALL),
f AS (SELECT c.*, CASE WHEN length(plain) < 8 THEN 'short' WHEN length(plain) > 400 THEN 'long' WHEN {_secret_sql('plain')} THEN 'secret' WHEN coalesce(confidence, 0) < 0.5 THEN 'unsure'
  WHEN NOT ok THEN 'not_grounded' WHEN quoted THEN 'quoted' END r FROM c JOIN g USING (cand_id) LEFT JOIN q USING (cand_id)),
t AS (SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN row_number() OVER (PARTITION BY session_id, r, lower(plain) ORDER BY cand_id) > 1 THEN 'repeated' END v FROM f),
z AS (SELECT v, row_number() OVER (PARTITION BY session_id, v ORDER BY confidence DESC NULLS LAST, cand_id) place FROM t)
SELECT coalesce(v, CASE WHEN place > 8 THEN 'too_many' END, 'kept') outcome, count(*) n FROM z GROUP BY ALL"""
)
def extract_validate(spark, folder):
    """Records as candidates, judged against the sessions they come from."""
    s = table(spark, folder, "sessions").filter("session is not null").groupBy("session_id").agg(F.max("session").alias("source"))
    m = table(spark, folder, "memories").select(F.col("line_no").alias("cand_id"), F.col("source_session").alias("session_id"), F.col("content").alias("text"), "confidence")
    got = extract.validate(m.join(s, "session_id").withColumnRenamed("session_id", "source_id"))
    return got.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@book.query(
    with_views(MEM, PROP)
    + """, d AS (SELECT proposal_id, content, unnest(member_ids) i FROM prop WHERE kind = 'digest'), g AS (SELECT proposal_id, any_value(d.content) t, string_agg(m.content, chr(10)) s FROM d JOIN mem m ON m.id = d.i WHERE m.content IS NOT NULL GROUP BY ALL)
SELECT proposal_id digest_id, CASE WHEN length(coalesce(t, '')) < 40 THEN 'short' WHEN length(t) > 3000 THEN 'long'
  WHEN list_bool_or(list_transform(regexp_extract_all(t, '(?:[A-Za-z0-9_-]+/)+[A-Za-z0-9_.-]+|\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\\b|\\b\\d+\\.\\d+\\.\\d+\\b'), lambda x: NOT contains(s, x))) THEN 'unknown_code' END reject_reason FROM g"""
)
def digest_check(spark, folder):
    """Digests against the texts of their members."""
    d = S.proposals(spark, folder).filter("kind = 'digest'").select("proposal_id", "content", F.explode("member_ids").alias("id"))
    m = S.memory(spark, folder).filter("content is not null").select("id", F.col("content").alias("c"))
    g = d.join(m, "id").select(F.col("proposal_id").alias("digest_id"), F.col("content").alias("text"), F.col("c").alias("source"))
    return extract.digest_check(g)


@book.query("SELECT src_table, sum(n)::BIGINT n FROM (SELECT 'memories' src_table, count(*) n FROM memories WHERE content LIKE '%BEGIN PRIVATE KEY%' UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE session LIKE '%BEGIN PRIVATE KEY%') GROUP BY ALL")
def scan_secrets(spark, folder):
    """How many texts hold a private key."""
    has = lambda c: F.count_if(F.array_contains(secrets.findings(F.coalesce(c, F.lit(""))), "private-key")).alias("n")
    a = table(spark, folder, "memories").agg(has("content")).select(F.lit("memories").alias("src_table"), "n")
    return a.unionByName(table(spark, folder, "sessions").agg(has("session")).select(F.lit("sessions").alias("src_table"), "n"))


_VEC = f"""v AS (SELECT vec_id id, embedding::DOUBLE[] e FROM embeddings), x AS (SELECT q.id query_id, v.id, round(1 - list_cosine_similarity(q.e, v.e), 9) dist FROM v q JOIN v ON q.id <> v.id WHERE q.id % 50 = 0)"""


@book.query(f'WITH {_VEC} SELECT * FROM (SELECT query_id, id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, id DESC)::INT "rank" FROM x) WHERE "rank" <= 10')
def vector_exact(spark, folder):
    """The ten nearest of every fiftieth vector among all: one block of queries against the table."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    return search.nearest_of_all(q, v, 10)


CELLS, PROBES = 16, 12


@book.query()
def vector_index(spark, folder):
    """The same through the index. The test vectors are near random, the hardest case for cells: three of four are asked for a recall of 0.9."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    return vectorindex.search(q, v, vectorindex.fit(v, CELLS), 10, PROBES)


@book.query()
def vector_index_recall(spark, folder):
    return vectorindex.recall(vector_index(spark, folder), vector_exact(spark, folder))


@book.query(with_views(MEM, LIVE) + f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id DESC) r FROM live WHERE mem_type = 'episodic') WHERE r <= 3 AND {AS_OF} IS NOT NULL")
def recent_episodes(spark, folder):
    m = S.live(S.memory(spark, folder)).filter("mem_type = 'episodic'")
    return records.topk_per(m, ["scope"], [F.desc("created_at"), F.desc("id")], 3).select("id")


@book.query(with_views(MEM, PROP, LIVE) + ", v AS (SELECT proposal_id, bool_and(i IN (SELECT id FROM live)) ok FROM (SELECT proposal_id, unnest(member_ids) i FROM prop WHERE status = 'pending') GROUP BY ALL) SELECT proposal_id, (row_number() OVER (PARTITION BY p.proposal_id ORDER BY m.created_at, m.id))::INT place, m.id FROM (SELECT proposal_id, unnest(member_ids) i FROM prop JOIN v USING (proposal_id) WHERE ok) p JOIN mem m ON m.id = p.i")
def pending_proposals(spark, folder):
    """Live pending proposals with their members, the oldest first."""
    m, p = S.memory(spark, folder), S.proposals(spark, folder).filter("status = 'pending'")
    ok = consolidate.liveness(p, m).filter("is_live").select("proposal_id")
    each = consolidate.members(p).join(ok, "proposal_id", "left_semi").join(m.select("id", "created_at"), "id")
    return each.select("proposal_id", F.row_number().over(W.partitionBy("proposal_id").orderBy("created_at", "id")).alias("place"), "id")


@book.query(with_views(REF, MEM) + "SELECT memory_id, path, symbol, state FROM ref WHERE state <> 'unresolved' AND memory_id IN (SELECT id FROM mem WHERE line_no % 50 = 0)")
def refs_of(spark, folder):
    s = S.memory(spark, folder).filter(F.col("line_no") % 50 == 0).select(F.col("id").alias("memory_id"))
    return S.refs(spark, folder).filter("state <> 'unresolved'").join(s, "memory_id", "left_semi").select("memory_id", "path", "symbol", "state")


@book.query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) spent FROM events")
def budget_ledger(spark, folder):
    """The running total of each user's events."""
    e = table(spark, folder, "events").select("user_id", "event_id", "ts", "value", F.to_date("ts").alias("day"))
    e = spread_cumsum(e, ["user_id"], "day", ["ts", "event_id"], "value", "before", "double")
    return e.select("event_id", F.round(F.col("before") + F.coalesce("value", F.lit(0.0)), 6).alias("spent"))


@book.query("SELECT coalesce(source, 'all') source, count(*) n, round(avg(n_chars), 6) mean_chars, count(*) FILTER (WHERE text IS NULL) n_null FROM (SELECT replace(lower(trim(source)), '-', '_') source, n_chars, text FROM documents WHERE trim(source) <> '') GROUP BY GROUPING SETS ((source), ())")
def bench_rollup(spark, folder):
    d = S.documents(spark, folder).filter("trim(source) <> ''").withColumn("source", F.regexp_replace(F.lower(F.trim("source")), "-", "_"))
    by = d.groupingSets([["source"], []], "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_if(F.col("text").isNull()).alias("n_null"))
    return by.withColumn("source", F.coalesce("source", F.lit("all")))


@book.query(with_views(MEM) + "SELECT id FROM mem WHERE content IS NOT NULL AND sha256(content) NOT IN (SELECT sha256(content) FROM memories WHERE content IS NOT NULL AND loaded_at < TIMESTAMPTZ '2025-01-01 00:00:00+00')")
def resume_cached(spark, folder):
    """Work that is left: contents whose key no earlier run (arrivals before 2025) has."""
    done = table(spark, folder, "memories").filter("content is not null and loaded_at < timestamp'2025-01-01'").select(F.sha2("content", 256).alias("k")).distinct()
    return S.memory(spark, folder).filter("content is not null").withColumn("k", F.sha2("content", 256)).join(done, "k", "left_anti").select("id")


@book.query()
def reader_context(spark, folder):
    """(query_id, id, place, is_hit, used_bytes): hits and their neighbours in their sessions within 20,000 bytes."""
    store = _store(spark, folder, columns=(*_STORED, "source_session"))
    hits = _kept(spark, search.hybrid(_asked_of(store), _docs_of(store), most=DISTANCE).select("query_id", "id", "place"))
    return context.reader_context(hits, _docs_of(store).select("id", "scope", "source_session", "content", "created_at"))


@book.query(f"SELECT doc_id, len({_spans('text')})::INT n FROM documents WHERE text IS NOT NULL")
def quoted_spans(spark, folder):
    """How many long spans every document quotes, in all four kinds of quotes."""
    d = S.documents(spark, folder).filter("text is not null")
    return d.select("doc_id", F.size(extract.quoted_spans(F.col("text"))).alias("n"))


QUERIES, ORACLE = book.QUERIES, book.ORACLE
