"""Registered queries over records in their life: edges and proposals to add, scores and costs, routes, lists and pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorebase.functions import math, secrets, text
from lorebase.operators import consolidate, evaluation, graph, lifecycle, records, search
from lorebase.plans.book import Book
from lorebase.plans.hygiene import cid
from lorebase.plans.retrieval import _NORM, _PIPE, _SEARCH, DISTANCE, _asked_of, _docs_of, _kept, _placed, _ranks, _store, _tok
from lorebase.plans.sqlviews import AS_OF, EDGE, LIVE, MEM, PROP, REF, STALE, with_views
from lorebase.session import Scratch
from lorebase.sources import corpora
from lorebase.sources import records as S
from lorebase.sources.tables import table

book = Book()


@book.query(
    with_views(MEM, EDGE)
    + f""", s AS (SELECT DISTINCT {cid('a_id')} src, {cid('b_id')} dst FROM match_pairs WHERE lower(trim(relation)) = 'same')
SELECT src, dst, 'same_as' relation FROM s WHERE src <> dst AND src IN (SELECT id FROM mem) AND dst IN (SELECT id FROM mem) AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.src = s.src AND e.dst = s.dst AND e.relation = 'same_as')"""
)
def add_edge(spark, folder):
    """Edges to insert for pairs judged the same: what is there already is left alone."""
    p = table(spark, folder, "match_pairs").filter(S.said("relation") == "same")
    new = p.select(S.canonical_id("a_id").alias("src"), S.canonical_id("b_id").alias("dst"), F.lit("same_as").alias("relation"))
    return graph.to_insert(new, S.edges(spark, folder), S.memory(spark, folder))


@book.query(
    with_views(MEM)
    + """SELECT a.id, a.supersedes target, CASE WHEN a.status IS DISTINCT FROM 'proposed' THEN 'not_proposed' WHEN a.id = a.supersedes THEN 'itself' WHEN t.status IS DISTINCT FROM 'active' THEN 'target_not_active'
  WHEN a.scope IS DISTINCT FROM t.scope THEN 'other_scope' ELSE 'approved' END outcome FROM mem a LEFT JOIN mem t ON t.id = a.supersedes WHERE a.supersedes IS NOT NULL"""
)
def approve_replacing(spark, folder):
    m = S.memory(spark, folder)
    return lifecycle.approve_replacing(m, m.filter("supersedes is not null").select("id", F.col("supersedes").alias("target")))


_JUDGED_PAIRS = f"""j AS (SELECT least(a, b) a, greatest(a, b) b, r FROM (SELECT {cid('a_id')} a, {cid('b_id')} b, lower(trim(relation)) r FROM match_pairs) WHERE a <> b AND r IS NOT NULL),
v AS (SELECT a, b, min(r) r FROM j GROUP BY a, b HAVING min(r) = max(r))"""


@book.query(
    with_views(PROP, _JUDGED_PAIRS)
    + "SELECT a, b, CASE r WHEN 'same' THEN 'duplicate' ELSE r END kind, CASE WHEN r = 'distinct' THEN 'dismissed' ELSE 'pending' END status FROM v WHERE NOT EXISTS (SELECT 1 FROM prop WHERE member_ids = [a, b])"
)
def create_proposal(spark, folder):
    """Proposals from judged pairs: a set of members is judged once, distinct ones are dismissed at once."""
    j = consolidate.judge(table(spark, folder, "match_pairs")).filter("verdict <> 'unclear'")
    return consolidate.to_propose(j, S.proposals(spark, folder))


@book.query(with_views(PROP) + "SELECT proposal_id, 'pending' old_status, 'rejected' new_status FROM prop WHERE status = 'pending' AND kind = 'conflict'")
def reject_proposal(spark, folder):
    """The pending conflicts rejected."""
    p = S.proposals(spark, folder)
    return consolidate.reject(p, p.filter("kind = 'conflict'").select("proposal_id"))


@book.query(with_views(MEM, LIVE, PROP) + ", v AS (SELECT proposal_id, bool_and(i IN (SELECT id FROM live)) ok FROM (SELECT proposal_id, unnest(member_ids) i FROM prop WHERE status = 'pending') GROUP BY ALL) SELECT kind, count(*) n FROM prop JOIN v USING (proposal_id) WHERE ok GROUP BY ALL")
def agg_count_status_live(spark, folder):
    """Live pending proposals per kind."""
    p = S.proposals(spark, folder).filter("status = 'pending'")
    ok = consolidate.liveness(p, S.memory(spark, folder)).filter("is_live").select("proposal_id")
    return p.join(ok, "proposal_id", "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


@book.query(with_views(MEM) + f"SELECT id FROM mem WHERE expires_at < {AS_OF} - INTERVAL 1 DAY")
def prune(spark, folder):
    """Records that expired more than a day ago."""
    return lifecycle.expired_for(S.memory(spark, folder), 1, S.as_of())


@book.query(with_views(PROP, MEM) + ", e AS (SELECT proposal_id, unnest(member_ids) id FROM prop) SELECT proposal_id, strftime(min(created_at), '%Y-%m-%d') || CASE WHEN strftime(min(created_at), '%Y-%m-%d') = strftime(max(created_at), '%Y-%m-%d') THEN '' ELSE ' to ' || strftime(max(created_at), '%Y-%m-%d') END period FROM e JOIN mem USING (id) WHERE created_at IS NOT NULL GROUP BY ALL")
def dt_period(spark, folder):
    """The days that a proposal's members span."""
    return consolidate.periods(S.proposals(spark, folder), S.memory(spark, folder))


@book.query(with_views(EDGE, MEM, LIVE) + ", s AS (SELECT id, scope FROM mem WHERE line_no % 50 = 0), adj AS (SELECT src a, dst b FROM edge UNION SELECT dst, src FROM edge) SELECT DISTINCT b id FROM s JOIN adj ON a = s.id JOIN live l ON l.id = b WHERE b NOT IN (SELECT id FROM s)")
def filter_not_all(spark, folder):
    """Live neighbours of the seeds that are no seeds themselves."""
    m = S.memory(spark, folder)
    seeds = m.filter(F.col("line_no") % 50 == 0).select("id")
    near = graph.links(seeds, S.edges(spark, folder)).select(F.col("other").alias("id")).distinct()
    return near.join(seeds, "id", "left_anti").join(S.live(m).select("id"), "id", "left_semi")


@book.query(with_views(MEM) + ", c AS (SELECT scope, count(*) FILTER (WHERE status = 'active') n_active, count(*) FILTER (WHERE status = 'proposed') n_proposed FROM mem GROUP BY ALL) SELECT scope, n_active, n_proposed, (row_number() OVER (ORDER BY coalesce(scope = 'user', false) DESC, scope NULLS FIRST))::INT place FROM c")
def sort_bool_first(spark, folder):
    """Scopes with the user's first; places are numbered over one row a scope."""
    by = records.scope_counts(S.memory(spark, folder))
    return by.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.coalesce(F.col("scope") == "user", F.lit(False))), "scope")))


# ---- scores, costs, routes


@book.query(
    """WITH s AS (SELECT pair_id, model, score * 4 - 1 raw FROM match_pairs WHERE score IS NOT NULL), g AS (SELECT model, bool_and(raw BETWEEN 0 AND 1) fine FROM s GROUP BY ALL)
SELECT pair_id, round(CASE WHEN fine THEN raw ELSE 1 / (1 + exp(-raw)) END, 9) score FROM s JOIN g ON s.model IS NOT DISTINCT FROM g.model"""
)
def sigmoid_scores(spark, folder):
    """Raw scores of a model's run through the logistic function, where any of the run lies outside 0..1."""
    s = table(spark, folder, "match_pairs").filter("score is not null").select("pair_id", "model", (F.col("score") * 4 - 1).alias("raw"))
    return math.scaled(s, ["model"], "raw", "score").select("pair_id", F.round("score", 9).alias("score"))


@book.query("SELECT source, round(sum(greatest(coalesce(n_chars, 0) / 3.0 * 1.25 / 1e6 + 500 * 2.5 / 1e6, 0.05)), 6)::DOUBLE reserved, round(sum(coalesce(n_chars, 0) / 3.0 * 1.25 / 1e6 + 500 * 2.5 / 1e6), 6)::DOUBLE cost FROM documents GROUP BY ALL")
def cost_reserve(spark, folder):
    """What reading each document costs by its tokens, and what is set aside for it."""
    cost = math.cost(F.coalesce("n_chars", F.lit(0)) / 3.0, F.lit(500), 1.25, 2.5)
    return table(spark, folder, "documents").groupBy("source").agg(F.round(F.sum(math.reserve(cost)), 6).alias("reserved"), F.round(F.sum(cost), 6).alias("cost"))


@book.query(with_views(MEM) + "SELECT id, CASE WHEN mem_type IN ('project', 'codebase') AND scope = 'user' THEN 'semantic' ELSE mem_type END mem_type, least(greatest(coalesce(confidence, 0), 0), 1)::DOUBLE confidence FROM mem")
def classify_type(spark, folder):
    """A classifier's answer (here the type as it stands) made to fit: without a project a record of one is semantic, confidences lie in 0..1."""
    return records.classified(S.memory(spark, folder), F.col("mem_type"), F.col("confidence"))


@book.query(
    with_views(MEM)
    + "SELECT id, CASE WHEN trim(coalesce(content, '')) = '' THEN 'abstain' WHEN mem_type = 'temporary' THEN 'temporal' WHEN supersedes IS NOT NULL THEN 'update' WHEN mem_type = 'preference' THEN 'preference' ELSE 'standard' END route FROM mem"
)
def judge_prompt_route(spark, folder):
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    kind = F.when(F.col("mem_type") == "temporary", "temporal").when(F.col("supersedes").isNotNull(), "update").when(F.col("mem_type") == "preference", "preference")
    return S.memory(spark, folder).select("id", records.judge_route(blank, kind).alias("route"))


@book.query("SELECT doc_id, contains(lower(text), 'yes') said_yes FROM documents WHERE text IS NOT NULL")
def judge_yes(spark, folder):
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.contains(F.lower("text"), F.lit("yes")).alias("said_yes"))


@book.query("SELECT label, n, (row_number() OVER (ORDER BY label <> 'all', label))::INT place FROM (SELECT coalesce(k, 'all') label, count(*) n FROM (SELECT lower(trim(lang)) k FROM documents WHERE trim(lang) <> '') GROUP BY GROUPING SETS ((k), ()))")
def bench_label_order(spark, folder):
    """Rows of a report in their order: all first, then by label. One row a label."""
    d = table(spark, folder, "documents").filter("trim(lang) <> ''").select(F.lower(F.trim("lang")).alias("k"))
    by = d.groupingSets([["k"], []], "k").agg(F.count("*").alias("n")).select(F.coalesce("k", F.lit("all")).alias("label"), "n")
    return by.withColumn("place", F.row_number().over(W.orderBy(F.col("label") != "all", "label")))


@book.query(
    "SELECT count(*) FILTER (WHERE event_type = 'signup') pending, count(*) FILTER (WHERE event_type = 'view') running, count(*) FILTER (WHERE event_type = 'error') failed, count(*) FILTER (WHERE event_type NOT IN ('signup', 'view', 'error')) done, coalesce(sum(json_extract(props, '$.k')::BIGINT) FILTER (WHERE event_type NOT IN ('signup', 'view', 'error')), 0)::BIGINT stored FROM events"
)
def extract_status(spark, folder):
    """Jobs per status and what the finished ones stored, over a queue made of events."""
    t = F.col("event_type")
    done = ~t.isin("signup", "view", "error")
    k = F.get_json_object("props", "$.k").try_cast("long")
    n = lambda c, name: F.count_if(c).alias(name)
    return table(spark, folder, "events").agg(
        n(t == "signup", "pending"), n(t == "view", "running"), n(t == "error", "failed"), n(done, "done"), F.coalesce(F.sum(F.when(done, k)), F.lit(0)).cast("long").alias("stored")
    )


# ---- text and JSON


@book.query(
    "WITH x AS (SELECT line_no, list_filter(list_transform(string_split(content, ','), lambda x: trim(regexp_replace(x, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g'))), lambda y: y <> '') l FROM memories WHERE content IS NOT NULL) SELECT line_no, len(l)::INT n, l[1] first_item FROM x"
)
def fn_split_comma(spark, folder):
    items = text.split_list(F.col("content"))
    return table(spark, folder, "memories").filter("content is not null").select("line_no", F.size(items).alias("n"), F.get(items, 0).alias("first_item"))


@book.query(with_views(MEM) + "SELECT id, json_merge_patch('{}', json_object('trust', trust, 'status', status, 'supersedes', supersedes))::VARCHAR o FROM mem")
def json_build_strip_nulls(spark, folder):
    """An object of what is there: nulls are left out."""
    return S.memory(spark, folder).select("id", F.to_json(F.struct("trust", "status", "supersedes")).alias("o"))


@book.query("SELECT substr(sha256(session_id), 1, 24) log, count(*) n FROM sessions WHERE session_id IS NOT NULL AND agent IS NOT NULL GROUP BY ALL")
def session_log_append(spark, folder):
    """Session rows appended to one log per session as JSON lines, and read back."""
    s = table(spark, folder, "sessions").filter("session_id is not null")
    rows = s.select("session_id", F.col("loaded_at").alias("t"), F.col("agent").alias("k"), F.col("project").alias("p"), F.col("session").alias("b"))
    at = f"{Scratch(spark, 'logs').root}/logs"
    corpora.append_log(rows, at)
    got = spark.read.schema("t timestamp, k string, p string, b string, log string").json(at).filter("k is not null")
    return got.groupBy("log").agg(F.count("*").alias("n"))


@book.query(with_views(MEM, LIVE, _SEARCH, _ranks(50), _placed(10)) + "SELECT query_id, substr(string_agg(place || '. ' || coalesce(d.content, ''), chr(10) ORDER BY place), 1, 2000) prompt FROM hyb JOIN docs d USING (id) GROUP BY ALL")
def reader_prompt(spark, folder):
    """The hits of each query as a numbered text of 2,000 characters at most; a query has ten hits at most."""
    store = _store(spark, folder)
    hits = _kept(spark, search.hybrid(_asked_of(store), _docs_of(store), most=DISTANCE))
    line = F.concat(F.col("place").cast("string"), F.lit(". "), F.coalesce("content", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return hits.join(_docs_of(store).select("id", "content"), "id").groupBy("query_id").agg(F.substring(F.array_join(F.transform(rows, lambda x: x["line"]), "\n"), 1, 2000).alias("prompt"))


@book.query()
def json_walk_redact(spark, folder):
    """Attributes with the secrets of all nested strings redacted."""
    m = S.memory(spark, folder).filter("attrs is not null")
    return secrets.redact_json(m.select("id", "attrs"), "id", "attrs").select("id", "redacted", F.size("found").alias("n_rules"))


@book.query()
def rewrite(spark, folder):
    """Records with a secret as they are written again."""
    return lifecycle.rewrite(S.memory(spark, folder), S.as_of(), "secret")


def _parts(x: str) -> str:
    return f"list_transform(string_split({x}, ','), lambda part: {_NORM.format(x='trim(part)')})"


@book.query(
    with_views(MEM)
    + f""", pr AS (SELECT a.id, {_parts('b.content')} gs, {_parts('a.content')} ps FROM mem a JOIN mem b ON b.id = a.supersedes WHERE a.content IS NOT NULL AND b.content IS NOT NULL),
g AS (SELECT id, i, gs[i] gt FROM (SELECT id, gs, unnest(range(1, len(gs) + 1)) i FROM pr)), p AS (SELECT id, k, ps[k] pt FROM (SELECT id, ps, unnest(range(1, len(ps) + 1)) k FROM pr)),
c AS (SELECT g.id, i, len(gt) + len(pt) n, coalesce(list_sum(list_transform(list_distinct(gt), lambda t: least(len(list_filter(gt, lambda u: u = t)), len(list_filter(pt, lambda u: u = t))))), 0) c FROM g JOIN p USING (id)),
b AS (SELECT id, i, max(CASE WHEN c > 0 THEN 2.0::DOUBLE * c / n ELSE 0 END) f FROM c GROUP BY ALL)
SELECT id, round(avg(f), 6) f1 FROM b GROUP BY ALL"""
)
def parts_f1(spark, folder):
    """F1 of each record's comma-separated parts against those of the one it supersedes."""
    m = S.memory(spark, folder).filter("content is not null")
    old = m.select(F.col("id").alias("supersedes"), F.col("content").alias("gold"))
    return evaluation.parts_f1(m.join(old, "supersedes"), "id", F.col("gold"), F.col("content"))


# ---- search


@book.query(
    with_views(MEM, LIVE, _SEARCH)
    + f""", pa AS (SELECT id, t, list_sum(list_transform(range(1, count(*) + 1), lambda j: 1.0::DOUBLE / (j * j))) gain FROM (SELECT id, unnest({_tok('content')}) t FROM docs) GROUP BY ALL),
la AS (SELECT query_id, id, round(sum(gain) / any_value(n), 9) lex FROM qt JOIN pa USING (t) WHERE id <> query_id GROUP BY ALL)
SELECT query_id, id, lex, (row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, id DESC))::INT "rank" FROM la QUALIFY "rank" <= 50"""
)
def search_all_scopes(spark, folder):
    store = _store(spark, folder, vectors=False)
    return search.lexical_everywhere(_asked_of(store), _docs_of(store), 50)


@book.query(
    with_views(MEM, LIVE, EDGE, REF, _SEARCH, _PIPE)
    + "SELECT 'first' stage, count(*) n FROM hyb UNION ALL SELECT 'graph', count(*) FROM pool WHERE g > 0 UNION ALL SELECT 'pool', count(*) FROM pre UNION ALL SELECT 'reranked', count(*) FROM top WHERE reranked"
)
def stage_trace(spark, folder):
    """How many rows each stage of the pipeline has."""
    store, trace = _store(spark, folder), []
    search.pipeline(spark, _asked_of(store), _docs_of(store), S.edges(spark, folder), S.refs(spark, folder, ("state",)), most=DISTANCE, trace=trace)
    out = trace[0]
    for t in trace[1:]:
        out = out.unionByName(t)
    return out


@book.query(
    with_views(MEM, LIVE, EDGE, REF, STALE, _SEARCH, _PIPE)
    + "SELECT query_id, id, score, place, id IN (SELECT id FROM stale) stale FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, score DESC, created_at DESC, id DESC)::INT place FROM fin) WHERE place <= 10"
)
def recall(spark, folder):
    """The pipeline's hits, with whether their references are stale."""
    store, refs = _store(spark, folder), S.refs(spark, folder, ("state",))
    got = search.pipeline(spark, _asked_of(store), _docs_of(store), S.edges(spark, folder), refs, most=DISTANCE)
    stale = records.stale_ids(refs).withColumn("stale", F.lit(True))
    return got.join(stale, "id", "left").select("query_id", "id", "score", "place", F.coalesce("stale", F.lit(False)).alias("stale"))


QUERIES, ORACLE = book.QUERIES, book.ORACLE
