"""Registered queries: scans, filters, joins, aggregates, windows, sorts and set operations over records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorebase.operators import records as R
from lorebase.plans.book import Book
from lorebase.plans.sqlviews import AS_OF, EDGE, LIVE, MEM, PROP, REF, STALE, with_views
from lorebase.sources import records as S

book = Book()
_us = F.unix_micros
KILN = "project:git.tarnhold.example/quillon/kiln"

# ---- scans


@book.query(with_views(MEM) + "SELECT id, status, scope, mem_type FROM mem WHERE id IN (SELECT max(id) FROM mem WHERE status = 'deleted')")
def scan_get(spark, folder):
    m = S.memory(spark, folder)
    one = m.filter("status = 'deleted'").agg(F.max("id").alias("id"))
    return R.by_ids(m, one).select("id", "status", "scope", "mem_type")


@book.query(with_views(MEM, LIVE) + f"SELECT id, scope, mem_type, epoch_us(created_at) created_us FROM live WHERE scope IN ('user', '{KILN}') ORDER BY created_at DESC, id DESC LIMIT 50")
def scan_list(spark, folder):
    got = R.list_records(S.memory(spark, folder), scopes=("user", KILN))
    return got.select("id", "scope", "mem_type", _us("created_at").alias("created_us"))


@book.query(with_views(MEM, LIVE, REF, STALE) + "SELECT id, epoch_us(created_at) created_us FROM live WHERE id IN (SELECT id FROM stale) ORDER BY created_at, id LIMIT 100")
def scan_list_stale(spark, folder):
    got = R.list_records(S.memory(spark, folder), stale_of=S.refs(spark, folder), oldest_first=True, limit=100)
    return got.select("id", _us("created_at").alias("created_us"))


@book.query(with_views(MEM) + "SELECT id, floor((row_number() OVER (ORDER BY id) - 1) / 500)::BIGINT page FROM mem")
def scan_foreach(spark, folder):
    """Pages of 500 in id order, numbered over the whole table by ranges instead of one sorted task."""
    from lorebase.session import spread_cumsum

    m = S.memory(spark, folder).select("id", F.substring("id", 1, 5).alias("bucket"), F.lit(1).alias("one"), F.lit(0).alias("k"))
    return spread_cumsum(m, ["k"], "bucket", ["id"], "one", "at").select("id", F.floor(F.col("at") / 500).alias("page"))


@book.query(with_views(MEM, PROP) + "SELECT id, status FROM mem WHERE id IN (SELECT unnest(member_ids) FROM prop WHERE status = 'pending')")
def scan_by_ids(spark, folder):
    ids = S.proposals(spark, folder).filter("status = 'pending'").select(F.explode("member_ids").alias("id")).distinct()
    return R.by_ids(S.memory(spark, folder), ids).select("id", "status")


# ---- projections and filters


@book.query(with_views(MEM) + "SELECT id, json_extract_string(attrs, '$.kind') kind, CASE WHEN json_extract_string(attrs, '$.kind') = 'handoff' THEN json_extract_string(attrs, '$.steps') END next_steps FROM mem")
def project_view(spark, folder):
    kind = F.get_json_object("attrs", "$.kind")
    return S.memory(spark, folder).select("id", kind.alias("kind"), F.when(kind == "handoff", F.get_json_object("attrs", "$.steps")).alias("next_steps"))


@book.query(with_views(MEM, LIVE) + "SELECT id FROM live")
def filter_live(spark, folder):
    return S.live(S.memory(spark, folder)).select("id")


@book.query(with_views(MEM, LIVE) + f"SELECT id FROM live WHERE scope IN ('user', '{KILN}') UNION ALL SELECT id FROM live WHERE scope = 'user' AND mem_type = 'preference'")
def filter_scope_set(spark, folder):
    m = S.live(S.memory(spark, folder))
    return m.filter(F.col("scope").isin("user", KILN)).select("id").unionByName(m.filter("scope = 'user' and mem_type = 'preference'").select("id"))


@book.query(with_views(MEM, REF, STALE) + "SELECT id FROM mem WHERE id IN (SELECT id FROM stale)")
def filter_stale_exists(spark, folder):
    return S.memory(spark, folder).join(R.stale_ids(S.refs(spark, folder)), "id", "left_semi").select("id")


@book.query(with_views(MEM) + "SELECT id FROM mem WHERE coalesce(json_extract_string(attrs, '$.kind'), '') <> 'digest' AND NOT list_contains(json_keys(attrs), 'branch')")
def filter_json_kind(spark, folder):
    kind = F.coalesce(F.get_json_object("attrs", "$.kind"), F.lit(""))
    return S.memory(spark, folder).filter((kind != "digest") & ~F.array_contains(F.json_object_keys("attrs"), "branch")).select("id")


@book.query(with_views(PROP) + "SELECT proposal_id FROM prop WHERE decided_by IS DISTINCT FROM 'user'")
def filter_is_distinct(spark, folder):
    return S.proposals(spark, folder).filter(~F.col("decided_by").eqNullSafe("user")).select("proposal_id")


@book.query(with_views(MEM) + "SELECT id FROM mem WHERE scope LIKE 'project:%' OR scope LIKE 'repo:%'")
def filter_like_prefix(spark, folder):
    return S.memory(spark, folder).filter(F.col("scope").startswith("project:") | F.col("scope").startswith("repo:")).select("id")


@book.query(with_views(PROP) + "SELECT p.proposal_id, q.proposal_id other FROM (SELECT proposal_id, unnest(member_ids) m FROM prop WHERE kind = 'duplicate') p JOIN (SELECT proposal_id, unnest(member_ids) m FROM prop WHERE kind = 'conflict') q USING (m) GROUP BY ALL")
def filter_array_contains(spark, folder):
    """Duplicate and conflict proposals that share a member: overlap as a join on the exploded members, never all pairs."""
    p = S.proposals(spark, folder)
    a = p.filter("kind = 'duplicate'").select("proposal_id", F.explode("member_ids").alias("m"))
    b = p.filter("kind = 'conflict'").select(F.col("proposal_id").alias("other"), F.explode("member_ids").alias("m"))
    return a.join(b, "m").select("proposal_id", "other").distinct()


@book.query("SELECT count(*) FILTER (WHERE regexp_matches(src, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$')) n_valid, count(*) n FROM memory_edges")
def validate_uuid(spark, folder):
    from lorebase.sources.tables import table

    ok = F.col("src").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return table(spark, folder, "memory_edges").agg(F.count_if(ok).alias("n_valid"), F.count("*").alias("n"))


@book.query(
    with_views(MEM)
    + """SELECT id, unnest(list_filter([
  CASE WHEN mem_type IS NULL OR mem_type NOT IN ('preference','semantic','episodic','project','codebase','temporary') THEN 'type' END,
  CASE WHEN status IS NULL OR status NOT IN ('proposed','active','superseded','deleted') THEN 'status' END,
  CASE WHEN trust IS NULL OR trust NOT IN ('user','agent','external') THEN 'trust' END,
  CASE WHEN content IS NULL OR trim(content) = '' THEN 'content' END,
  CASE WHEN scope IS NULL OR NOT regexp_matches(scope, '^(user|(project|repo):.+)$') THEN 'scope' END,
  CASE WHEN confidence IS NULL THEN 'confidence' END, CASE WHEN valid_to < valid_from THEN 'validity' END,
  CASE WHEN mem_type = 'temporary' AND expires_at IS NULL THEN 'expiry' END, CASE WHEN supersedes = id THEN 'self' END,
  CASE WHEN source_agent IS NULL OR NOT regexp_matches(source_agent, '^[a-z0-9][a-z0-9._-]{0,63}$') THEN 'agent' END], lambda x: x IS NOT NULL)) rule FROM mem"""
)
def validate_record(spark, folder):
    return R.violations(S.memory(spark, folder))


@book.query("SELECT vec_id FROM embeddings WHERE len(embedding) <> 64 OR list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))")
def validate_vector(spark, folder):
    from lorebase.sources.tables import table

    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, folder, "embeddings").filter((F.size("embedding") != 64) | bad).select("vec_id")


@book.query("SELECT line_no FROM memory_refs WHERE coalesce(path, '') <> '' AND NOT regexp_matches(path, '(^/|\\.\\.|//|^\\./|\\\\|/$|^~)') AND (coalesce(symbol, '') = '' OR regexp_matches(symbol, '^[A-Za-z_][A-Za-z0-9_.]{0,99}$')) AND (anchor_commit IS NULL OR regexp_matches(anchor_commit, '^[0-9a-f]{7,64}$'))")
def validate_ref_target(spark, folder):
    from lorebase.functions.coderef import valid_target
    from lorebase.sources.tables import table

    return table(spark, folder, "memory_refs").filter(valid_target("path", "symbol", "anchor_commit")).select("line_no")


# ---- joins


@book.query(with_views(MEM, EDGE) + "SELECT src id, dst other, relation, 'out' way FROM edge WHERE src IN (SELECT id FROM mem) UNION ALL SELECT dst, src, relation, 'in' FROM edge WHERE dst IN (SELECT id FROM mem)")
def join_links(spark, folder):
    from lorebase.operators.graph import links

    return links(S.memory(spark, folder), S.edges(spark, folder))


@book.query(with_views(EDGE) + "SELECT a.src id, b.src sibling, count(*) n_shared FROM edge a JOIN edge b ON a.dst = b.dst AND a.relation = b.relation AND a.src <> b.src WHERE a.relation = 'derived_from' GROUP BY ALL")
def join_sibling(spark, folder):
    from lorebase.operators.graph import siblings

    return siblings(S.edges(spark, folder)).groupBy("id", "sibling").agg(F.count("*").alias("n_shared"))


@book.query(with_views(MEM, EDGE) + "SELECT e.src id, m.id parent, m.mem_type, m.status FROM edge e JOIN mem m ON m.id = e.dst WHERE e.relation = 'derived_from'")
def join_derived_from(spark, folder):
    from lorebase.operators.graph import derived_from

    return derived_from(S.memory(spark, folder), S.edges(spark, folder))


@book.query(with_views(MEM, REF) + "SELECT r.memory_id, r.path, r.symbol, r.state FROM ref r JOIN mem m ON m.id = r.memory_id WHERE m.status = 'active'")
def join_ref_memory(spark, folder):
    active = S.memory(spark, folder).filter("status = 'active'").select(F.col("id").alias("memory_id"))
    return S.refs(spark, folder).join(active, "memory_id").select("memory_id", "path", "symbol", "state")


@book.query(with_views(MEM, REF) + "SELECT id FROM mem WHERE id NOT IN (SELECT memory_id FROM ref) AND scope LIKE 'project:%'")
def anti_not_exists_ref(spark, folder):
    have = S.refs(spark, folder).select(F.col("memory_id").alias("id"))
    return S.memory(spark, folder).filter(F.col("scope").startswith("project:")).join(have, "id", "left_anti").select("id")


@book.query(with_views(MEM, PROP) + "SELECT id FROM mem WHERE mem_type = 'episodic' AND id NOT IN (SELECT unnest(member_ids) FROM prop WHERE kind = 'digest')")
def anti_digest_members(spark, folder):
    used = S.proposals(spark, folder).filter("kind = 'digest'").select(F.explode("member_ids").alias("id"))
    return S.memory(spark, folder).filter("mem_type = 'episodic'").join(used, "id", "left_anti").select("id")


@book.query(with_views(MEM, EDGE) + ", act AS (SELECT id FROM mem WHERE status IN ('active', 'superseded')) SELECT src, relation, dst FROM edge WHERE src IN (SELECT id FROM act) AND dst IN (SELECT id FROM act)")
def semi_both_ends(spark, folder):
    ids = S.memory(spark, folder).filter("status in ('active', 'superseded')").select("id")
    e = S.edges(spark, folder)
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "relation", "dst")


@book.query(with_views(MEM, LIVE, PROP) + "SELECT p.proposal_id, coalesce(bool_and(l.id IS NOT NULL), false) is_live, count(*) n_members FROM (SELECT proposal_id, unnest(member_ids) m FROM prop WHERE status = 'pending') p LEFT JOIN live l ON l.id = p.m GROUP BY ALL")
def join_unnest_liveness(spark, folder):
    from lorebase.operators.consolidate import liveness

    return liveness(S.proposals(spark, folder).filter("status = 'pending'"), S.memory(spark, folder))


@book.query(with_views(MEM) + "SELECT m.id, s.n_sessions FROM mem m LEFT JOIN (SELECT session_id, count(DISTINCT session_no) n_sessions FROM sessions GROUP BY ALL) s ON s.session_id = m.source_session WHERE m.mem_type = 'episodic'")
def join_left_queue(spark, folder):
    from lorebase.sources.tables import table

    s = table(spark, folder, "sessions").groupBy("session_id").agg(F.countDistinct("session_no").alias("n_sessions"))
    m = S.memory(spark, folder).filter("mem_type = 'episodic'").select("id", F.col("source_session").alias("session_id"))
    return m.join(s, "session_id", "left").select("id", "n_sessions")


# ---- aggregates


@book.query(with_views(MEM) + "SELECT coalesce(status, 'none') status, count(*) n FROM mem GROUP BY ALL")
def agg_count_status(spark, folder):
    return S.memory(spark, folder).groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


@book.query(with_views(MEM, LIVE) + "SELECT mem_type, count(*) n FROM live GROUP BY ALL")
def agg_count_type_live(spark, folder):
    return R.live_by_type(S.memory(spark, folder))


@book.query(with_views(MEM) + "SELECT scope, count(*) FILTER (WHERE status = 'active') n_active, count(*) FILTER (WHERE status = 'proposed') n_proposed FROM mem GROUP BY ALL")
def agg_count_filter(spark, folder):
    return R.scope_overview(S.memory(spark, folder))


@book.query(with_views(MEM, REF, STALE) + "SELECT count(*) n_stale FROM mem WHERE status = 'active' AND id IN (SELECT id FROM stale)")
def agg_count_stale(spark, folder):
    m = S.memory(spark, folder).filter("status = 'active'")
    return m.join(R.stale_ids(S.refs(spark, folder)), "id", "left_semi").agg(F.count("*").alias("n_stale"))


@book.query(with_views(REF) + "SELECT scope, state, count(*) n FROM ref GROUP BY ALL")
def agg_ref_states(spark, folder):
    return S.refs(spark, folder).groupBy("scope", "state").agg(F.count("*").alias("n"))


@book.query(with_views(REF) + "SELECT scope, path, symbol, coalesce(anchor_commit, '') anchor, count(*) n_refs, epoch_us(CASE WHEN count(*) = count(checked_at) THEN min(checked_at) END) oldest_us FROM ref GROUP BY ALL")
def agg_distinct_targets(spark, folder):
    from lorebase.operators.refs import targets

    return targets(S.refs(spark, folder)).select("scope", "path", "symbol", "anchor", "n_refs", _us("oldest").alias("oldest_us"))


@book.query(with_views(MEM, PROP) + "SELECT p.proposal_id, count(*) FILTER (WHERE m.status = 'active') n_active, epoch_us(min(m.created_at)) first_us, epoch_us(max(m.created_at)) last_us FROM (SELECT proposal_id, unnest(member_ids) id FROM prop) p JOIN mem m USING (id) GROUP BY ALL")
def agg_member_span(spark, folder):
    p = S.proposals(spark, folder).select("proposal_id", F.explode("member_ids").alias("id"))
    by = p.join(S.memory(spark, folder).select("id", "status", "created_at"), "id").groupBy("proposal_id")
    return by.agg(F.count_if(F.col("status") == "active").alias("n_active"), _us(F.min("created_at")).alias("first_us"), _us(F.max("created_at")).alias("last_us"))


@book.query(with_views(MEM, LIVE) + f"SELECT scope, count(*) n FROM live WHERE mem_type = 'episodic' AND coalesce(json_extract_string(attrs, '$.kind'), '') <> 'digest' AND created_at < {AS_OF} - INTERVAL 30 DAY GROUP BY ALL HAVING count(*) >= 6")
def agg_group_having(spark, folder):
    from lorebase.operators.consolidate import digest_candidates

    return digest_candidates(S.memory(spark, folder)).groupBy("scope").agg(F.count("*").alias("n")).filter("n >= 6")


@book.query(with_views(REF) + "SELECT memory_id, min(CASE WHEN state = 'missing' THEN 0.05 WHEN state = 'changed' AND symbol <> '' THEN 0.6 ELSE 1.0 END)::DOUBLE factor FROM ref GROUP BY ALL")
def agg_min_factor(spark, folder):
    from lorebase.operators.search import stale_factors

    return stale_factors(S.refs(spark, folder)).withColumnRenamed("id", "memory_id")


@book.query(with_views(PROP) + "SELECT proposal_id, array_to_string(member_ids, ',') members, len(member_ids)::INT n FROM prop")
def distinct_sorted_array(spark, folder):
    return S.proposals(spark, folder).select("proposal_id", F.array_join("member_ids", ",").alias("members"), F.size("member_ids").alias("n"))


@book.query(with_views(MEM) + "SELECT coalesce(mem_type, 'all') mem_type, count(*) n, round(avg(confidence), 6) mean_confidence FROM mem GROUP BY GROUPING SETS ((mem_type), ())")
def agg_eval_rows(spark, folder):
    m = S.memory(spark, folder)
    by = m.groupingSets([["mem_type"], []], "mem_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return by.withColumn("mem_type", F.coalesce("mem_type", F.lit("all")))


# ---- windows, sorts, limits


@book.query(with_views(MEM) + "SELECT scope, mem_type, id FROM (SELECT *, row_number() OVER (PARTITION BY scope, mem_type ORDER BY created_at DESC, id DESC) rn FROM mem) WHERE rn = 1")
def win_latest_per_key(spark, folder):
    return R.latest_per(S.memory(spark, folder), ["scope", "mem_type"], []).select("scope", "mem_type", "id")


@book.query(with_views(MEM, LIVE) + "SELECT scope, id, rn::INT \"rank\" FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id DESC) rn FROM live WHERE mem_type = 'episodic') WHERE rn <= 3")
def win_topk_per_group(spark, folder):
    m = S.live(S.memory(spark, folder)).filter("mem_type = 'episodic'")
    return R.topk_per(m, ["scope"], [F.desc("created_at"), F.desc("id")], 3).select("scope", "id", "rank")


@book.query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events) WHERE p IS NULL OR p <> event_type")
def win_dedupe_consecutive(spark, folder):
    from lorebase.session import spread_last
    from lorebase.sources.tables import table

    e = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts", F.to_date("ts").alias("day"))
    return spread_last(e, ["user_id"], "day", ["ts", "event_id"], "event_type", "p").filter("p is null or p <> event_type").select("event_id")


@book.query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) b FROM events) WHERE a <= 3 OR b <= 5")
def win_first_last_n(spark, folder):
    from lorebase.sources.tables import table

    e = table(spark, folder, "events")
    first = R.topk_per(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], 3)
    last = R.topk_per(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    return first.select("user_id", "event_id").union(last.select("user_id", "event_id")).distinct()


@book.query("SELECT session_no, project, last_value(project IGNORE NULLS) OVER (PARTITION BY agent ORDER BY started_at, session_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) bound FROM (SELECT DISTINCT session_no, agent, nullif(trim(project), '') project, started_at FROM sessions)")
def win_forward_fill(spark, folder):
    from lorebase.operators.sessions import bind_projects
    from lorebase.sources.tables import table

    return bind_projects(table(spark, folder, "sessions"))


@book.query(
    """WITH s AS (SELECT DISTINCT session_id, session_no, started_at FROM sessions WHERE session_id IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY started_at, session_no) pos FROM s)
SELECT h.session_no hit, o.session_no neighbour, (o.pos - h.pos)::INT AS "offset" FROM n h JOIN n o ON o.session_id = h.session_id AND abs(o.pos - h.pos) <= 1 WHERE h.session_no % 50 = 0"""
)
def win_neighbors_radius(spark, folder):
    from lorebase.operators.sessions import neighbours
    from lorebase.sources.tables import table

    return neighbours(table(spark, folder, "sessions"), F.col("session_no") % 50 == 0, 1)


@book.query(with_views(MEM, LIVE) + "SELECT id FROM live ORDER BY confidence DESC NULLS LAST, created_at DESC, id DESC LIMIT 100")
def topk_score(spark, folder):
    return S.live(S.memory(spark, folder)).orderBy(F.desc_nulls_last("confidence"), F.desc("created_at"), F.desc("id")).limit(100).select("id")


@book.query(with_views(REF) + ", t AS (SELECT scope, path, symbol, coalesce(anchor_commit, '') anchor, CASE WHEN count(*) = count(checked_at) THEN min(checked_at) END oldest FROM ref GROUP BY ALL) SELECT scope, path, symbol, anchor FROM t ORDER BY oldest NULLS FIRST, scope, path, symbol, anchor LIMIT 500")
def sort_nulls_first(spark, folder):
    from lorebase.operators.refs import sync_targets

    return sync_targets(S.refs(spark, folder)).select("scope", "path", "symbol", "anchor")


@book.query(with_views(MEM) + "SELECT id FROM mem WHERE status = 'proposed' ORDER BY created_at, id LIMIT 26 OFFSET 25")
def paginate_offset(spark, folder):
    """Page 2 of 25, one row more to tell whether there is another."""
    return S.memory(spark, folder).filter("status = 'proposed'").orderBy("created_at", "id").offset(25).limit(26).select("id")


@book.query(with_views(MEM) + "SELECT mem_type, (row_number() OVER (ORDER BY CASE mem_type WHEN 'preference' THEN 1 WHEN 'semantic' THEN 2 WHEN 'episodic' THEN 3 WHEN 'project' THEN 4 ELSE 9 END, mem_type))::INT place FROM (SELECT DISTINCT mem_type FROM mem)")
def order_types(spark, folder):
    """Fixed order of types, unknown ones last; the types are few (one row each)."""
    order = F.coalesce(F.array_position(F.array(*(F.lit(t) for t in R.TYPES[:4])), F.col("mem_type")), F.lit(9))
    types = S.memory(spark, folder).groupBy("mem_type").agg(F.lit(0).alias("one"))
    place = F.row_number().over(W.partitionBy("one").orderBy(F.when(order == 0, 9).otherwise(order), "mem_type"))
    return types.select("mem_type", place.alias("place"))


# ---- set operations


@book.query(with_views(PROP) + "SELECT p.proposal_id, m FROM (SELECT proposal_id, keep_id, unnest(member_ids) m FROM prop WHERE kind = 'duplicate' AND keep_id IS NOT NULL) p WHERE m <> p.keep_id")
def except_retired(spark, folder):
    p = S.proposals(spark, folder).filter("kind = 'duplicate' and keep_id is not null")
    return p.select("proposal_id", F.explode(F.array_except("member_ids", F.array("keep_id"))).alias("m"))


@book.query(with_views(PROP) + "SELECT proposal_id, (keep_id IS NOT NULL AND list_contains(member_ids, keep_id)) keep_is_member FROM prop")
def subset_check(spark, folder):
    inside = F.size(F.array_except(F.array("keep_id"), "member_ids")) == 0
    return S.proposals(spark, folder).select("proposal_id", (F.col("keep_id").isNotNull() & inside).alias("keep_is_member"))


@book.query(with_views(EDGE) + "SELECT DISTINCT a, b FROM (SELECT src a, dst b FROM edge UNION SELECT dst, src FROM edge UNION SELECT x.src, y.src FROM edge x JOIN edge y ON x.dst = y.dst AND x.relation = 'derived_from' AND y.relation = 'derived_from' AND x.src <> y.src)")
def union_distinct_adj(spark, folder):
    from lorebase.operators.graph import adjacency

    return adjacency(S.edges(spark, folder)).select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()


@book.query(with_views(MEM, REF) + "SELECT id FROM mem WHERE scope LIKE 'project:%' AND status = 'active' EXCEPT SELECT memory_id FROM ref")
def upsert_ignore(spark, folder):
    """Ids that an insert-or-ignore of references would add."""
    new = S.memory(spark, folder).filter("scope like 'project:%' and status = 'active'").select("id").distinct()
    return new.join(S.refs(spark, folder).select(F.col("memory_id").alias("id")), "id", "left_anti")


QUERIES, ORACLE = book.QUERIES, book.ORACLE
