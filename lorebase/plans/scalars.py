"""Registered queries: functions over texts, times, JSON and hashes, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.functions import coderef, hashing, jsonx, secrets, text, time
from lorebase.plans.book import Book
from lorebase.plans.sqlviews import AS_OF, MEM, PROP, with_views
from lorebase.sources import records as S
from lorebase.sources.tables import table

book = Book()
_B = "[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_B}', ' ', 'g'))"


def content_key_sql(x: str) -> str:
    return f"lower(trim(regexp_replace({_collapse(x)}, '[.!\\x{{3002}}]+$', '')))"


@book.query(f"SELECT line_no, md5({content_key_sql('content')}) k FROM memories WHERE content IS NOT NULL")
def fn_content_key(spark, folder):
    m = table(spark, folder, "memories").filter("content is not null")
    return m.select("line_no", F.md5(text.content_key(F.col("content"))).alias("k"))


@book.query(f"SELECT line_no, {_collapse('content')} c, {_collapse('source_agent')} a FROM memories")
def fn_lower_trim_collapse(spark, folder):
    m = table(spark, folder, "memories")
    return m.select("line_no", text.collapse(F.col("content")).alias("c"), text.collapse(F.col("source_agent")).alias("a"))


@book.query("SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(substr(text, 1, 79)) || '…' ELSE text END t FROM documents")
def fn_truncate_runes(spark, folder):
    return S.documents(spark, folder).select("doc_id", text.truncate(F.col("text"), 80).alias("t"))


@book.query("SELECT line_no, octet_length(encode(content))::INT n FROM memories")
def fn_octet_len(spark, folder):
    return table(spark, folder, "memories").select("line_no", F.octet_length("content").alias("n"))


@book.query("SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 200 THEN text ELSE substr(text, 1, list_max(list_filter(range(0, 201), lambda k: octet_length(encode(substr(text, 1, k))) <= 200))) END t FROM documents")
def fn_clip_bytes(spark, folder):
    return S.documents(spark, folder).select("doc_id", text.clip_bytes(F.col("text"), 200).alias("t"))


@book.query(f"SELECT doc_id, {_collapse(chr(39).join(['list_filter(regexp_split_to_array(text, ', chr(92) + 'r?' + chr(92) + 'n', '), lambda x: trim(x) <> ', '', ')[1]']))} l FROM documents")
def fn_first_line(spark, folder):
    return S.documents(spark, folder).select("doc_id", text.first_line(F.col("text")).alias("l"))


@book.query("SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 2))::INT n FROM documents WHERE text IS NOT NULL")
def fn_tokens_ws(spark, folder):
    return S.documents(spark, folder).filter("text is not null").select("doc_id", F.size(text.word_tokens(F.col("text"))).alias("n"))


@book.query("SELECT line_no, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(trim(source_agent)), '[^a-z0-9._-]+', '-', 'g'), '^[._-]+', ''), 1, 64), ''), 'unknown') a FROM memories")
def fn_sanitize_agent(spark, folder):
    return table(spark, folder, "memories").select("line_no", text.sanitize_agent(F.col("source_agent")).alias("a"))


@book.query(
    r"""WITH r AS (SELECT line_no, unnest(regexp_extract_all(content, '(\S+@\S+:\S+|https?://\S+)', 1)) remote FROM memories), a AS (SELECT *, trim(regexp_replace(remote, '[.,;)]+$', '')) s FROM r),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(s, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '[?#].*$', ''), '^[^@/]*@', '') t FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(t, '^([^/:]+):\d+/', '\1/'), '^([^/:]+):', '\1/') u FROM b),
d AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(u, '/+', '/', 'g'), '/$', ''), '(?i)\.git$', '')) v FROM c)
SELECT line_no, remote, CASE WHEN NOT regexp_matches(s, '^(/|\.|~|file:|[A-Za-z]:[\\/])') AND regexp_matches(v, '^[a-z0-9.-]+\.[a-z0-9-]+/[^/\s]') THEN v END project FROM d"""
)
def fn_normalize_project(spark, folder):
    """Remotes named in contents, normalised."""
    m = table(spark, folder, "memories").select("line_no", F.explode(F.regexp_extract_all("content", F.lit(r"(\S+@\S+:\S+|https?://\S+)"), F.lit(1))).alias("remote"))
    return m.select("line_no", "remote", text.normalize_project(F.regexp_replace("remote", r"[.,;)]+$", "")).alias("project"))


@book.query("SELECT DISTINCT scope, regexp_replace(scope, '^(project|repo):', '') label FROM memories")
def fn_prefix_strip(spark, folder):
    return table(spark, folder, "memories").select("scope", text.scope_label(F.col("scope")).alias("label")).distinct()


@book.query("SELECT line_no, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(content, ',', '', 'g')), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda t: t <> '' AND t NOT IN ('a','an','the','and')), ' ') t FROM memories WHERE content IS NOT NULL")
def fn_normalize_answer(spark, folder):
    m = table(spark, folder, "memories").filter("content is not null")
    return m.select("line_no", F.array_join(text.normalize_answer(F.col("content")), " ").alias("t"))


@book.query("SELECT symbol, regexp_extract(symbol, '^(.*?)(?:::|#|\\.)([^:#.]+)$', 1) qualifier, regexp_extract(symbol, '([^:#.]+)$', 1) AS name, count(*) n FROM memory_refs WHERE symbol <> '' GROUP BY ALL")
def fn_split_symbol(spark, folder):
    r = table(spark, folder, "memory_refs").filter("symbol <> ''").groupBy("symbol").agg(F.count("*").alias("n"))
    s = coderef.split_symbol(F.col("symbol"))
    return r.select("symbol", s["qualifier"].alias("qualifier"), s["name"].alias("name"), "n")


@book.query("SELECT line_no, v FROM (SELECT line_no, unnest(regexp_extract_all(content, '\\d+\\.\\d+\\.\\d+')) v FROM memories) WHERE (string_split(v, '.')[1]::BIGINT, string_split(v, '.')[2]::BIGINT, string_split(v, '.')[3]::BIGINT) > (5, 10, 0)")
def fn_semver_newer(spark, folder):
    """Versions named in contents that are newer than 5.10.0."""
    v = table(spark, folder, "memories").select("line_no", F.explode(F.regexp_extract_all("content", F.lit(r"(\d+\.\d+\.\d+)"), F.lit(1))).alias("v"))
    return v.filter(text.semver(F.col("v")) > F.struct(F.lit(5).alias("major"), F.lit(10).alias("minor"), F.lit(0).alias("patch")))


@book.query(
    "SELECT memory_id, string_agg(n || ' ' || state, ', ' ORDER BY k) s FROM (SELECT memory_id, state, count(*) n, list_position(['pending','current','changed','missing','unresolved'], state) k FROM memory_refs WHERE memory_id IS NOT NULL GROUP BY ALL) GROUP BY ALL"
)
def fn_format_states(spark, folder):
    order = F.array(*(F.lit(s) for s in ("pending", "current", "changed", "missing", "unresolved")))
    r = table(spark, folder, "memory_refs").filter("memory_id is not null").groupBy("memory_id", "state").agg(F.count("*").alias("n"))
    each = F.struct(F.array_position(order, F.col("state")).alias("k"), F.concat_ws(" ", "n", "state").alias("s"))
    return r.groupBy("memory_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["s"]), ", ").alias("s"))


@book.query("SELECT DISTINCT substr(anchor_commit, 1, 12) c FROM memory_refs WHERE anchor_commit IS NOT NULL")
def fn_short_commit(spark, folder):
    return table(spark, folder, "memory_refs").filter("anchor_commit is not null").select(F.substring("anchor_commit", 1, 12).alias("c")).distinct()


# ---- times


@book.query(with_views(MEM) + f"SELECT id, round(pow(2, -greatest((epoch_us({AS_OF}) - epoch_us(created_at)) / 86400000000.0, 0) / 30), 9) f FROM mem WHERE created_at IS NOT NULL")
def dt_half_life(spark, folder):
    m = S.memory(spark, folder).filter("created_at is not null")
    return m.select("id", F.round(time.half_life(time.age_days(F.col("created_at"), S.as_of()), 30.0), 9).alias("f"))


@book.query(with_views(MEM) + f"SELECT id, (expires_at > {AS_OF}) lives FROM mem WHERE expires_at IS NOT NULL")
def dt_expired(spark, folder):
    return S.memory(spark, folder).filter("expires_at is not null").select("id", (F.col("expires_at") > S.as_of()).alias("lives"))


@book.query(
    """SELECT DISTINCT session_no, CASE WHEN strftime(started_at, '%Y-%m-%d') = strftime(ended_at, '%Y-%m-%d') THEN strftime(started_at, '%Y-%m-%d %H:%M') || '-' || strftime(ended_at, '%H:%M')
    ELSE strftime(started_at, '%Y-%m-%d %H:%M') || ' - ' || strftime(ended_at, '%Y-%m-%d %H:%M') END r FROM sessions"""
)
def dt_time_range(spark, folder):
    return table(spark, folder, "sessions").select("session_no", time.time_range(F.col("started_at"), F.col("ended_at")).alias("r")).distinct()


@book.query("SELECT DISTINCT session_no, least(pow(2, least(n_requests, 20) - 1) * 60, 3600)::BIGINT wait FROM sessions WHERE n_requests > 0")
def dt_backoff(spark, folder):
    s = table(spark, folder, "sessions").filter("n_requests > 0")
    return s.select("session_no", time.backoff_seconds(F.col("n_requests")).alias("wait")).distinct()


_EXPRESSIONS = ("yesterday", "tomorrow", "3 days ago", "2 weeks ago", "last week", "next week", "last month", "next month", "last year", "next year", "last monday", "last sunday")


@book.query(
    """WITH d AS (SELECT DISTINCT session_no, started_at::DATE d FROM sessions WHERE started_at IS NOT NULL),
x AS (SELECT session_no, d, unnest(['yesterday','tomorrow','3 days ago','2 weeks ago','last week','next week','last month','next month','last year','next year','last monday','last sunday']) e FROM d)
SELECT session_no, e, strftime(CASE e WHEN 'yesterday' THEN d - 1 WHEN 'tomorrow' THEN d + 1 WHEN '3 days ago' THEN d - 3 WHEN '2 weeks ago' THEN d - 14 WHEN 'last week' THEN date_trunc('week', d)::DATE - 7
  WHEN 'next week' THEN date_trunc('week', d)::DATE + 7 WHEN 'last month' THEN (date_trunc('month', d) - INTERVAL 1 MONTH)::DATE WHEN 'next month' THEN (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE
  WHEN 'last year' THEN (date_trunc('year', d) - INTERVAL 1 YEAR)::DATE WHEN 'next year' THEN (date_trunc('year', d) + INTERVAL 1 YEAR)::DATE
  WHEN 'last monday' THEN CASE WHEN isodow(d) = 1 THEN d - 7 ELSE date_trunc('week', d)::DATE END ELSE CASE WHEN isodow(d) = 7 THEN d - 7 ELSE date_trunc('week', d)::DATE - 1 END END, '%Y-%m-%d') AS "first",
 strftime(CASE e WHEN 'yesterday' THEN d - 1 WHEN 'tomorrow' THEN d + 1 WHEN '3 days ago' THEN d - 3 WHEN '2 weeks ago' THEN d - 14 WHEN 'last week' THEN date_trunc('week', d)::DATE - 1
  WHEN 'next week' THEN date_trunc('week', d)::DATE + 13 WHEN 'last month' THEN date_trunc('month', d)::DATE - 1 WHEN 'next month' THEN (date_trunc('month', d) + INTERVAL 2 MONTH)::DATE - 1
  WHEN 'last year' THEN date_trunc('year', d)::DATE - 1 WHEN 'next year' THEN (date_trunc('year', d) + INTERVAL 2 YEAR)::DATE - 1
  WHEN 'last monday' THEN CASE WHEN isodow(d) = 1 THEN d - 7 ELSE date_trunc('week', d)::DATE END ELSE CASE WHEN isodow(d) = 7 THEN d - 7 ELSE date_trunc('week', d)::DATE - 1 END END, '%Y-%m-%d') AS "last", e = '2 weeks ago' approximate FROM x"""
)
def dt_calendar_meaning(spark, folder):
    """What each relative expression means on the day each session began."""
    s = table(spark, folder, "sessions").filter("started_at is not null").select("session_no", F.to_date("started_at").alias("d")).distinct()
    x = s.select("session_no", "d", F.explode(F.array(*(F.lit(e) for e in _EXPRESSIONS))).alias("e"))
    m = time.calendar_meaning(F.col("e"), F.col("d"))
    return x.select("session_no", "e", F.date_format(m["first"], "yyyy-MM-dd").alias("first"), F.date_format(m["last"], "yyyy-MM-dd").alias("last"), m["approximate"].alias("approximate"))


@book.query()
def dt_calendar_scan(spark, folder):
    """Relative expressions in contents and what they mean."""
    m = S.memory(spark, folder).filter("content is not null and created_at is not null")
    x = m.select("id", F.to_date("created_at").alias("d"), F.explode(time.calendar_expressions(F.col("content"))).alias("e"))
    meaning = time.calendar_meaning(F.col("e"), F.col("d"))
    return x.select("id", "e", F.date_format(meaning["first"], "yyyy-MM-dd").alias("first"), F.date_format(meaning["last"], "yyyy-MM-dd").alias("last"))


# ---- JSON


@book.query("SELECT line_no, json_extract_string(attrs, '$.kind') kind, list_contains(json_keys(attrs), 'branch') has_branch, len(json_keys(attrs))::INT n FROM memories WHERE attrs IS NOT NULL")
def json_get_text(spark, folder):
    keys = F.json_object_keys("attrs")
    m = table(spark, folder, "memories").filter("attrs is not null")
    return m.select("line_no", F.get_json_object("attrs", "$.kind").alias("kind"), F.array_contains(keys, "branch").alias("has_branch"), F.size(keys).alias("n"))


@book.query("SELECT line_no, k, CASE WHEN k = 'by' THEN coalesce(source_agent, '') ELSE json_extract_string(attrs, '$.\"' || k || '\"') END v FROM (SELECT line_no, attrs, source_agent, unnest(list_distinct(list_append(json_keys(attrs), 'by'))) k FROM memories WHERE attrs IS NOT NULL)")
def json_merge(spark, folder):
    """Attributes with ``by`` set to the agent: the right side wins."""
    m = table(spark, folder, "memories").filter("attrs is not null")
    both = jsonx.merge(jsonx.as_map(F.col("attrs")), F.create_map(F.lit("by"), F.coalesce("source_agent", F.lit(""))))
    return m.select("line_no", F.explode(both).alias("k", "v"))


@book.query("SELECT event_id, json_extract(props, '$.k')::BIGINT k FROM events WHERE json_extract(props, '$.k')::BIGINT > 50")
def json_strict_decode(spark, folder):
    p = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    return table(spark, folder, "events").select("event_id", p["k"].alias("k")).filter("k > 50")


@book.query(with_views(PROP) + "SELECT proposal_id, len(member_ids)::INT n, member_ids[1] AS \"first\" FROM prop WHERE len(member_ids) > 0")
def arr_distinct_sort(spark, folder):
    p = S.proposals(spark, folder).filter(F.size("member_ids") > 0)
    return p.select("proposal_id", F.size("member_ids").alias("n"), F.element_at("member_ids", 1).alias("first"))


# ---- hashes


@book.query("SELECT line_no, md5(content) m, substr(sha256(content), 1, 24) s FROM memories WHERE content IS NOT NULL")
def hash_md5_sha(spark, folder):
    m = table(spark, folder, "memories").filter("content is not null")
    return m.select("line_no", F.md5("content").alias("m"), hashing.log_name(F.col("content")).alias("s"))


@book.query("SELECT DISTINCT path, symbol, 'sym:' || substr(sha256(path || chr(0) || trim(regexp_replace(symbol, '\\s+', ' ', 'g')) || chr(0)), 1, 32) h FROM memory_refs WHERE path IS NOT NULL AND symbol IS NOT NULL")
def hash_symbol(spark, folder):
    r = table(spark, folder, "memory_refs").filter("path is not null and symbol is not null")
    return r.select("path", "symbol", hashing.symbol_hash(F.col("path"), F.col("symbol")).alias("h")).distinct()


@book.query()
def hash_fnv_embedder(spark, folder):
    """Vectors of all contents by hashed words."""
    v = hashing.embed(S.memory(spark, folder).select("id", F.col("content").alias("text")))
    return v.select("id", "at", F.round("x", 9).alias("x"))


# ---- code references and secrets


@book.query(
    """SELECT line_no, p FROM (SELECT line_no, unnest(list_distinct(list_slice(list_filter(list_transform(regexp_split_to_array(content, '[^A-Za-z0-9_./#:~@+-]+'),
    lambda t: regexp_replace(regexp_replace(t, '(#L?\\d+.*|:\\d+(:\\d+)?:?)$', ''), '^(\\./)+|[.:,]+$', '', 'g')),
    lambda t: regexp_matches(t, '^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*\\.(go|py|ts|tsx|js|jsx|java|rs|rb|c|h|cc|cpp|cs|kt|swift|php|sql|sh|yaml|yml|toml|json|md|proto|html|css)$')
      AND NOT regexp_matches(t, '(://|\\.\\.|^/|^~|^www\\.|^[A-Za-z0-9-]+\\.(com|org|net|io|dev|example)/)')), 1, 100000))) p FROM memories WHERE content IS NOT NULL)"""
)
def coderef_paths(spark, folder):
    m = table(spark, folder, "memories").filter("content is not null")
    return m.select("line_no", F.explode(coderef.paths(F.col("content"), None)).alias("p"))


@book.query()
def coderef_extract(spark, folder):
    """References of live project records: files first, then symbols."""
    from lorebase.operators.refs import extract_refs

    return extract_refs(S.live(S.memory(spark, folder)))


@book.query()
def coderef_backfill(spark, folder):
    from lorebase.operators.refs import backfill

    return backfill(S.memory(spark, folder), S.refs(spark, folder))


def _redacted(x: str) -> str:
    for name, rule in secrets.RULES:
        ahead = "@" if "(?=@)" in rule else ""  # what a rule only looks ahead to is matched and put back
        x = f"regexp_replace({x}, '{rule.replace(chr(39), chr(39) * 2).replace('(?=@)', '@')}', '\\1[REDACTED:{name}]{ahead}', 'g')"
    return x


@book.query(
    f"""WITH t AS (SELECT 'memories' src_table, concat_ws(chr(10), content, attrs) t FROM memories UNION ALL SELECT 'sessions', coalesce(session, '') FROM sessions)
SELECT src_table, count(*) n_rows, count(*) FILTER (WHERE {_redacted('t')} <> t) n_with_secret, sum(length({_redacted('t')}))::BIGINT n_chars_after FROM t GROUP BY ALL"""
)
def secret_redact(spark, folder):
    """Records and sessions with a secret, and how much of them redaction replaces. The tables hold few or none: the rules are tested on a fixture."""
    a = table(spark, folder, "memories").select(F.lit("memories").alias("src_table"), F.col("line_no").alias("row_no"), F.concat_ws("\n", "content", "attrs").alias("t"))
    b = table(spark, folder, "sessions").select(F.lit("sessions").alias("src_table"), F.col("session_no").alias("row_no"), F.col("session").alias("t"))
    got = a.unionByName(b).withColumn("rules", secrets.findings(F.coalesce("t", F.lit("")))).groupBy("src_table")
    return got.agg(F.count("*").alias("n_rows"), F.count_if(F.size("rules") > 0).alias("n_with_secret"), F.sum(F.length(secrets.redact(F.coalesce("t", F.lit(""))))).alias("n_chars_after"))


QUERIES, ORACLE = book.QUERIES, book.ORACLE
