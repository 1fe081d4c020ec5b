"""Registered queries: search, similarity, graph, state changes, consolidation, context, evaluation, archives and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.functions.similarity import nearest
from lorebase.operators import consolidate, context, evaluation, graph, lifecycle, refs, search, sessions, similar
from lorebase.plans.book import Book
from lorebase.plans.hygiene import JUDGED, cid
from lorebase.plans.scalars import content_key_sql
from lorebase.plans.sqlviews import AS_OF, EDGE, LIVE, MEM, PROP, REF, STALE, with_views
from lorebase.session import Scratch, free_plans
from lorebase.sources import archive
from lorebase.sources import records as S
from lorebase.sources.tables import table
from lorebase.streaming import jobs

book = Book()
#: The test vectors are near random, so the registered queries cut later than the default.
DISTANCE = 0.95


_STORED = ("line_no", "scope", "mem_type", "content", "created_at", "status", "expires_at")


def _store(spark, folder, vectors=True, columns=_STORED):
    """The newest versions, with their vectors if asked for, computed once: every ranker, the fusion and the queries read them from files."""
    m = S.memory(spark, folder, columns).filter((F.col("status") == "active") | (F.col("line_no") % 50 == 0))
    return _kept(spark, m.join(S.vectors(spark, folder), "line_no", "left") if vectors else m.withColumn("vec", F.lit(None).cast("array<float>")))


def _kept(spark, df):
    """Kept, and what was shuffled to make it let go of."""
    kept = Scratch(spark, "store").keep(df)
    free_plans(spark)
    return kept


def _docs_of(store):
    return S.live(store)


def _asked_of(store):
    """Every record whose line number is divisible by 50 asks, with its whole text."""
    return store.filter(F.col("line_no") % 50 == 0).select(F.col("id").alias("query_id"), F.col("content").alias("text"), "scope", "vec")


def _asked(spark, folder):
    return _asked_of(_store(spark, folder))


def _tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


_SEARCH = f"""asked AS (SELECT m.id query_id, content text, scope, embedding vec FROM mem m LEFT JOIN embeddings e ON e.vec_id = m.line_no WHERE line_no % 50 = 0),
docs AS (SELECT l.*, embedding vec FROM live l LEFT JOIN embeddings e ON e.vec_id = l.line_no),
sees AS (SELECT query_id, unnest(list_distinct(['user', coalesce(scope, 'user')])) scope FROM asked),
qt AS (SELECT query_id, len(list_distinct({_tok('text')})) n, unnest(list_distinct({_tok('text')})) t FROM asked),
post AS (SELECT id, scope, t, list_sum(list_transform(range(1, count(*) + 1), lambda j: 1.0::DOUBLE / (j * j))) gain FROM (SELECT id, scope, unnest({_tok('content')}) t FROM docs) GROUP BY ALL),
lexs AS (SELECT query_id, id, round(sum(gain) / any_value(n), 9) lex FROM qt JOIN sees USING (query_id) JOIN post USING (scope, t) WHERE id <> query_id GROUP BY ALL),
vecs AS (SELECT query_id, id, round(1 - list_cosine_similarity(a.vec::DOUBLE[], d.vec::DOUBLE[]), 9) dist FROM asked a JOIN sees s USING (query_id) JOIN docs d ON d.scope = s.scope WHERE a.vec IS NOT NULL AND d.vec IS NOT NULL AND d.id <> query_id)"""


def _ranks(k: int) -> str:
    return f"""lexr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, id DESC) r FROM lexs) WHERE r <= {k}),
vecr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id DESC) r FROM vecs) WHERE r <= {k} AND dist <= {DISTANCE}),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + r)) * 61 / 2, 9) score FROM (SELECT query_id, id, r FROM lexr UNION ALL SELECT query_id, id, r FROM vecr) GROUP BY ALL)"""


def _placed(limit: int) -> str:
    return f"hyb AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id DESC)::INT place FROM fused JOIN docs USING (id)) WHERE place <= {limit})"


@book.query(with_views(MEM, LIVE, _SEARCH, _ranks(50)) + "SELECT query_id, id, lex, r::INT \"rank\" FROM lexr")
def search_lexical(spark, folder):
    store = _store(spark, folder, vectors=False)
    return search.lexical(_asked_of(store), _docs_of(store), search.candidates_per_ranker(10))


@book.query(with_views(MEM, LIVE, _SEARCH, _ranks(50)) + "SELECT query_id, id, dist, r::INT \"rank\" FROM vecr")
def search_vector(spark, folder):
    store = _store(spark, folder)
    return search.vector(_asked_of(store), _docs_of(store), 50, DISTANCE)


@book.query(with_views(MEM, LIVE, _SEARCH, _ranks(50), _placed(10)) + "SELECT * FROM hyb")
def search_hybrid(spark, folder):
    store = _store(spark, folder)
    return search.hybrid(_asked_of(store), _docs_of(store), most=DISTANCE)


_INTENT = search.INTENT.replace("(?i)", "")
_PIPE = f"""{_ranks(120)}, {_placed(30)},
seeds AS (SELECT query_id, id seed, score FROM hyb WHERE place <= 8),
adj AS (SELECT src a, dst b FROM edge UNION ALL SELECT dst, src FROM edge UNION ALL SELECT x.src, y.src FROM edge x JOIN edge y ON x.dst = y.dst AND x.src <> y.src WHERE x.relation = 'derived_from' AND y.relation = 'derived_from'),
reach AS (SELECT query_id, b id, max(score) * 0.5 graph FROM seeds JOIN adj ON a = seed GROUP BY ALL),
seen AS (SELECT r.* FROM reach r JOIN docs d USING (id) JOIN sees s ON s.query_id = r.query_id AND s.scope = d.scope WHERE id <> r.query_id),
pool AS (SELECT query_id, id, coalesce(h.score, 0) f, coalesce(s.graph, 0) g FROM hyb h FULL JOIN seen s USING (query_id, id)),
pre AS (SELECT p.query_id, p.id, d.mem_type, d.content, d.created_at, a.text, round(CASE WHEN f > 0 THEN f + 0.1 * g ELSE g END, 9) s0 FROM pool p JOIN docs d USING (id) JOIN asked a USING (query_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s0 DESC, created_at DESC, id DESC) <= 15 reranked FROM pre),
rer AS (SELECT *, CASE WHEN NOT reranked THEN s0 WHEN len(list_distinct({_tok('text')})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({_tok('text')}), {_tok('content')}))::DOUBLE / len(list_distinct({_tok('text')})) END s1 FROM top),
fac AS (SELECT memory_id id, min(CASE WHEN state = 'missing' THEN 0.05 WHEN state = 'changed' AND symbol <> '' THEN 0.6 ELSE 1.0 END)::DOUBLE factor FROM ref GROUP BY ALL),
fin AS (SELECT r.query_id, r.id, r.reranked, r.created_at, round(least(greatest(s1 * coalesce(factor, 1.0) * CASE WHEN regexp_matches(coalesce(text, ''), '{_INTENT}', 'i') THEN pow(2.0, -age / 7)
  WHEN mem_type = 'episodic' AND reranked THEN 1 - 0.4 * (1 - pow(2.0, -age / 30)) ELSE 1.0 END, 1e-6), 1.0), 6) score
  FROM (SELECT *, greatest((epoch_us({AS_OF}) - epoch_us(created_at)) / 86400000000.0, 0) age FROM rer) r LEFT JOIN fac USING (id))"""


@book.query(with_views(MEM, LIVE, EDGE, REF, _SEARCH, _PIPE) + "SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, score DESC, created_at DESC, id DESC)::INT place, reranked FROM fin) WHERE place <= 10")
def retrieve_pipeline(spark, folder):
    store = _store(spark, folder)
    return search.pipeline(spark, _asked_of(store), _docs_of(store), S.edges(spark, folder), S.refs(spark, folder, ("state",)), most=DISTANCE)


@book.query(with_views(MEM, LIVE, _SEARCH, _ranks(50)) + f"SELECT query_id, regexp_matches(coalesce(text, ''), '{_INTENT}', 'i') intent FROM asked")
def temporal_intent(spark, folder):
    return _asked(spark, folder).select("query_id", search.temporal_intent(F.col("text")).alias("intent"))


# configurations of the pipeline; no_rerank is the hybrid search with its signals
_OFF = {"graph": False, "use_recency": False, "use_stale": False}
CONFIGURATIONS = {
    "full": {},
    "no_graph": {"graph": False},
    "no_recency": {"use_recency": False},
    "no_stale": {"use_stale": False},
    "no_rerank": {"rerank": False},
    "lexical": {"vectors": False, "rerank": False, **_OFF},
    "lexical_signals": {"vectors": False, "rerank": False},
    "hybrid": {"rerank": False, **_OFF},
    "hybrid_rerank": _OFF,
}
_REL = "rel AS (SELECT DISTINCT query_id, id FROM (SELECT src query_id, dst id FROM edge UNION SELECT dst, src FROM edge) WHERE query_id IN (SELECT query_id FROM asked) AND id IN (SELECT id FROM live))"


def _configured(name: str, rerank: bool = True, graph: bool = True, use_recency: bool = True, use_stale: bool = True, vectors: bool = True) -> str:
    """The metrics of one configuration: the stages of the pipeline with some of them emptied."""
    stages = _PIPE
    for on, stage, without in (
        (vectors, "* 61 / 2, 9) score FROM (SELECT query_id, id, r FROM lexr UNION ALL SELECT query_id, id, r FROM vecr)", "* 61, 9) score FROM lexr"),
        (rerank and graph, "WHERE id <> r.query_id)", "WHERE false)"),
        (rerank, "<= 15 reranked", "< 0 reranked"),
        (use_stale, "s1 * coalesce(factor, 1.0) *", "s1 *"),
        (use_recency, "* CASE WHEN regexp_matches", "* CASE WHEN true THEN 1.0 WHEN regexp_matches"),
    ):
        if stage not in stages:
            raise ValueError(stage)
        stages = stages if on else stages.replace(stage, without)
    return f"""SELECT '{name}' config, count(*) n, round(avg(recall5), 6) recall5, round(avg(hit5), 6) hit5, round(avg(rr10), 6) mrr10 FROM (WITH {stages},
ranked AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, score DESC, created_at DESC, id DESC) place FROM fin) WHERE place <= 10)
SELECT query_id, round(count(*) FILTER (WHERE place <= 5)::DOUBLE / least(count(*), 5), 6) recall5, (count(*) FILTER (WHERE place <= 5) > 0)::INT hit5,
  round(CASE WHEN min(place) <= 10 THEN 1.0::DOUBLE / min(place) ELSE 0 END, 6) rr10 FROM rel LEFT JOIN ranked USING (query_id, id) GROUP BY ALL)"""


@book.query(with_views(MEM, LIVE, EDGE, REF, _SEARCH, _REL) + " UNION ALL ".join(_configured(name, **options) for name, options in CONFIGURATIONS.items()))
def eval_ablation(spark, folder):
    """Metrics of pipeline configurations: the records an edge links to the asking one are relevant."""
    store = _store(spark, folder)
    ranked = search.ablation(spark, _asked_of(store), _docs_of(store), S.edges(spark, folder), S.refs(spark, folder), CONFIGURATIONS, most=DISTANCE)
    configs = spark.range(1).select(F.explode(F.array(*map(F.lit, CONFIGURATIONS))).alias("config"))
    # a question of a configuration is a query of its own; nine rows are broadcast
    one = F.struct("config", "query_id").alias("query_id")
    rel = _relevant(spark, folder, store).crossJoin(F.broadcast(configs)).select(one, "id")
    metrics = evaluation.ranking_metrics(ranked.select(one, "id", "place"), rel).withColumn("config", F.col("query_id.config"))
    got = configs.join(evaluation.summary(metrics, "config"), "config", "left")
    return got.select("config", F.coalesce("n", F.lit(0)).alias("n"), "recall5", "hit5", "mrr10")


def _relevant(spark, folder, store):
    e = S.edges(spark, folder)
    both = e.select(F.col("src").alias("query_id"), F.col("dst").alias("id")).unionByName(e.select(F.col("dst").alias("query_id"), F.col("src").alias("id")))
    return both.join(_asked_of(store).select("query_id"), "query_id", "left_semi").distinct().join(_docs_of(store).select("id"), "id", "left_semi")


@book.query(
    with_views(MEM, LIVE, EDGE, _SEARCH, _ranks(50), _placed(10), _REL)
    + """SELECT query_id, round(count(*) FILTER (WHERE place <= 5) / least(count(*), 5), 6) recall5, (count(*) FILTER (WHERE place <= 5) > 0)::INT hit5,
    round(CASE WHEN min(place) <= 10 THEN 1.0 / min(place) ELSE 0 END, 6)::DOUBLE rr10 FROM rel LEFT JOIN hyb USING (query_id, id) GROUP BY ALL"""
)
def eval_recall_hit_mrr(spark, folder):
    store = _store(spark, folder)
    hits = _kept(spark, search.hybrid(_asked_of(store), _docs_of(store), most=DISTANCE))
    return evaluation.ranking_metrics(hits, _relevant(spark, folder, store))


@book.query(
    with_views(MEM, LIVE, EDGE, _SEARCH, _ranks(50), _REL)
    + "SELECT query_id, round(count(r) / count(*)::DOUBLE, 6) recall FROM rel LEFT JOIN lexr USING (query_id, id) GROUP BY ALL"
)
def evidence_recall(spark, folder):
    """Recall of the lexical pool."""
    store = _store(spark, folder, vectors=False)
    got = _kept(spark, search.lexical(_asked_of(store), _docs_of(store), 50).select("query_id", F.col("id").alias("item")))
    return evaluation.evidence_recall(got, _relevant(spark, folder, store).select("query_id", F.col("id").alias("item")))


_NORM = "list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace({x}, ',', '', 'g')), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda t: t <> '' AND t NOT IN ('a','an','the','and'))"


@book.query(
    with_views(MEM)
    + f""", pr AS (SELECT a.id, a.content x, b.content y FROM mem a JOIN mem b ON b.id = a.supersedes WHERE a.content IS NOT NULL AND b.content IS NOT NULL),
xs AS (SELECT id, t, count(*) g FROM (SELECT id, unnest({_NORM.format(x='y')}) t FROM pr) GROUP BY ALL), ys AS (SELECT id, t, count(*) p FROM (SELECT id, unnest({_NORM.format(x='x')}) t FROM pr) GROUP BY ALL)
SELECT id, round(CASE WHEN sum(coalesce(CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN least(g, p) END, 0)) > 0 THEN 2.0 * sum(coalesce(CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN least(g, p) END, 0)) / (sum(coalesce(g, 0)) + sum(coalesce(p, 0))) ELSE 0 END, 6)::DOUBLE f1 FROM xs FULL JOIN ys USING (id, t) GROUP BY ALL"""
)
def token_f1(spark, folder):
    """F1 of each record's tokens against those of the one it supersedes."""
    m = S.memory(spark, folder).filter("content is not null")
    old = m.select(F.col("id").alias("supersedes"), F.col("content").alias("gold"))
    return evaluation.token_f1(m.join(old, "supersedes"), "id", F.col("gold"), F.col("content"))


@book.query(
    with_views(MEM)
    + """, n AS (SELECT mem_type, count(*) n FROM mem GROUP BY ALL), x AS (SELECT *, n * 60 / (sum(n) OVER ())::DOUBLE x FROM n),
b AS (SELECT *, floor(x) base, 60 - sum(floor(x)) OVER () rest FROM x), q AS (SELECT mem_type, least(n, base + CASE WHEN row_number() OVER (ORDER BY round(x - base, 9) DESC, mem_type) <= rest THEN 1 ELSE 0 END) quota FROM b)
SELECT mem_type, id FROM (SELECT mem_type, id, row_number() OVER (PARTITION BY mem_type ORDER BY id) r FROM mem) JOIN q USING (mem_type) WHERE r <= quota"""
)
def stratified_subset(spark, folder):
    return evaluation.stratified(S.memory(spark, folder), "mem_type", "id", 60)


@book.query(
    """WITH j AS (SELECT least(a, b) a, greatest(a, b) b, r FROM (SELECT """
    + f"""{cid('a_id')} a, {cid('b_id')} b, lower(trim(relation)) r FROM match_pairs) WHERE a <> b AND r IS NOT NULL)
SELECT a, b, CASE WHEN min(r) = max(r) THEN min(r) ELSE 'unclear' END verdict, count(*) n FROM j GROUP BY a, b"""
)
def judge_pair(spark, folder):
    return consolidate.judge(table(spark, folder, "match_pairs"))


@book.query(
    with_views(PROP)
    + f""", w AS (SELECT DISTINCT member_ids[1] a, member_ids[2] b, CASE kind WHEN 'duplicate' THEN 'same' WHEN 'conflict' THEN 'conflict' WHEN 'distinct' THEN 'distinct' END want FROM prop WHERE len(member_ids) = 2 AND kind IN ('duplicate', 'conflict', 'distinct')),
j AS (SELECT least(a, b) a, greatest(a, b) b, r FROM (SELECT {cid('a_id')} a, {cid('b_id')} b, lower(trim(relation)) r FROM match_pairs) WHERE a <> b AND r IS NOT NULL),
v AS (SELECT a, b, CASE WHEN min(r) = max(r) THEN min(r) ELSE 'unclear' END verdict FROM j GROUP BY a, b)
SELECT CASE WHEN verdict = want THEN 'correct' WHEN verdict IN ('same', 'conflict') AND want = 'distinct' THEN 'false_retire' ELSE 'missed' END outcome, count(*) n FROM w LEFT JOIN v USING (a, b) GROUP BY ALL"""
)
def eval_pair_confusion(spark, folder):
    """Judged pairs against the open and applied proposals of two members."""
    p = S.proposals(spark, folder).filter(F.size("member_ids") == 2)
    want = F.when(F.col("kind") == "duplicate", "same").when(F.col("kind") == "conflict", "conflict").when(F.col("kind") == "distinct", "distinct")
    wanted = p.select(F.element_at("member_ids", 1).alias("a"), F.element_at("member_ids", 2).alias("b"), want.alias("want")).filter("want is not null").distinct()
    return evaluation.pair_confusion(consolidate.judge(table(spark, folder, "match_pairs")).select("a", "b", "verdict"), wanted)


# ---- duplicates and similarity

_KEYED = f"keyed AS (SELECT *, {content_key_sql('content')} key FROM mem WHERE content IS NOT NULL AND {content_key_sql('content')} <> '')"


@book.query(with_views(MEM, _KEYED) + "SELECT id, min(id) OVER w class_id, count(*) OVER w n_copies FROM keyed WINDOW w AS (PARTITION BY scope, key)")
def content_key_classes(spark, folder):
    return similar.duplicate_classes(S.memory(spark, folder))


@book.query(
    with_views(MEM, _KEYED)
    + f"SELECT a.id new_id, arg_max(b.id, (b.created_at, b.id)) id FROM keyed a JOIN keyed b ON a.scope = b.scope AND a.key = b.key AND a.id <> b.id WHERE b.status IN ('active', 'proposed') AND (b.expires_at IS NULL OR b.expires_at > {AS_OF}) GROUP BY ALL"
)
def find_duplicate(spark, folder):
    m = S.memory(spark, folder)
    return similar.find_duplicate(m, m)


@book.query(with_views(MEM, _KEYED) + "SELECT a.id new_id, arg_max(b.id, (b.created_at, b.id)) id FROM keyed a JOIN keyed b ON a.scope = b.scope AND a.key = b.key AND a.id <> b.id GROUP BY ALL")
def seen_content(spark, folder):
    m = S.memory(spark, folder)
    return similar.find_duplicate(m, m, any_status=True)


@book.query(
    with_views(MEM, _KEYED)
    + """, n AS (SELECT * FROM keyed WHERE status = 'proposed') SELECT id new_id, CASE WHEN EXISTS (SELECT 1 FROM keyed s WHERE s.status = 'active' AND s.scope = n.scope AND s.key = n.key) THEN 'duplicate'
    WHEN id <> min(id) OVER (PARTITION BY scope, key) THEN 'repeated' ELSE 'created' END outcome FROM n"""
)
def create_if_absent(spark, folder):
    """Proposed records as a batch of new ones against the active store."""
    m = S.memory(spark, folder)
    return similar.create_if_absent(m.filter("status = 'active'"), m.filter("status = 'proposed'"))


_GRAMS = "list_distinct(flatten(list_transform(list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@book.query(
    with_views(MEM, LIVE)
    + f""", s AS (SELECT id seed, scope, {_GRAMS.format(x='content')} g, embedding v FROM mem LEFT JOIN embeddings ON vec_id = line_no WHERE line_no % 50 = 0),
r AS (SELECT id, scope, {_GRAMS.format(x='content')} h, embedding u FROM live LEFT JOIN embeddings ON vec_id = line_no WHERE mem_type <> 'temporary'),
j AS (SELECT seed, id, len(list_intersect(g, h)) c, len(g) a, len(h) b, v, u FROM s JOIN r USING (scope) WHERE id <> seed),
k AS (SELECT seed, id, CASE WHEN a > 0 AND b > 0 THEN c::DOUBLE / (a + b - c) END t, CASE WHEN v IS NOT NULL AND u IS NOT NULL THEN list_cosine_similarity(v::DOUBLE[], u::DOUBLE[]) END w FROM j),
x AS (SELECT seed, id, round(greatest(CASE WHEN t >= 0.5 THEN t END, CASE WHEN w >= 0.3 THEN w END), 9) sim FROM k)
SELECT * FROM (SELECT seed, id, sim, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, id DESC)::INT place FROM x WHERE sim IS NOT NULL) WHERE place <= 3"""
)
def similar_to(spark, folder):
    m = S.memory(spark, folder).join(S.vectors(spark, folder), "line_no", "left")
    return similar.similar_to(m, m.filter(F.col("line_no") % 50 == 0), least_cosine=0.3)


_VECTORS = """vecs AS (SELECT l.id, l.scope, l.mem_type, embedding::DOUBLE[] v FROM live l JOIN embeddings ON vec_id = line_no),
vnear AS (SELECT * FROM (SELECT x.id, y.id b, round(list_cosine_similarity(x.v, y.v), 9) sim FROM vecs x JOIN vecs y ON x.scope IS NOT DISTINCT FROM y.scope AND x.mem_type IS NOT DISTINCT FROM y.mem_type AND x.id <> y.id
  WHERE x.mem_type IS NULL OR x.mem_type NOT IN ({types})) WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, b DESC) <= 3)"""


@book.query(with_views(MEM, LIVE, _VECTORS.format(types="''")) + "SELECT id, b, sim, (row_number() OVER (PARTITION BY id ORDER BY sim DESC, b DESC))::INT place FROM vnear")
def join_lateral_topk(spark, folder):
    """The three nearest of each live record in its scope and type."""
    m = S.live(S.memory(spark, folder)).join(S.vectors(spark, folder), "line_no")
    return nearest(m.select("id", F.struct("scope", "mem_type").alias("block"), "vec"), 0.3, 3)


@book.query(
    with_views(MEM, LIVE, PROP, _VECTORS.format(types="'episodic', 'temporary'"))
    + f""", rws AS (SELECT id, scope, mem_type, content, lower(trim(regexp_replace(content, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) p FROM live WHERE mem_type NOT IN ('episodic', 'temporary')),
cls AS (SELECT scope, mem_type, p, min(id) rep, {_GRAMS.format(x='p')} g FROM rws WHERE p <> '' GROUP BY scope, mem_type, p),
prs AS (SELECT x.rep a, y.rep b, len(list_intersect(x.g, y.g)) c, len(x.g) n, len(y.g) m FROM cls x JOIN cls y ON x.scope IS NOT DISTINCT FROM y.scope AND x.mem_type IS NOT DISTINCT FROM y.mem_type AND x.rep < y.rep AND least(len(x.g), len(y.g)) >= 0.5 * greatest(len(x.g), len(y.g)) - 1e-9),
alls AS (SELECT a, b, round(c::DOUBLE / (n + m - c), 9) sim FROM prs WHERE round(c::DOUBLE / (n + m - c), 9) >= 0.5 UNION ALL SELECT rep, id, 1.0 FROM rws JOIN cls USING (scope, mem_type, p) WHERE id <> rep),
grm AS (SELECT id, {_GRAMS.format(x='content')} g FROM rws),
vpr AS (SELECT a, b, sim, CASE WHEN len(x.g) > 0 AND len(y.g) > 0 THEN round(len(list_intersect(x.g, y.g))::DOUBLE / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 9) END t FROM (SELECT DISTINCT least(id, b) a, greatest(id, b) b, sim FROM vnear) JOIN grm x ON x.id = a JOIN grm y ON y.id = b),
un AS (SELECT a, b, max(sim) sim FROM (SELECT * FROM alls UNION ALL SELECT a, b, greatest(sim, CASE WHEN t >= 0.5 THEN t END) FROM vpr) GROUP BY a, b),
wait AS (SELECT unnest(member_ids) i FROM prop WHERE status = 'pending')
SELECT a, b, sim::DOUBLE sim FROM un WHERE NOT EXISTS (SELECT 1 FROM prop WHERE len(member_ids) = 2 AND member_ids[1] = a AND member_ids[2] = b) AND a NOT IN (SELECT i FROM wait) AND b NOT IN (SELECT i FROM wait)"""
)
def consolidation_pairs(spark, folder):
    """The test vectors are near random, so similarity by vector counts from 0.3 here."""
    m = _kept(spark, S.live(S.memory(spark, folder, ("line_no", "mem_type", "scope", "content", "status", "expires_at"))))
    return consolidate.candidate_pairs(Scratch(spark, "pairs"), m, m.join(S.vectors(spark, folder), "line_no").select("id", "vec"), S.proposals(spark, folder), least_cosine=0.3)


# ---- graph


@book.query(
    with_views(MEM, LIVE, EDGE)
    + """, adj AS (SELECT src a, dst b, relation, 'out' via FROM edge UNION SELECT dst, src, relation, 'in' FROM edge UNION SELECT x.src, y.src, 'derived_from', 'sibling' FROM edge x JOIN edge y ON x.dst = y.dst AND x.src <> y.src WHERE x.relation = 'derived_from' AND y.relation = 'derived_from')
SELECT s.id, l.id other, relation, via FROM mem s JOIN adj ON a = s.id JOIN live l ON l.id = b WHERE s.line_no % 50 = 0 AND (l.scope = 'user' OR l.scope = s.scope)"""
)
def neighbors(spark, folder):
    m = S.memory(spark, folder)
    return graph.neighbours(S.live(m), S.edges(spark, folder), m.filter(F.col("line_no") % 50 == 0)).select("id", "other", "relation", "via")


@book.query(
    with_views(
        MEM,
        """old AS (SELECT id seed, id, 0 depth FROM mem WHERE line_no % 50 = 0 UNION ALL SELECT o.seed, m.supersedes, o.depth - 1 FROM old o JOIN mem m ON m.id = o.id WHERE m.supersedes IN (SELECT id FROM mem) AND o.depth > -50)""",
        """new AS (SELECT id seed, id, 0 depth FROM mem WHERE line_no % 50 = 0 UNION ALL SELECT n.seed, m.id, n.depth + 1 FROM new n JOIN mem m ON m.supersedes = n.id WHERE n.depth < 50)""",
        recursive=True,
    )
    + "SELECT seed, id, arg_min(depth, abs(depth) * 2 + (depth > 0)::INT)::INT depth FROM (SELECT * FROM old UNION SELECT * FROM new) GROUP BY seed, id"
)
def history_chain(spark, folder):
    m = S.memory(spark, folder)
    return graph.history(spark, m, m.filter(F.col("line_no") % 50 == 0))


# ---- state changes


@book.query(with_views(MEM) + "SELECT DISTINCT t.id, 'active' old_status, 'superseded' new_status FROM mem n JOIN mem t ON t.id = n.supersedes WHERE n.status = 'active' AND t.status = 'active' AND t.scope = n.scope AND t.id <> n.id")
def state_create(spark, folder):
    m = S.memory(spark, folder)
    return lifecycle.supersede(m, m.filter("supersedes is not null").select("id", "supersedes"))


@book.query(
    with_views(MEM)
    + ", a AS (SELECT * FROM mem WHERE status = 'proposed' AND line_no % 50 = 0) SELECT id, 'proposed' old_status, 'active' new_status, 'user' new_trust FROM a UNION ALL SELECT id, 'active', 'superseded', trust FROM mem WHERE status = 'active' AND id IN (SELECT supersedes FROM a)"
)
def state_approve(spark, folder):
    m = S.memory(spark, folder)
    return lifecycle.approve(m, m.filter(F.col("line_no") % 50 == 0))


@book.query(with_views(MEM) + "SELECT id, 'proposed' old_status, 'deleted' new_status FROM mem WHERE status = 'proposed' AND confidence < 0.5")
def state_reject(spark, folder):
    m = S.memory(spark, folder)
    return lifecycle.reject(m, m.filter("confidence < 0.5"))


@book.query(
    with_views(MEM)
    + """, d AS (SELECT id, attrs, trust, coalesce(source_agent, '') agent FROM mem WHERE status = 'superseded'),
k AS (SELECT *, unnest(list_distinct(list_concat(coalesce(json_keys(attrs), []), ['forgotten_by'], CASE WHEN trust = 'external' THEN ['reason'] ELSE [] END))) k FROM d),
kv AS (SELECT id, k, CASE WHEN k = 'forgotten_by' THEN agent WHEN k = 'reason' AND trust = 'external' THEN 'untrusted' ELSE json_extract_string(attrs, '$."' || k || '"') END v FROM k)
SELECT id, '{' || string_agg(to_json(k)::VARCHAR || ':' || coalesce(to_json(v)::VARCHAR, 'null'), ',' ORDER BY k) || '}' attrs FROM kv GROUP BY id"""
)
def state_soft_delete(spark, folder):
    m = S.memory(spark, folder)
    reason = F.when(F.col("trust") == "external", F.lit("untrusted"))
    return lifecycle.soft_delete(m, m.filter("status = 'superseded'").select("id", F.coalesce("source_agent", F.lit("")).alias("by"), reason.alias("reason")))


@book.query(with_views(MEM, LIVE) + "SELECT scope, arg_max(id, (created_at, id)) id FROM live WHERE json_extract_string(attrs, '$.kind') = 'handoff' GROUP BY scope")
def latest_handoff(spark, folder):
    return lifecycle.latest_handoff(S.memory(spark, folder), unresumed=True)


@book.query(with_views(MEM, LIVE) + "SELECT scope, id, id = arg_max(id, (created_at, id)) OVER (PARTITION BY scope) is_predecessor FROM live WHERE json_extract_string(attrs, '$.kind') = 'handoff'")
def create_handoff(spark, folder):
    m = S.memory(spark, folder)
    return lifecycle.create_handoff(m, m.select("scope").distinct())


@book.query(with_views(MEM) + "SELECT scope, mem_type, source_agent, source_session, arg_max(id, (created_at, id)) id FROM mem WHERE status = 'active' AND source_session IS NOT NULL GROUP BY ALL")
def find_session_memory(spark, folder):
    return lifecycle.find_session_memory(S.memory(spark, folder))


@book.query(with_views(MEM, LIVE) + "SELECT id FROM live WHERE line_no NOT IN (SELECT vec_id FROM embeddings)")
def backfill_embed(spark, folder):
    return lifecycle.to_embed(S.memory(spark, folder), S.vectors(spark, folder))


_EV = """SELECT event_id job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'pending' ELSE 'done' END status, json_extract(props, '$.k')::INT % 7 attempts, ts created_at,
  ts + INTERVAL 600 SECOND locked_until, ts + INTERVAL 60 SECOND next_attempt_at, TIMESTAMP '2024-01-15 00:00:00' now FROM events"""


@book.query(f"SELECT job_id, (attempts + 1)::INT attempts FROM ({_EV}) WHERE (status = 'pending' OR (status = 'failed' AND next_attempt_at <= now) OR (status = 'running' AND locked_until < now)) AND attempts < 5 ORDER BY created_at, job_id LIMIT 100")
def claim_extraction(spark, folder):
    """The next hundred jobs of a queue made of events."""
    e = table(spark, folder, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "signup", "pending").otherwise("done")
    ts = F.col("ts")
    j = e.select(
        F.col("event_id").alias("job_id"), status.alias("status"), (F.get_json_object("props", "$.k").cast("int") % 7).alias("attempts"), ts.alias("created_at"),
        (ts + F.expr("INTERVAL 600 SECONDS")).alias("locked_until"), (ts + F.expr("INTERVAL 60 SECONDS")).alias("next_attempt_at"), F.lit("2024-01-15 00:00:00").cast("timestamp").alias("now"),
    )
    return lifecycle.claim(j, 100).select("job_id", "attempts")


# ---- references


@book.query(
    with_views(REF)
    + """, c AS (SELECT path, symbol, (abs(hash) % 4 <> 0) AS found, anchor FROM (SELECT path, symbol, max(line_no) AS hash, max(anchor_hash) anchor FROM ref GROUP BY ALL)),
j AS (SELECT r.*, c.found, c.anchor hash FROM ref r JOIN c USING (path, symbol)),
k AS (SELECT state, anchor_hash, hash, found, CASE WHEN anchor_hash IS NULL AND found THEN 'current' WHEN anchor_hash IS NULL THEN 'unresolved' WHEN NOT found THEN 'missing' WHEN hash = anchor_hash THEN 'current' ELSE 'changed' END next_state FROM j)
SELECT state, next_state, count(*) n, count(*) FILTER (WHERE anchor_hash IS NULL AND found AND hash IS NOT NULL) n_anchored FROM k GROUP BY ALL"""
)
def apply_ref_checks(spark, folder):
    """Checks whose outcome comes from the table itself: three of four targets are found, with the largest anchor any reference to them has."""
    r = S.refs(spark, folder)
    c = r.groupBy("path", "symbol").agg(F.max("line_no").alias("l"), F.max("anchor_hash").alias("hash"))
    return refs.check_tally(refs.apply_checks(r, c.select("path", "symbol", (F.col("l") % 4 != 0).alias("found"), "hash")))


@book.query(with_views(MEM, REF, STALE) + "SELECT memory_id id, string_agg(path || '#' || symbol, ',' ORDER BY path, symbol) refs, bool_or(memory_id IN (SELECT id FROM stale)) stale FROM ref WHERE state <> 'unresolved' AND memory_id IN (SELECT id FROM mem) GROUP BY ALL")
def attach_refs(spark, folder):
    """A record's references, which are few (a table of at most 16 a record), as text."""
    from lorebase.operators.records import stale_ids

    r = S.refs(spark, folder)
    shown = r.filter("state <> 'unresolved'").join(S.memory(spark, folder).select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "symbol"))), lambda x: F.concat(x["path"], F.lit("#"), x["symbol"])), ",")
    stale = stale_ids(r).withColumn("stale", F.lit(True))
    return shown.groupBy(F.col("memory_id").alias("id")).agg(text.alias("refs")).join(stale, "id", "left").select("id", "refs", F.coalesce("stale", F.lit(False)).alias("stale"))


# ---- consolidation


@book.query(
    with_views(MEM, LIVE, PROP)
    + f""", free AS (SELECT * FROM live WHERE mem_type = 'episodic' AND coalesce(json_extract_string(attrs, '$.kind'), '') <> 'digest' AND created_at < {AS_OF} - INTERVAL 30 DAY AND id NOT IN (SELECT unnest(member_ids) FROM prop WHERE kind = 'digest'))
SELECT scope, id, place::INT place FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY created_at, id) place, count(*) OVER (PARTITION BY scope) n FROM free) WHERE n >= 6 AND place <= 10"""
)
def digest_groups(spark, folder):
    return consolidate.digest_groups(S.memory(spark, folder), S.proposals(spark, folder))


@book.query(
    with_views(MEM, LIVE, PROP)
    + """, e AS (SELECT proposal_id, kind, keep_id, unnest(member_ids) id FROM prop WHERE status = 'pending'), v AS (SELECT proposal_id, bool_and(id IN (SELECT id FROM live)) ok FROM e GROUP BY ALL)
SELECT proposal_id, id, CASE WHEN NOT ok THEN 'stale' WHEN kind = 'digest' THEN 'superseded_by_digest' WHEN keep_id IS NULL THEN 'undecided' WHEN keep_id = id THEN 'kept' ELSE 'superseded' END AS "change" FROM e JOIN v USING (proposal_id)"""
)
def apply_proposal(spark, folder):
    return consolidate.apply_decisions(S.memory(spark, folder), S.proposals(spark, folder))


@book.query(with_views(MEM, LIVE, PROP) + "SELECT DISTINCT proposal_id FROM (SELECT proposal_id, unnest(member_ids) i FROM prop WHERE status = 'pending') WHERE i NOT IN (SELECT id FROM live)")
def mark_stale_proposals(spark, folder):
    p = S.proposals(spark, folder).filter("status = 'pending'")
    return consolidate.liveness(p, S.memory(spark, folder)).filter("not is_live").select("proposal_id")


# ---- context and sessions


@book.query(with_views(MEM) + "SELECT id, ((octet_length(encode(coalesce(content, ''))) + octet_length(encode(coalesce(scope, '')))) // 3 + 40)::INT n FROM mem")
def token_estimate(spark, folder):
    return S.memory(spark, folder).select("id", context.token_estimate(F.col("content"), F.col("scope")).alias("n"))


_FIRST = "row_number() OVER (PARTITION BY {by} ORDER BY {first}created_at DESC NULLS LAST, id DESC)"


@book.query(
    with_views(
        MEM,
        LIVE,
        REF,
        STALE,
        "scopes AS (SELECT DISTINCT scope FROM live WHERE starts_with(scope, 'project:'))",
        f"""secs AS (SELECT scope, id, content, own, 1000 + n ord FROM (SELECT *, {_FIRST.format(by='scope', first='')} n FROM (SELECT s.scope, id, content, l.scope own, created_at FROM scopes s JOIN live l ON l.scope IN ('user', s.scope) WHERE mem_type = 'preference')) WHERE n <= 50
  UNION ALL SELECT scope, id, content, scope, 2001 FROM (SELECT *, {_FIRST.format(by='scope', first='')} n FROM live WHERE json_extract_string(attrs, '$.kind') = 'handoff' AND json_extract_string(attrs, '$.resumed_at') IS NULL) WHERE n = 1
  UNION ALL SELECT scope, id, substr(content, 1, 800), scope, 3000 + n FROM (SELECT *, {_FIRST.format(by='scope', first='')} n FROM live WHERE mem_type = 'episodic') WHERE n <= 3
  UNION ALL SELECT scope, id, content, scope, 4000 + n FROM (SELECT *, {_FIRST.format(by='scope', first='id IN (SELECT id FROM stale), ')} n FROM live WHERE mem_type IN ('project', 'codebase', 'semantic')) WHERE n <= 50)""",
        """items AS (SELECT scope, ord, id, ((octet_length(encode(coalesce(content, ''))) + octet_length(encode(own))) // 3 + 40)::INT tokens, row_number() OVER (PARTITION BY scope ORDER BY ord) i FROM secs WHERE scope IN (SELECT scope FROM scopes))""",
        """fold AS (SELECT scope, 0::BIGINT i, 0 used, false cut, []::VARCHAR[] got, false took FROM scopes
  UNION ALL SELECT f.scope, x.i, CASE WHEN y.fits THEN used + tokens ELSE used END, cut OR NOT (y.fits OR y.seen), CASE WHEN y.fits THEN list_append(got, id) ELSE got END, y.fits
  FROM fold f JOIN items x ON x.scope = f.scope AND x.i = f.i + 1, LATERAL (SELECT list_contains(got, id) seen, NOT list_contains(got, id) AND used + tokens <= 2000 fits) y)""",
        recursive=True,
    )
    + "SELECT scope, ord, id, tokens, bool_or(cut) OVER (PARTITION BY scope) truncated FROM items JOIN fold USING (scope, i) QUALIFY took"
)
def get_context(spark, folder):
    """The context of each project scope within the default budget."""
    return context.assemble(S.memory(spark, folder), S.refs(spark, folder))


@book.query(
    r"""WITH s AS (SELECT DISTINCT session_no, regexp_replace(session, '\r\n?', chr(10), 'g') t FROM sessions WHERE session IS NOT NULL),
p AS (SELECT session_no, list_transform(list_filter(string_split(regexp_extract(t, '(?s)\nRequests:\n(.*?)(?:\nFinal response:|$)', 1), chr(10)), lambda x: starts_with(x, '- ')), lambda x: trim(substr(x, 3))) asked,
  regexp_extract(t, '(?s)\nFinal response:\n(.*)$', 1) said FROM s),
f AS (SELECT session_no, said, list_filter(asked, lambda x, i: i = 1 OR x <> asked[i - 1]) x FROM p),
w AS (SELECT session_no, said, len(x)::INT n_fresh, CASE WHEN len(x) > 8 THEN list_concat(x[1:3], ['... ' || (len(x) - 8) || ' more'], x[len(x) - 4:len(x)]) ELSE x END shown FROM f)
SELECT session_no, n_fresh, substr(coalesce(array_to_string(list_transform(shown, lambda x: '- ' || x), chr(10)), '') || chr(10) || substr(said, 1, 1200), 1, 4000) summary FROM w"""
)
def session_summary(spark, folder):
    return sessions.summarise(table(spark, folder, "sessions"))


@book.query("SELECT DISTINCT session_no, nullif(regexp_extract(session, 'on branch ([^,\\s]+)', 1), '') branch, CASE WHEN regexp_extract(session, 'Session summary: (\\d+) requests', 1) <> '' THEN regexp_extract(session, 'Session summary: (\\d+) requests', 1)::INT END n_said FROM sessions WHERE session IS NOT NULL")
def session_header(spark, folder):
    return sessions.parse(table(spark, folder, "sessions")).select("session_no", "branch", F.col("n_requests_said").alias("n_said"))


# ---- archives and streams


_SNAP = "m AS (SELECT * FROM mem WHERE status IN ('active', 'superseded')), e AS (SELECT * FROM edge WHERE src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m)), r AS (SELECT * FROM ref WHERE memory_id IN (SELECT id FROM m))"


def _snapshot(spark, folder, scratch):
    m = S.memory(spark, folder).filter("status in ('active', 'superseded')")
    return archive.export_lines(m, S.edges(spark, folder), S.refs(spark, folder), scratch)


@book.query(
    with_views(MEM, EDGE, REF, _SNAP)
    + """SELECT 'memory' kind, id k, md5(coalesce(content, '') || '|' || coalesce(scope, '') || '|' || coalesce(status, '') || '|' || coalesce(supersedes, '')) h FROM m
UNION ALL SELECT 'edge', src || ' ' || relation || ' ' || dst, md5('') FROM e UNION ALL SELECT 'ref', memory_id || ' ' || path || ' ' || symbol, md5(coalesce(state, '')) FROM r
UNION ALL SELECT 'end', (SELECT count(*) FROM m) || ' ' || (SELECT count(*) FROM e) || ' ' || (SELECT count(*) FROM r), md5('') UNION ALL SELECT 'header', 'lorebase-archive-1', md5('')"""
)
def export_snapshot(spark, folder):
    """(kind, k, h): every line of a snapshot by its key and a digest of its content, as read back from the lines."""
    p = archive.parse(_snapshot(spark, folder, Scratch(spark, "archive")))
    text = lambda c: F.coalesce(c, F.lit(""))
    kind = F.coalesce(*(F.when(F.col(k).isNotNull(), k) for k in ("memory", "edge", "ref", "end", "header")))
    key = F.coalesce(
        F.col("memory.id"), F.when(F.col("edge").isNotNull(), F.concat_ws(" ", "edge.src", "edge.relation", "edge.dst")), F.when(F.col("ref").isNotNull(), F.concat_ws(" ", "ref.memory_id", "ref.path", "ref.symbol")),
        F.when(F.col("end").isNotNull(), F.concat_ws(" ", *(F.col(f"end.{c}").cast("string") for c in ("memories", "edges", "refs")))), F.col("header.format"),
    )
    body = F.when(F.col("memory").isNotNull(), F.concat_ws("|", *(text(F.col(f"memory.{c}")) for c in ("content", "scope", "status", "supersedes")))).when(F.col("ref").isNotNull(), text(F.col("ref.state"))).otherwise("")
    return p.select(kind.alias("kind"), key.alias("k"), F.md5(body).alias("h"))


_IMPORT = (
    _SNAP
    + """, store AS (SELECT id FROM mem WHERE status = 'active'), nw AS (SELECT id, supersedes FROM m WHERE id NOT IN (SELECT id FROM store)),
lk AS (SELECT id, supersedes p FROM nw WHERE supersedes IN (SELECT id FROM nw)),
up AS (SELECT id, p here, [id] seen, p = id cyc FROM lk UNION ALL SELECT u.id, l.p, list_append(u.seen, u.here), list_contains(u.seen, l.p) OR l.p = u.here FROM up u JOIN lk l ON l.id = u.here WHERE NOT u.cyc),
ring AS (SELECT DISTINCT id FROM up WHERE cyc),
plan AS (SELECT id, CASE WHEN id IN (SELECT id FROM store) THEN 'present' WHEN id IN (SELECT id FROM ring) THEN 'cycle' WHEN supersedes IS NOT NULL AND supersedes NOT IN (SELECT id FROM m) AND supersedes NOT IN (SELECT id FROM store)
  THEN 'inserted_without_parent' ELSE 'inserted' END outcome FROM m)"""
)


def _imported(spark, folder):
    """A snapshot written as JSON lines, read again, and planned against a store that has the active records."""
    scratch = Scratch(spark, "archive")
    archive.write_archive(_snapshot(spark, folder, scratch), f"{scratch.root}/lines")
    parsed, stored = archive.read_archive(spark, f"{scratch.root}/lines"), S.memory(spark, folder).filter("status = 'active'")
    return parsed, stored, archive.import_plan(parsed, stored, scratch)


@book.query(with_views(MEM, EDGE, REF, _IMPORT, recursive=True) + "SELECT * FROM plan")
def import_archive(spark, folder):
    return _imported(spark, folder)[2]


@book.query(
    with_views(MEM, EDGE, REF, _IMPORT, recursive=True)
    + """, ids AS (SELECT id FROM store UNION SELECT id FROM plan WHERE outcome <> 'cycle'), x AS (SELECT 'edge' kind, src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids) ok, weight > 0.5 had FROM e
UNION ALL SELECT 'ref', memory_id IN (SELECT id FROM ids), state = 'current' FROM r) SELECT kind, CASE WHEN NOT ok THEN 'without_ends' WHEN had THEN 'present' ELSE 'inserted' END outcome, count(*) n FROM x GROUP BY ALL"""
)
def import_archive_links(spark, folder):
    """Edges and references of the same archive; the store has the heavier edges and the current references."""
    parsed, stored, plan = _imported(spark, folder)
    return archive.import_links(parsed, plan, stored, S.edges(spark, folder).filter("weight > 0.5"), S.refs(spark, folder).filter("state = 'current'"))


@book.query(
    with_views(MEM, EDGE, REF, _SNAP)
    + """, c AS (SELECT count(*) FILTER (WHERE id LIKE '%a') x, count(*) FILTER (WHERE id LIKE '%b') y, count(*) FILTER (WHERE id LIKE '%c') z FROM m)
SELECT unnest(['not_one_record','unknown_field','wrong_format','headers','ends','memories_miscounted','edges_miscounted','refs_miscounted']) "rule", unnest([z, x, 0, 0, 0, y, 0, 0])::BIGINT n FROM c"""
)
def archive_validate(spark, folder):
    """A snapshot that was spoilt: records with an unknown field beside them (ids in a), records that are lost (in b), lines without a record (ids in c, whose count still stands)."""
    scratch = Scratch(spark, "archive")
    lines = _snapshot(spark, folder, scratch)
    ends = lambda c: F.coalesce(F.get_json_object("value", "$.memory.id").endswith(c), F.lit(False))
    spoilt = lines.filter(~ends("b")).withColumn("value", F.when(ends("a"), F.concat(F.lit('{"extra":1,'), F.expr("substring(value, 2)"))).otherwise(F.col("value")))
    empty = lines.filter(ends("c")).withColumn("value", F.lit("{}"))
    archive.write_archive(spoilt.unionByName(empty), f"{scratch.root}/spoilt")
    return archive.check(archive.read_archive(spark, f"{scratch.root}/spoilt"))


@book.query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') \"start\", event_type, count(*) n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, folder):
    """Hourly counts of a stream with a watermark."""
    scratch = Scratch(spark, "stream")
    s = jobs.windowed_counts(jobs.stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")
    out = []
    jobs.run_batches_complete(s, scratch, "counts", lambda df, n: out.append(Scratch(spark, "counts").keep(df)))
    return out[-1]


@book.query("SELECT DISTINCT session_no FROM sessions WHERE loaded_at IS NOT NULL")
def stream_session_capture(spark, folder):
    """Repeated session rows dropped as they arrive."""
    s = jobs.stream(spark, folder, "sessions").filter("loaded_at is not null")
    return jobs.run_to_table(jobs.dedupe_arrivals(s, ["session_no"], "loaded_at", "3650 days").select("session_no"), Scratch(spark, "stream"), "sessions")


@book.query(
    """WITH s AS (SELECT session_id, nullif(trim(project), '') project, loaded_at, session_no FROM sessions WHERE session_id IS NOT NULL), f AS (SELECT session_id, arg_min(project, (loaded_at, session_no)) project FROM s WHERE project IS NOT NULL AND loaded_at IS NOT NULL GROUP BY ALL)
SELECT session_id, project, count(*) n FROM s JOIN f USING (session_id, project) WHERE loaded_at IS NOT NULL GROUP BY ALL"""
)
def stream_bind_sessions(spark, folder):
    """The first project of a session binds it: keyed state over a stream of session rows."""
    s = jobs.stream(spark, folder, "sessions").filter("loaded_at is not null").select("session_id", F.nullif(F.trim("project"), F.lit("")).alias("project"), "loaded_at", "session_no")
    return jobs.run_updates(jobs.bind_first(s, "session_id", "project", ["loaded_at", "session_no"]), ["session_id"], Scratch(spark, "stream"), "bind")


@book.query(f"{JUDGED} SELECT src_table, standing, count(*) n FROM judged GROUP BY ALL")
def stream_orphans(spark, folder):
    """The orphan state kept by a stream of memory lines."""
    others = {n: table(spark, folder, n) for n in ("memory_edges", "memory_refs")}
    tracker = jobs.track_orphans(spark, jobs.stream(spark, folder, "memories"), others, Scratch(spark, "stream").root)
    return tracker.refs().groupBy("src_table", "standing").agg(F.count("*").alias("n"))


QUERIES, ORACLE = book.QUERIES, book.ORACLE
