"""Pinned values and brute-force twins of the record operators."""

import datetime as dt
import itertools
import math
import random
import re

from pyspark.sql import functions as F

from lorebase.functions import coderef, hashing, jsonx, secrets, text, time
from lorebase.functions.similarity import trigram_pairs
from lorebase.session import Scratch
from lorebase.operators import consolidate, context, evaluation, graph, refs, search, sessions, similar
from lorebase.session import spread_cumsum
from lorebase.sources import archive


def one(spark, values, f, schema="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, x {schema}")
    return [r.y for r in df.select("n", f(F.col("x")).alias("y")).orderBy("n").collect()]


def test_content_key(spark):
    got = one(spark, ["  Use  Tabs. ", "use tabs", "USE\u00a0TABS!!", "use tabs\u3002", "", None, "a.b"], text.content_key)
    assert got == ["use tabs"] * 4 + ["", None, "a.b"]


def test_normalize_project(spark):
    cases = {
        "git@host.example:Team/App.git": "host.example/team/app",
        "https://user:pw@host.example:8443/Team/App.git?x=1": "host.example/team/app",
        "ssh://git@host.example:22/team/app/": "host.example/team/app",
        "/home/me/app": None, "file:///x/y": None, "C:\\work\\app": None, "word": None, "": None, None: None,
        "host.example/team/app": "host.example/team/app",
    }
    assert one(spark, list(cases), text.normalize_project) == list(cases.values())
    again = [v for v in cases.values() if v]
    assert one(spark, again, text.normalize_project) == again


def test_text_functions(spark):
    assert one(spark, ["abcdef", "abc", None], lambda c: text.truncate(c, 4)) == ["abc\u2026", "abc", None]
    assert one(spark, ["\u00e4\u00e4\u00e4", "abc", "\U0001f600x", ""], lambda c: text.clip_bytes(c, 5)) == ["\u00e4\u00e4", "abc", "\U0001f600x", ""]
    assert one(spark, ["\n  \n a  b \nc", "", None], text.first_line) == ["a b", None, None]
    assert one(spark, ["My Agent!", "..x", "", None], text.sanitize_agent) == ["my-agent-", "x", "unknown", "unknown"]
    assert one(spark, ["The 1,000 cats, and a dog."], text.normalize_answer) == [["1000", "cats", "dog"]]


def test_times(spark):
    assert one(spark, ["1:56 pm on 8 May, 2023", "nonsense", None], time.parse_spoken) == [dt.datetime(2023, 5, 8, 13, 56), None, None]
    assert one(spark, ["2023/05/20 (Sat) 02:21", ""], time.parse_slashed) == [dt.datetime(2023, 5, 20, 2, 21), None]
    day = F.lit("2024-02-14").cast("date")  # a Wednesday
    cases = {
        "yesterday": ("2024-02-13", "2024-02-13"), "3 days ago": ("2024-02-11", "2024-02-11"), "2 weeks ago": ("2024-01-31", "2024-01-31"), "last week": ("2024-02-05", "2024-02-11"),
        "next month": ("2024-03-01", "2024-03-31"), "last year": ("2023-01-01", "2023-12-31"), "last wednesday": ("2024-02-07", "2024-02-07"), "last tuesday": ("2024-02-13", "2024-02-13"),
        "0 days ago": None, "9999 days ago": None, "soon": None,
    }
    got = one(spark, list(cases), lambda c: time.calendar_meaning(c, day))
    assert [g and (str(g["first"]), str(g["last"])) for g in got] == list(cases.values())
    assert one(spark, [1, 2, 7, 99], time.backoff_seconds, "int") == [60, 120, 3600, 3600]
    found = one(spark, ["Yesterday I saw it, 3 days ago too; mid-yesterday-ish no."], time.calendar_expressions)
    assert found == [["yesterday", "3 days ago"]]


def test_secrets_and_json(spark):
    token = "ghp_" + "a" * 36
    got = one(spark, [f"use {token} now", "password = hunter2hunter2", "https://u:secret@h.example/x", "nothing here", None], secrets.redact)
    assert got == ["use [REDACTED:github-token] now", "password = [REDACTED:assignment]", "https://u:[REDACTED:url-password]@h.example/x", "nothing here", None]
    assert one(spark, [f"{token}", "plain"], secrets.findings) == [["github-token"], []]
    merged = one(spark, ['{"a": "1", "b": 2}', None], lambda c: jsonx.to_object(jsonx.merge(jsonx.as_map(c), F.create_map(F.lit("b"), F.lit("x")))))
    assert merged == ['{"a":"1","b":"x"}', '{"b":"x"}']
    assert one(spark, ['<think>{}</think> ```json\n{"a": {"b": 1}}\n``` bye', "none"], jsonx.model_json) == ['{"a": {"b": 1}}', None]


def test_fnv_and_embedding(spark):
    assert one(spark, ["", "a", "foobar"], hashing.fnv1a) == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    v = one(spark, [["a", "b", "a"], []], lambda c: hashing.hash_embedding(c, 8), "array<string>")
    assert math.isclose(sum(x * x for x in v[0]), 1.0) and v[1] == [1.0] + [0.0] * 7


def test_code_references(spark):
    t = "See internal/store/store.go:12 and `Queue.Claim`, call Resolve() in https://x.example/a.go; not main()."
    assert one(spark, [t, "", None], coderef.paths) == [["internal/store/store.go"], [], None]
    assert one(spark, [t], coderef.strong_symbols) == [["Queue.Claim", "Resolve"]]
    got = one(spark, ["pkg/a.go holds LeaseQueue", "pkg/a.go and pkg/b.go hold LeaseQueue"], coderef.code_references)
    assert [[tuple(x) for x in g] for g in got] == [[("pkg/a.go", ""), ("pkg/a.go", "LeaseQueue")], [("pkg/a.go", ""), ("pkg/b.go", "")]]


def test_running_sum_by_buckets(spark):
    r = random.Random(3)
    rows = [("a" if n % 3 else "b", n // 10, n, r.randrange(9) if n % 7 else None) for n in range(200)]
    df = spark.createDataFrame(rows, "k string, bucket int, at int, v int")
    got = {x["at"]: x.before for x in spread_cumsum(df, ["k"], "bucket", ["at"], "v", "before").collect()}
    run = {"a": 0, "b": 0}
    for k, _, at, v in rows:
        assert got[at] == run[k]
        run[k] += v or 0


def grams(s):
    out = set()
    for w in {w for w in "".join(c if c.isalnum() else " " for c in s.lower()).split()}:
        p = f"  {w} "
        out |= {p[i : i + 3] for i in range(len(p) - 2)}
    return out


def test_trigram_pairs_lose_nothing(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    texts = [" ".join(r.choices(words, k=6)) for _ in range(60)] + ["", None, "!!!"]
    rows = [(f"{n:03d}", n % 2, t) for n, t in enumerate(texts)]
    got = {(x.a, x.b) for x in trigram_pairs(Scratch(spark, "t"), spark.createDataFrame(rows, "id string, block int, text string"), 0.7).collect()}
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    rep = {}
    for i, b, t in rows:
        if plain(t):
            rep.setdefault((b, plain(t)), i)
    want = {(rep[b, plain(t)], i) for i, b, t in rows if plain(t) and rep[b, plain(t)] != i}
    for ((b, t), i), ((c, u), j) in itertools.combinations(rep.items(), 2):
        g, h = grams(t), grams(u)
        if b == c and round(len(g & h) / len(g | h), 9) >= 0.7:
            want.add(tuple(sorted((i, j))))
    assert got == want


DOC = "id string, scope string, mem_type string, content string, created_at timestamp, status string, expires_at timestamp, vec array<float>"
NOW = dt.datetime(2025, 12, 1)


def docs(spark):
    rows = [
        ("a", "user", "semantic", "alpha beta alpha", NOW, "active", None, [1.0, 0.0]),
        ("b", "project:x", "episodic", "beta gamma", NOW, "active", None, [0.0, 1.0]),
        ("c", "project:y", "semantic", "alpha beta", NOW, "active", None, [1.0, 0.1]),
        ("d", "project:x", "semantic", None, NOW, "active", None, None),
    ]
    return spark.createDataFrame(rows, DOC)


def test_search(spark):
    q = spark.createDataFrame([("q1", "alpha", "project:x", [1.0, 0.0]), ("q2", "!?", "project:x", None), ("q3", None, None, None)], "query_id string, text string, scope string, vec array<float>")
    lex = {(r.query_id, r.id): (r.lex, r["rank"]) for r in search.lexical(q, docs(spark), 50).collect()}
    assert lex == {("q1", "a"): (1.25, 1)}  # the other project is not seen; no text, no hit
    hyb = [(r.id, r.score) for r in search.hybrid(q, docs(spark), most=0.5).orderBy("place").collect()]
    assert hyb == [("a", 1.0)]  # first everywhere is one
    f = spark.range(1).select(
        search.recency(F.lit(True), F.lit("semantic"), F.lit(False), F.lit(7.0)).alias("intent"),
        search.recency(F.lit(False), F.lit("episodic"), F.lit(True), F.lit(30.0)).alias("mild"),
        search.recency(F.lit(False), F.lit("episodic"), F.lit(False), F.lit(30.0)).alias("none"),
        search.recency(F.lit(True), F.lit("semantic"), F.lit(False), F.lit(-3.0)).alias("future"),
        search.clamp_score(F.lit(float("nan"))).alias("nan"),
    ).first()
    assert (f.intent, round(f.mild, 9), f.none, f.future, f.nan) == (0.5, 0.8, 1.0, 1.0, 1e-6)
    assert one(spark, ["what did we decide last week", "last-write wins", "최근 결정", "nothing", None], search.temporal_intent) == [True, False, True, False, False]


def test_lexical_ranks_in_parts_and_ships_only_the_best_of_each(spark, monkeypatch):
    from lorebase.operators import lexical

    monkeypatch.setattr(lexical, "PART_BYTES", 3000)
    monkeypatch.setattr(lexical, "BLOCK", 7)
    r = random.Random(11)
    words = [*["every"] * 40, *[f"w{n}" for n in range(60)], "\u00fcber", "\ud55c\uad6d", "a\u0308"]
    scopes = ["user", "project:x", "project:y", None]
    rows = [(f"{n:04d}", r.choice(scopes), " ".join(r.choices(words, k=r.randint(0, 12))).upper() if n % 9 else None) for n in range(700)]
    asking = [x for x in rows if r.random() < 0.08] + [("other", "project:x", "every w1 w1 w2 nothing"), ("lone", "project:none", "w3"), ("mute", "user", "?!")]
    q = spark.createDataFrame(asking, "query_id string, scope string, text string")
    d = spark.createDataFrame(rows, "id string, scope string, content string")
    cut = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    gains = {i: {t: sum(1 / j**2 for j in range(1, cut(t0).count(t) + 1)) for t in set(cut(t0))} for i, _, t0 in rows}
    for everywhere, found in ((False, search.lexical(q, d, 5)), (True, search.lexical_everywhere(q, d, 5))):
        want = set()
        for i, scope, text in asking:
            ts = set(cut(text))
            seen = [x for x in rows if x[0] != i and (everywhere or x[1] in ("user", scope or "user"))]
            hits = sorted(((round(sum(gains[x[0]].get(t, 0) for t in ts) / len(ts), 9), x[0]) for x in seen if ts & set(gains[x[0]])), reverse=True)
            want |= {(i, b, lex, n) for n, (lex, b) in enumerate(hits[:5], 1)}
        assert {(x.query_id, x.id, x.lex, x["rank"]) for x in found.collect()} == want
    ts = lambda c, once: search._joined(c, "ts", once)
    of = lexical.best(q.select("query_id", F.lit("").alias("scope"), ts("text", True)).filter("ts <> ''"), d.select("id", F.lit("").alias("scope"), ts("content", False)).filter("ts <> ''"), 5)
    n = of.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert 5 < n <= 5 * 10  # several parts, five of each, however many records share a word


def test_pipeline_degrades_without_reranker(spark):
    q = spark.createDataFrame([("q1", "alpha", "project:x", [1.0, 0.0])], "query_id string, text string, scope string, vec array<float>")
    edges = spark.createDataFrame([("a", "b", "relates_to")], "src string, dst string, relation string")
    none = spark.createDataFrame([], "memory_id string, path string, symbol string, state string")
    with_graph = {r.id for r in search.pipeline(spark, q, docs(spark), edges, none, most=0.5).collect()}
    without = {r.id for r in search.pipeline(spark, q, docs(spark), edges, none, most=0.5, rerank=False).collect()}
    assert with_graph == {"a", "b"} and without == {"a"}


def test_budget_skips_what_is_too_big_and_goes_on(spark):
    rows = [("s", 1, "a", 60), ("s", 2, "b", 80), ("s", 3, "a", 60), ("s", 4, "c", 40), ("t", 1, "z", 500)]
    got = context.budget_take(spark.createDataFrame(rows, "scope string, ord long, id string, tokens int"), ["scope"], 100)
    assert sorted((r.id, r.tokens, r.truncated) for r in got.collect()) == [("a", 60, True), ("c", 40, True)]


def test_context_sections(spark):
    m = docs(spark).withColumn("attrs", F.lit("{}"))
    empty = spark.createDataFrame([], "memory_id string, path string, symbol string, state string")
    got = {(r.scope, r.section, r.id) for r in context.sections(m, empty).collect()}
    assert got == {("project:x", 3, "b"), ("project:x", 4, "d"), ("project:y", 4, "c")}


def test_ref_checks(spark):
    r = spark.createDataFrame(
        [("m", "a", "", "pending", None), ("m", "b", "", "pending", None), ("m", "c", "S", "current", "h1"), ("m", "d", "", "current", "h1"), ("m", "e", "", "current", "h1"), ("m", "f", "", "pending", None)],
        "memory_id string, path string, symbol string, state string, anchor_hash string",
    )
    c = spark.createDataFrame([("a", "", True, "h"), ("b", "", False, None), ("c", "S", False, None), ("d", "", True, "h1"), ("e", "", True, "h2")], "path string, symbol string, found boolean, hash string")
    got = {x.path: (x.next_state, x.next_anchor) for x in refs.apply_checks(r, c).collect()}
    assert got == {"a": ("current", "h"), "b": ("unresolved", None), "c": ("missing", "h1"), "d": ("current", "h1"), "e": ("changed", "h1"), "f": ("pending", None)}


def test_duplicates_and_batches(spark):
    old = spark.createDataFrame([("a", "s", "Use tabs.", "active", NOW, None), ("b", "s", "use  tabs", "superseded", NOW, None), ("c", "s", None, "active", NOW, None)], "id string, scope string, content string, status string, created_at timestamp, expires_at timestamp")
    new = spark.createDataFrame([("n1", "s", "USE TABS!"), ("n2", "t", "use tabs"), ("n3", "s", "other"), ("n4", "s", "Other."), ("n5", "s", None)], "id string, scope string, content string")
    assert {tuple(r) for r in similar.find_duplicate(old, new).collect()} == {("n1", "a")}
    assert {tuple(r) for r in similar.create_if_absent(old, new).collect()} == {("n1", "duplicate"), ("n2", "created"), ("n3", "created"), ("n4", "repeated")}


def test_history_both_ways_and_cycles(spark):
    m = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), ("z", "gone")], "id string, supersedes string")
    got = {tuple(r) for r in graph.history(spark, m, m.filter("id in ('b', 'z')")).collect()}
    assert got == {("b", "b", 0), ("b", "a", -1), ("b", "c", 1), ("b", "d", 1), ("z", "z", 0)}
    cyc = {tuple(r) for r in graph.history(spark, m, m.filter("id = 'x'")).collect()}
    assert cyc == {("x", "x", 0), ("x", "y", -1)}


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 7), ("r", "c", 2)], "query_id string, id string, place int")
    rel = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("r", "x"), ("s", "y")], "query_id string, id string")
    got = {r.query_id: (r.recall5, r.hit5, r.rr10) for r in evaluation.ranking_metrics(ranked, rel).collect()}
    assert got == {"q": (0.5, 1, 1.0), "r": (0.0, 0, 0.0), "s": (0.0, 0, 0.0)}
    p = spark.createDataFrame([(1, "the red red cat", "red cat"), (2, "x", "y"), (3, "a", "")], "n int, g string, p string")
    f1 = {r.n: r.f1 for r in evaluation.token_f1(p, "n", F.col("g"), F.col("p")).collect()}
    assert f1 == {1: 0.8, 2: 0.0}
    rows = [(t, f"{t}{n:03d}") for t, k in (("a", 133), ("b", 133), ("c", 78), ("d", 70), ("e", 56), ("f", 30)) for n in range(k)]
    s = evaluation.stratified(spark.createDataFrame(rows, "t string, k string"), "t", "k", 60)
    assert {r.t: r.n for r in s.groupBy("t").agg(F.count("*").alias("n")).collect()} == {"a": 16, "b": 16, "c": 9, "d": 8, "e": 7, "f": 4}
    e = spark.createDataFrame([("q", "i"), ("q", "j"), ("n", None)], "query_id string, item string")
    got = {r.query_id: r.recall for r in evaluation.evidence_recall(spark.createDataFrame([("q", "i")], "query_id string, item string"), e).collect()}
    assert got == {"q": 0.5, "n": -1.0}


def test_session_summary(spark):
    asks = "\n".join(["- one", "- one", *(f"- n{n}" for n in range(12))])
    s = spark.createDataFrame([(1, f"Session summary: 14 requests on branch fix/x, 2025.\nRequests:\n{asks}\nFinal response:\nDone."), (2, ""), (3, None)], "session_no int, session string")
    got = {r.session_no: r for r in sessions.summarise(s).collect()}
    assert got[1].n_fresh == 13 and got[1].summary.split("\n") == ["- one", "- n0", "- n1", "- ... 5 more", "- n7", "- n8", "- n9", "- n10", "- n11", "Done."]
    assert got[2].n_fresh == 0 and 3 not in got


def test_archive_check_finds_faults(spark):
    good = ['{"header":{"format":"lorebase-archive-1"}}', '{"memory":{"id":"a"}}', '{"end":{"memories":1,"edges":0,"refs":0}}']
    bad = [good[0], '{"memory":{"id":"a"},"edge":{"src":"a"}}', "not json", '{"other":1}', '{"end":{"memories":5,"edges":0,"refs":0}}']
    check = lambda lines: {r.rule: r.n for r in archive.check(archive.parse(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()}
    assert set(check(good).values()) == {0}
    faults = check(bad)
    assert faults["not_one_record"] == 3 and faults["unknown_field"] == 2 and faults["memories_miscounted"] == 4


def test_proposals(spark):
    p = spark.createDataFrame([("p", "duplicate", ["a", "b"], "a", "pending"), ("q", "digest", ["a", "gone"], None, "pending")], "proposal_id string, kind string, member_ids array<string>, keep_id string, status string")
    m = spark.createDataFrame([("a", "active", None), ("b", "active", None)], "id string, status string, expires_at timestamp")
    assert {tuple(r) for r in consolidate.apply_decisions(m, p).collect()} == {("p", "a", "kept"), ("p", "b", "superseded"), ("q", "a", "stale"), ("q", "gone", "stale")}


def test_candidate_pairs_by_text_and_vector_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr("lorebase.functions.similarity.PART", 5)
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    rows = [(f"{n:03d}", r.choice(["user", "user", "project:x"]), r.choice(["semantic", "semantic", "episodic"]), " ".join(r.sample(words, 5)), "active", None) for n in range(60)]
    # a copy that is not the first of its class, near by vector too
    rows += [(f"{n:03d}", "user", "semantic", "the same text", "active", None) for n in (60, 61, 62)] + [("063", "user", "semantic", None, "active", None), ("064", "user", "semantic", "", "active", None)]
    vec = {x[0]: [r.gauss(0, 1) for _ in range(3)] for x in rows if r.random() < 0.8} | {"061": [1.0, 0.0, 0.0], "062": [1.0, 0.01, 0.0], "063": [0.0, 0.0, 0.0], "064": [1.0, 0.02, 0.0]}
    m = spark.createDataFrame(rows, "id string, scope string, mem_type string, content string, status string, expires_at timestamp")
    vectors = spark.createDataFrame(list(vec.items()), "id string, vec array<double>")
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b)), 9)
    want, firsts = {}, {}
    kept = [x for x in rows if x[2] == "semantic"]
    for x in kept:
        firsts.setdefault((x[1], x[3]), x[0])
        others = [(cosine(vec[x[0]], vec[y[0]]), y[0]) for y in kept if y[0] != x[0] and y[1] == x[1] and all(i in vec and any(vec[i]) for i in (x[0], y[0]))]
        for sim, other in sorted(others, reverse=True)[:3]:
            if sim >= 0.75:
                want[min(x[0], other), max(x[0], other)] = sim
    by_vector = set(want)
    for x, y in itertools.combinations(kept, 2):
        g, h = grams(x[3] or ""), grams(y[3] or "")
        # copies are linked to the first of them
        first = all(firsts[z[1], z[3]] == z[0] for z in (x, y)) or (x[3] == y[3] and firsts[x[1], x[3]] == x[0])
        if x[1] == y[1] and g and h and round(len(g & h) / len(g | h), 9) >= 0.5 and (first or (x[0], y[0]) in by_vector):
            want[x[0], y[0]] = max(want.get((x[0], y[0]), 0), round(len(g & h) / len(g | h), 9))
    assert want["061", "062"] == 1 and len(by_vector) > 20 and any(0.5 <= s < 0.8 and p not in by_vector for p, s in want.items())
    judged, waiting = sorted(want)[0], sorted(want)[-1][1]
    p = spark.createDataFrame([("p", list(judged), "dismissed"), ("q", [waiting, "gone"], "pending")], "proposal_id string, member_ids array<string>, status string")
    want = {k: s for k, s in want.items() if k != judged and waiting not in k}
    got = {(x.a, x.b): x.sim for x in consolidate.candidate_pairs(Scratch(spark, "t"), m, vectors, p).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], s, abs_tol=2e-9) for k, s in want.items())


def test_embedding_of_all_words_and_records(spark, sf):
    from lorebase.plans import scalars
    from lorebase.sources import records

    texts = ["A bee and a Bär, a 2nd bee", "", None, "!!", "날짜 x"]
    rows = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "id string, text string")
    words = [["a", "bee", "and", "a", "bär", "a", "2nd", "bee"], [], [], [], ["날짜", "x"]]
    for dim in (8, 64):
        want = one(spark, words, lambda c, dim=dim: hashing.hash_embedding(c, dim), "array<string>")
        got = {(x.id, x["at"]): x.x for x in hashing.embed(rows, dim).collect()}
        want = {(str(n), k): x for n, v in enumerate(want) for k, x in enumerate(v) if x}
        assert got.keys() == want.keys() and all(math.isclose(got[k], x) for k, x in want.items())
    got = scalars.hash_fnv_embedder(spark, sf)
    assert got.select("id").distinct().count() == records.memory(spark, sf).count() and 16 < got.agg(F.max("at")).first()[0] < 1024


def test_reader_context_matches_a_fold(spark):
    r = random.Random(17)
    rows = [(f"{n:03d}", r.choice(["user", "project:x"]), r.choice(["s", "t", "u", None]), "x" * r.choice([0, 10, 30, 60, 130]), NOW + dt.timedelta(r.randint(0, 9))) for n in range(60)]
    doc = {x[0]: x for x in rows}
    hits = [(f"q{q}", i, k) for q in range(30) for k, i in enumerate(r.sample(sorted(doc), 5), 1)]
    sessions = {}
    for x in sorted(rows, key=lambda x: (x[4], x[0])):
        sessions.setdefault((x[1], x[2], None if x[2] else x[0]), []).append(x[0])
    of = {i: (s, n) for s, ids in sessions.items() for n, i in enumerate(ids)}
    want, skipped = {}, 0
    for q in {h[0] for h in hits}:
        mine, got, used = [h[1] for h in hits if h[0] == q], [], 0
        around = [sessions[of[i][0]][j] for i in mine for j in (of[i][1] - 1, of[i][1] + 1) if 0 <= j < len(sessions[of[i][0]])]
        for i in [*mine, *around]:
            if i not in got and used + len(doc[i][3]) <= 120:
                got.append(i)
                used += len(doc[i][3])
        skipped += len(doc[mine[0]][3]) > 120 and bool(got)
        order = list(dict.fromkeys(of[i][0] for i in mine))
        got.sort(key=lambda i: (order.index(of[i][0]), of[i][1]))
        want[q] = [(i, i in mine, sum(len(doc[j][3]) for j in got[: n + 1])) for n, i in enumerate(got)]
    h = spark.createDataFrame(hits, "query_id string, id string, place int")
    found = context.reader_context(h, spark.createDataFrame(rows, "id string, scope string, source_session string, content string, created_at timestamp"), 120)
    got = {}
    for x in sorted(found.collect(), key=lambda x: (x.query_id, x.place)):
        got.setdefault(x.query_id, []).append((x.id, x.is_hit, x.used_bytes))
    assert got == want and skipped and any(not hit for v in want.values() for _, hit, _ in v)


def test_ablation_has_nine_configurations(spark, sf):
    from lorebase.plans import retrieval

    got = [x.config for x in retrieval.eval_ablation(spark, sf).select("config").collect()]
    assert sorted(got) == ["full", "hybrid", "hybrid_rerank", "lexical", "lexical_signals", "no_graph", "no_recency", "no_rerank", "no_stale"]


def test_pipeline_without_vectors(spark):
    q = spark.createDataFrame([("q1", "gamma", "project:x", [1.0, 0.0])], "query_id string, text string, scope string, vec array<float>")
    edges = spark.createDataFrame([], "src string, dst string, relation string")
    none = spark.createDataFrame([], "memory_id string, path string, symbol string, state string")
    found = {v: {r.id for r in search.pipeline(spark, q, docs(spark), edges, none, most=0.5, rerank=False, vectors=v).collect()} for v in (True, False)}
    assert found == {True: {"a", "b"}, False: {"b"}}


def test_newest_versions_with_fewer_columns_are_the_same(spark, sf):
    from lorebase.plans import retrieval
    from lorebase.sources import records

    few = records.memory(spark, sf, retrieval._STORED)
    assert few.columns == ["id", *retrieval._STORED] and "attrs" not in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, few.collect())) == sorted(map(str, records.memory(spark, sf).select("id", *retrieval._STORED).collect()))


def test_ablation_ranks_once_and_agrees_with_the_pipeline(spark, monkeypatch):
    from lorebase.plans.retrieval import CONFIGURATIONS

    q = spark.createDataFrame([("q1", "alpha", "project:x", [1.0, 0.0]), ("q2", "gamma last week", "project:x", None)], "query_id string, text string, scope string, vec array<float>")
    edges = spark.createDataFrame([("a", "b", "relates_to")], "src string, dst string, relation string")
    stale = spark.createDataFrame([("a", "p", "s", "changed")], "memory_id string, path string, symbol string, state string")
    some = ("full", "no_rerank", "lexical")
    want = {(n, x.query_id, x.id, x.place) for n in some for x in search.pipeline(spark, q, docs(spark), edges, stale, most=0.5, **CONFIGURATIONS[n]).collect()}
    calls, once = [], search.lexical
    monkeypatch.setattr(search, "lexical", lambda *a: calls.append(a) or once(*a))
    got = {(x.config, x.query_id, x.id, x.place) for x in search.ablation(spark, q, docs(spark), edges, stale, CONFIGURATIONS, most=0.5).collect()}
    assert {x for x in got if x[0] in some} == want and {x[0] for x in got} == set(CONFIGURATIONS) and len(calls) == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_carry_what_their_query_needs_and_are_shuffled_once(spark):
    q = spark.createDataFrame([("q1", "alpha", "project:x", [1.0, 0.0])], "query_id string, text string, scope string, vec array<float>")
    plan = plan_of(search.hybrid(q, docs(spark), most=0.5))
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(query_id#" in plan and not re.search(r"hashpartitioning\(query_id#\d+, id#", plan) and not re.search(r"hashpartitioning\(id#", plan)


def test_pipeline_reads_the_references_columns_it_needs(spark, sf):
    from lorebase.plans import retrieval
    from lorebase.sources import records

    few = records.refs(spark, sf, ("state",))
    assert few.columns == ["memory_id", "path", "symbol", "state"]
    assert sorted(map(str, few.collect())) == sorted(map(str, records.refs(spark, sf).select("memory_id", "path", "symbol", "state").collect()))
    assert "anchor_hash" not in plan_of(retrieval.retrieve_pipeline(spark, sf))


def test_a_hub_is_met_by_scope(spark):
    r = random.Random(23)
    rows = [(f"{n:03d}", r.choice(["user", "project:x", "project:y"])) for n in range(120)]
    scope = dict(rows)
    edges = sorted({(r.choice(rows)[0], r.choice(["hub", "hub2", r.choice(rows)[0]]), r.choice(["derived_from", "relates_to"])) for _ in range(400)})
    asked = [("q1", "project:x"), ("q2", None), ("003", "project:y")]
    first = [(q, i, r.randint(1, 9) / 10, n) for q, _ in asked for n, (i, _) in enumerate(r.sample(rows, 10), 1)]
    want = {}
    for q, i, score, place in first:
        up = {t for s, t, kind in edges if s == i and kind == "derived_from"}
        near = {t for s, t, _ in edges if s == i} | {s for s, t, _ in edges if t == i} | {s for s, t, kind in edges if kind == "derived_from" and t in up and s != i}
        for b in near if place <= search.SEEDS else ():
            if b != q and scope.get(b) in ("user", dict(asked)[q] or "user"):
                want[q, b] = max(want.get((q, b), 0), score / 2)
    e = spark.createDataFrame(edges, "src string, dst string, relation string")
    d = spark.createDataFrame(rows, "id string, scope string")
    found = search.expand(spark.createDataFrame(first, "query_id string, id string, score double, place int"), spark.createDataFrame(asked, "query_id string, scope string"), d, e)
    assert {(x.query_id, x.id): x.graph for x in found.collect()} == want and len(want) > 50
    assert re.search(r"hashpartitioning\(dst#\d+, scope#|\[dst#\d+, scope#", plan_of(found))


def test_trigram_pairs_are_counted_in_parts_and_no_trigram_is_shuffled(spark, monkeypatch):
    from lorebase.functions import overlaps, similarity

    monkeypatch.setattr(similarity, "SETS", 25)
    monkeypatch.setattr(overlaps, "STEP", 4)
    monkeypatch.setattr(overlaps, "COMMON_MOST", 9)
    r = random.Random(29)
    vocabulary = ["alpha", "alphabet", "beta", "betas", "gamma", "x", "über", "한국어", "d1", *[f"w{n}ord" for n in range(20)]]
    rows = [(f"{n:03d}", r.choice([None, "b", "c"]), " ".join(r.choices(vocabulary, k=r.choice([1, 2, 4, 8, 20])))) for n in range(220)]
    rep = {}
    for i, b, t in rows:
        rep.setdefault((b, t), i)
    held = {"003", "010", "100"}
    want = {(rep[b, t], i, 1.0) for i, b, t in rows if rep[b, t] != i}
    for ((b, t), i), ((c, u), j) in itertools.combinations(rep.items(), 2):
        g, h = grams(t), grams(u)
        if b == c and round(len(g & h) / len(g | h), 9) >= 0.5:
            want.add((min(i, j), max(i, j), round(len(g & h) / len(g | h), 9)))
    want = {x for x in want if not held & set(x[:2])}
    d = spark.createDataFrame(rows, "id string, b string, text string").select("id", F.struct("b").alias("block"), "text")
    found = trigram_pairs(Scratch(spark, "t"), d, 0.5, spark.createDataFrame([(x,) for x in held], "id string"))
    got = [(x.a, x.b, x.sim) for x in found.collect()]
    assert len(got) == len(set(got)) and {x[:2] for x in got} == {x[:2] for x in want}
    at = {x[:2]: x[2] for x in want}
    assert all(math.isclose(s, at[a, b], abs_tol=2e-9) for a, b, s in got) and len(got) > 100
    assert "explode(g" not in plan_of(found)


def test_reader_context_reads_the_memories_once(spark, sf):
    from lorebase.plans import composite

    plan = plan_of(composite.reader_context(spark, sf))
    assert "attrs" not in plan and "source_session" in plan and "supersedes" not in plan


def test_eval_recall_keeps_its_hits(spark, sf):
    from lorebase.plans import retrieval

    assert "CoGroups" not in plan_of(retrieval.eval_recall_hit_mrr(spark, sf))


def test_evidence_recall_keeps_its_ranking(spark, sf):
    from lorebase.plans import retrieval

    assert "CoGroups" not in plan_of(retrieval.evidence_recall(spark, sf))


def test_reader_prompt_keeps_its_hits(spark, sf):
    from lorebase.plans import extras

    assert "CoGroups" not in plan_of(extras.reader_prompt(spark, sf))


def test_recall_reads_the_references_columns_it_needs(spark, sf):
    from lorebase.plans import extras

    assert "anchor_hash" not in plan_of(extras.recall(spark, sf))


def test_stage_trace_reads_the_references_columns_it_needs(spark, sf, monkeypatch):
    from lorebase.plans import extras

    asked, refs_of = [], extras.S.refs
    monkeypatch.setattr(extras.S, "refs", lambda *a: asked.append(a[2:]) or refs_of(*a))
    assert {x.stage for x in extras.stage_trace(spark, sf).collect()} == {"first", "graph", "pool", "reranked"} and asked == [(("state",),)]


def _shuffle_files(spark):
    blocks = spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return {n for n in (blocks.apply(i).name() for i in range(blocks.size())) if n.startswith("shuffle_")}


def test_kept_hits_let_go_of_their_shuffles(spark):
    from time import sleep

    from lorebase.plans import retrieval

    before = _shuffle_files(spark)
    retrieval._kept(spark, spark.range(20_000).selectExpr("id % 100 as k", "id").repartition(3, "k").groupBy("k").count())
    # the cleaner removes files a moment later
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        sleep(0.1)
    assert not _shuffle_files(spark) - before
