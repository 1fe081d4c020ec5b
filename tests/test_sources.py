"""Readers, checks of written texts, the vector index, model hooks, and the contract of the entry module."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lorebase.operators import extract, models, vectorindex
from lorebase.plans import registry
from lorebase.sources import corpora, records


def lines(spark, *objects):
    return spark.createDataFrame([(json.dumps(o),) for o in objects], "value string")


def test_conversations(spark):
    s = {
        "sample_id": "s",
        "qa": [{"question": "q", "answer": "a; because", "category": 3, "evidence": ["D1:1"]}, {"question": "n", "answer": 5, "category": 1}, {"question": "x", "answer": "y", "category": 5}],
        "conversation": {"speaker_a": "A", "session_10": [{"speaker": "A", "dia_id": "D10:1", "text": "late"}], "session_2": [{"speaker": "B", "dia_id": "D2:1", "text": "hi", "blip_caption": "a cat"}], "session_2_date_time": "1:56 pm on 8 May, 2023"},
    }
    t = {r.turn_id: r for r in corpora.conversation_turns(lines(spark, s)).collect()}
    assert t["D2:1"].text == "hi [picture: a cat]" and t["D2:1"].said_at == dt.datetime(2023, 5, 8, 13, 56) and t["D10:1"].session_no == 10
    q = {r.question: r.answer for r in corpora.conversation_questions(lines(spark, s)).collect()}
    assert q == {"q": "a", "n": "5"}


def test_haystacks_and_pairs(spark):
    turns = [{"role": "user", "content": "u1"}, {"role": "user", "content": "u2"}, {"role": "assistant", "content": "a1"}, {"role": "user", "content": "u3"}]
    q = {"question_id": "q", "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_session_ids": ["s1"], "haystack_sessions": [turns]}
    odd = {"question_id": "odd", "haystack_dates": [], "haystack_session_ids": ["s1"], "haystack_sessions": [turns]}
    t = corpora.haystack_turns(lines(spark, q, odd))
    assert {r.session_id for r in t.filter("question_id = 'odd'").collect()} == {None}
    got = [(r.user, r.assistant) for r in corpora.pair_turns(t.filter("question_id = 'q'"), ["question_id", "session_id"]).orderBy("pair").collect()]
    assert got == [("u1\nu2", "a1"), ("u3", "")]
    labels = spark.createDataFrame([(1,), (4,), (9,), (None,)], "c int").select(corpora.category_label(F.col("c")).alias("l"))
    assert [r.l for r in labels.collect()] == ["multi-hop", "single-hop", "other", "other"]


def test_log_reader_skips_what_is_broken(spark, tmp_path):
    (tmp_path / "abc.jsonl").write_text('{"t":"2024-01-01T00:00:00Z","k":"prompt","x":"hi"}\nbroken\n{"t":"2024-01-01T00:00:01Z"}\n')
    assert [(r.session, r.kind) for r in corpora.read_log(spark, str(tmp_path)).collect()] == [("abc", "prompt")]


def test_extraction_rules_in_order(spark):
    src = 'We fixed the lease queue in the worker. The page said "a very long quoted sentence that nobody here wrote at all" today.'
    rows = [
        (1, "s", "short", src, 0.9), (2, "s", "We fixed the lease queue in the worker.", src, 0.9), (3, "s", "we fixed the  lease queue in the worker.", src, 0.9), (4, "s", "Bananas are yellow and quite sweet", src, 0.9),
        (5, "s", "a very long quoted sentence that nobody here wrote", src, 0.9), (6, "s", "We fixed the lease queue", src, 0.1), (7, "s", "x" * 500, src, 0.9), (8, "s", "token ghp_" + "a" * 36, src, 0.9), (9, "s", None, None, None),
    ]
    got = {r.cand_id: r.reject_reason for r in extract.validate(spark.createDataFrame(rows, "cand_id int, source_id string, text string, source string, confidence double")).collect()}
    assert got == {1: "short", 2: None, 3: "repeated", 4: "not_grounded", 5: "quoted", 6: "unsure", 7: "long", 8: "secret", 9: "short"}


def test_reworded_quotes_are_quoted(spark):
    src = "We wrote the lease queue. The page said “a very long quoted sentence that nobody here wrote at all” today."
    rows = [(1, "s", "a long sentence quoted that nobody wrote", src, 0.9), (2, "s", "we wrote the lease queue, said the page", src, 0.9)]
    got = {r.cand_id: r.reject_reason for r in extract.validate(spark.createDataFrame(rows, "cand_id int, source_id string, text string, source string, confidence double")).collect()}
    assert got == {1: "quoted", 2: None}


def brute_spans(text):
    out = []
    for a, b in (('"', '"'), ("“", "”"), ("「", "」"), ("```", "```")):
        rest = text
        while a in rest and b in rest.split(a, 1)[1]:
            span, rest = rest.split(a, 1)[1].split(b, 1)
            out += [span] * (len(span) >= 40)
    return out


def test_quoted_spans_of_every_kind_and_document(spark, tmp_path):
    from lorebase.operators.extract import quoted_spans
    from lorebase.plans import composite

    long, r = "what somebody else has written in a long text", random.Random(3)
    texts = [f'"{long}"', f"“{long}”", f"「{long}」", f"```\n{long}\n```", f'```\nx = "{long}"\n``` and "{long}"', f'"a" {long} "b"', f"```a``` {long} ```b```", "", None]
    texts += ["".join(r.choices(['"', "“", "”", "「", "」", "```", long, "short", "\n"], k=14)) for _ in range(60)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.q for x in docs.filter("text is not null").select("doc_id", quoted_spans(F.col("text")).alias("q")).collect()}
    assert got == {n: brute_spans(t) for n, t in enumerate(texts) if t is not None}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.n for x in composite.quoted_spans(spark, str(tmp_path)).collect()} == {n: len(s) for n, s in got.items()}


def test_vector_index_recall(spark):
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(n, [x + r.gauss(0, 0.25) for x in centres[n % 12]]) for n in range(600)] + [(600, None)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    q = v.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    c = vectorindex.fit(v, 12)
    exact = vectorindex.search(q, v, c, 10, 12)
    got = vectorindex.recall(vectorindex.search(q, v, c, 10, 4), exact).first()
    assert got.n_exact == 120 and got.recall >= 0.9
    assert vectorindex.assign(v.filter("vec is not null"), c).count() == 600  # every row is indexed
    assert vectorindex.fit(v.limit(0), 4) == []


def test_embedding_hook_tries_rows_alone(spark):
    def model(texts):
        if len(texts) > 1 and "bad" in texts:
            raise ValueError
        if texts == ["bad"]:
            raise ValueError
        return [[float(len(t)), float("nan") if t == "nan" else 0.0] for t in texts]

    df = spark.createDataFrame([("1", "abc"), ("2", "bad"), ("3", None), ("4", "nan")], "id string, content string")
    assert {r.id: list(r.vec) for r in models.embed(df, model, "m").collect()} == {"1": [3.0, 0.0], "3": [0.0, 0.0]}


def test_newest_version_and_clean_views(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(n, i, "s", " USER ", "c", "{}", "a", None, None, "User ", conf, st, None, None, None, None, t, up, t) for n, i, conf, st, up in
            [(1, "00000000-0000-0000-0000-00000000000A", 0.5, "Active", t), (2, "00000000-0000-0000-0000-00000000000a", 7.0, "DELETED ", t), (3, None, 0.1, "active", t)]]
    m = spark.createDataFrame(rows, "line_no long, id string, mem_type string, scope string, content string, attrs string, source_agent string, source_session string, evidence_uri string, trust string, confidence double, status string, supersedes string, valid_from timestamp, valid_to timestamp, expires_at timestamp, created_at timestamp, updated_at timestamp, loaded_at timestamp")
    got = records.newest(m).collect()
    assert len(got) == 1 and (got[0].line_no, got[0].status, got[0].scope, got[0].trust, got[0].confidence) == (2, "deleted", "user", "user", None)


def test_entry_and_registry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["scan_list", "neighbors", "digest_groups", "get_context", "archive_validate", "stream_orphans"])
def test_queries_run(spark, sf, name):
    assert registry.queries()[name](spark, sf).columns


def test_search_plan_prunes_and_pushes(spark, sf):
    """A lookup reads its columns only, and a filter on a stored column reaches the scan."""
    from lorebase.sources.tables import table

    df = table(spark, sf, "memories").filter("mem_type = 'episodic'").select("line_no")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(mem_type,episodic)" in plan and "content" not in plan.split("ReadSchema")[1]
