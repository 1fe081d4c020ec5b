"""What must not end a job, and operators that SQL does not compare."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.functions import jsonx, secrets, text, time
from lorebase.functions.math import scaled
from lorebase.operators import evaluation, models, search, sessions, similar
from lorebase.session import Scratch, spread_last
from lorebase.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def one(spark, values, f, kind="string"):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v")).alias("x")).collect()]


def test_numbers_beyond_their_type_are_no_versions_and_no_counts(spark):
    assert one(spark, ["1.2.3", "99999999999.1.1", "99999999999999999999.1.1", None], lambda c: text.semver(c)["major"]) == [1, 99999999999, None, None]
    s = spark.createDataFrame([(1, "Session summary: 99999999999 requests"), (2, "Session summary: 3 requests")], "session_no int, session string")
    assert {r.session_no: r.n_requests_said for r in sessions.parse(s).collect()} == {1: None, 2: 3}


def test_a_repeated_key_counts_with_its_last_value(spark):
    got = one(spark, ['{"a":1,"b":2,"a":3}', '{"a":"x"}', "no json", None], lambda c: jsonx.to_object(jsonx.merge(jsonx.as_map(c), F.create_map(F.lit("by"), F.lit("me")))))
    assert got == ['{"a":"3","b":"2","by":"me"}', '{"a":"x","by":"me"}', '{"by":"me"}', '{"by":"me"}']


def test_the_last_value_before_each_row_with_null_keys_and_one_hot_key(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "a", None]), T0 + dt.timedelta(hours=r.randrange(400)) if r.random() < 0.9 else None, n, r.choice([None, "x", "y"])) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, at timestamp, n int, v string").withColumn("day", F.to_date("at"))
    plain = F.last("v", ignorenulls=True).over(Window.partitionBy("k").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1))
    assert {tuple(x) for x in spread_last(df, ["k"], "day", ["at", "n"], "v", "b").select("n", "b").collect()} == {tuple(x) for x in df.select("n", plain.alias("b")).collect()}
    assert spread_last(df.limit(0), ["k"], "day", ["at", "n"], "v", "b").count() == 0


def test_updates_of_two_micro_batches_are_all_kept(spark, tmp_path):
    kind = "session_id string, project string, loaded_at timestamp, session_no long"
    for part in ([("s1", "p", T0, 1), ("s2", "q", T0, 2)], [("s1", "p", T0, 3), ("s3", None, T0, 4)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/sessions.parquet")
    s = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/sessions.parquet")
    got = jobs.run_updates(jobs.bind_first(s, "session_id", "project", ["loaded_at", "session_no"]), ["session_id"], Scratch(spark, "t"), "bind")
    assert {tuple(r) for r in got.collect()} == {("s1", "p", 2), ("s2", "q", 1)}


def test_late_rows_of_a_window_are_dropped(spark, tmp_path):
    for part in ([(T0, "a"), (T0 + dt.timedelta(days=5), "a")], [(T0 + dt.timedelta(days=6), "a")], [(T0 + dt.timedelta(minutes=5), "a"), (T0 + dt.timedelta(days=9), "b")]):
        spark.createDataFrame(part, "ts timestamp, k string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e.parquet")
    s = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/e.parquet")
    w = jobs.windowed_counts(s, "ts", "k", "1 hour", "1 day").select(F.col("window.start").alias("start"), "k", "n")
    got = {(r.start, r.n) for r in jobs.run_to_table(w, Scratch(spark, "t"), "w").collect()}
    # the first window was closed before its second row came
    assert (T0, 1) in got and (T0, 2) not in got


def _pool(spark):
    kind = "id string, scope string, mem_type string, content string, created_at timestamp, status string, expires_at timestamp, vec array<double>"
    docs = spark.createDataFrame([(f"d{n}", "user", "semantic", f"alpha word{n}", T0, "active", None, [1.0, float(n)]) for n in range(4)], kind)
    asked = spark.createDataFrame([("q", "alpha word2", "user", [1.0, 2.0])], "query_id string, text string, scope string, vec array<double>")
    edges = spark.createDataFrame([("d0", "d3", "related", 1.0)], "src string, dst string, relation string, weight double")
    refs = spark.createDataFrame([], "memory_id string, path string, symbol string, state string")
    return asked, docs, edges, refs


def test_a_reranker_can_be_plugged_in_and_may_fail(spark):
    parts = _pool(spark)
    raw = search.pipeline(spark, *parts, most=2.0, at=F.lit(T0), score=lambda q, ts: [float(5 - int(t[-1])) for t in ts]).orderBy("place").collect()
    assert [r.id for r in raw] == ["d0", "d1", "d2", "d3"] and math.isclose(raw[0].score, 1 / (1 + math.exp(-5)), abs_tol=1e-6) and all(r.reranked for r in raw)

    def broken(q, ts):
        raise OSError("no model")

    plain = search.pipeline(spark, *parts, most=2.0, at=F.lit(T0), rerank=False).orderBy("place").collect()
    for bad in (broken, lambda q, ts: [0.1], lambda q, ts: [float("nan")] * len(ts)):
        got = search.pipeline(spark, *parts, most=2.0, at=F.lit(T0), score=bad).orderBy("place").collect()
        assert [(r.id, r.score, r.reranked) for r in got] == [(r.id, r.score, False) for r in plain]
    assert models.scaled(__import__("numpy").array([0.2, 1.0])).tolist() == [0.2, 1.0]


def test_vectors_of_different_models_are_not_compared(spark):
    asked, docs, _, _ = _pool(spark)
    named = docs.withColumn("embedding_model", F.when(F.col("id") == "d1", "m2").otherwise("m1"))
    got = search.vector(asked.withColumn("embedding_model", F.lit("m1")), named, 10, 2.0)
    assert {r.id for r in got.collect()} == {"d0", "d2", "d3"}
    with pytest.raises(ValueError):
        search.vector(asked, named, 10)


def test_duplicates_of_one_type_and_at_a_time(spark):
    kind = "id string, scope string, mem_type string, content string, status string, created_at timestamp, expires_at timestamp"
    m = spark.createDataFrame([("a", "user", "semantic", "Same.", "active", T0, None), ("b", "user", "project", "same", "active", T0 + dt.timedelta(1), None), ("c", "user", "semantic", "same", "active", T0 + dt.timedelta(2), T0 + dt.timedelta(3))], kind)
    new = m.filter("id = 'a'")
    got = lambda **k: [r.id for r in similar.find_duplicate(m, new, **k).collect()]
    late, early = F.lit(T0 + dt.timedelta(9)), F.lit(T0)
    assert got(at=late) == ["b"] and got(at=early) == ["c"] and got(at=late, same_type=True) == [] and got(at=early, same_type=True) == ["c"]


def test_secrets_in_nested_json(spark):
    key = "ghp_" + "a" * 36
    rows = [(1, f'{{"a": {{"b": ["x", "token {key}"]}}, "n": 1}}'), (2, '{"client-secret": {"v": "long enough value"}, "ok": "short"}'), (3, '{"plain": true}'), (4, "no json"), (5, None), (6, f'{{"{key}": 1}}')]
    got = {r.id: (r.redacted, r.found) for r in secrets.redact_json(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()}
    assert got[1] == ('{"a": {"b": ["x", "token [REDACTED:github-token]"]}, "n": 1}', ["github-token"])
    assert got[2] == ('{"client-secret": {"v": "[REDACTED:named]"}, "ok": "short"}', ["named"])
    assert got[3] == ('{"plain": true}', []) and got[4] == (None, []) and got[5] == (None, []) and got[6][1] == ["github-token"]


def test_lists_turn_lines_and_calendar_words(spark):
    assert one(spark, ["a, b ,,c", "", None], text.split_list) == [["a", "b", "c"], [], []]
    line = "[1:56 pm on 8 May, 2023, session 3, D3:12] Ann: hello: you\nthere"
    got = one(spark, [line, "plain"], text.turn_line)
    assert tuple(got[0]) == ("1:56 pm on 8 May, 2023", 3, "D3:12", "Ann", "hello: you\nthere") and got[1] is None
    said = one(spark, ["It was two weeks ago, not about three days ago; 12 days ago or so. Last Friday it rained; yesterday no."], time.calendar_expressions)
    assert said == [["two weeks ago", "last friday", "yesterday"]]
    day = spark.createDataFrame([("two weeks ago",), ("twelve days ago",), ("99999 days ago",)], "e string").withColumn("d", F.lit("2024-02-20").cast("date"))
    m = time.calendar_meaning(F.col("e"), F.col("d"))
    assert [(str(r.a), r.b) for r in day.select(m["first"].alias("a"), m["approximate"].alias("b")).collect()] == [("2024-02-06", True), ("2024-02-08", False), ("None", None)]


def test_parts_and_runs_of_scores(spark):
    df = spark.createDataFrame([(1, "red apple, green pear", "pear green, an apple"), (2, "x", "")], "k int, g string, a string")
    got = {r.k: r.f1 for r in evaluation.parts_f1(df, "k", F.col("g"), F.col("a")).collect()}
    assert math.isclose(got[1], (2 / 3 + 1) / 2, abs_tol=1e-6) and got[2] == 0
    runs = spark.createDataFrame([("a", 0.5), ("a", 1.0), (None, 2.0), (None, 0.5)], "m string, s double")
    assert sorted(round(r.o, 4) for r in scaled(runs, ["m"], "s", "o").collect()) == [0.5, 0.6225, 0.8808, 1.0]
