"""Orphans and hierarchies against brute force on small fixtures."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lorebase.operators import hierarchy, orphans

MEM = "line_no long, id string, status string, supersedes string, updated_at timestamp, loaded_at timestamp"
EDGE = "line_no long, src string, dst string, loaded_at timestamp"
REF = "line_no long, memory_id string, loaded_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def uid(n):
    return f"00000000-0000-0000-0000-{n:012x}"


def random_archive(seed):
    r = random.Random(seed)
    at = lambda: T0 + dt.timedelta(days=r.randrange(900)) if r.random() < 0.95 else None
    ref = lambda: r.choice([None, "", "  ", uid(r.randrange(60)).upper(), "{" + uid(r.randrange(60)) + "}", "urn:uuid:" + uid(r.randrange(60)), uid(r.randrange(60)).replace("-", ""), "nobody"])
    mem = [(n, uid(r.randrange(45)), r.choice(["active", "Deleted ", "superseded", None]), ref(), at(), at()) for n in range(120)]
    edge = [(200 + n, ref(), ref(), at()) for n in range(80)]
    refs = [(300 + n, ref(), at()) for n in range(60)]
    return mem, edge, refs


def plain(x):
    if x is None or not x.strip():
        return None
    x = x.strip().lower()
    h = x.replace("urn:uuid:", "").strip("{}").replace("-", "")
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}" if len(h) == 32 else x


def brute_orphans(mem, edge, refs):
    first, newest = {}, {}
    for n, i, status, _, up, load in mem:
        if load is not None and (first.get(i) is None or load < first[i]):
            first[i] = load
        first.setdefault(i, None)
        k = (up is not None, up or T0, n)
        if i not in newest or k > newest[i][0]:
            newest[i] = (k, (status or "").strip().lower())
    rows = [("memories", m[0], "supersedes", m[3], m[5]) for m in mem]
    rows += [("memory_edges", e[0], f, v, e[3]) for e in edge for f, v in (("src", e[1]), ("dst", e[2]))]
    rows += [("memory_refs", x[0], "memory_id", x[1], x[2]) for x in refs]
    out = set()
    for t, n, f, v, load in rows:
        i = plain(v)
        if i is None:
            continue
        late = i in first and first[i] is not None and load is not None and first[i] > load
        if i not in first or newest[i][1] == "deleted" or late:
            out.add((t, n, f))
    return out


def frames(spark, mem, edge, refs):
    return {"memories": spark.createDataFrame(mem, MEM), "memory_edges": spark.createDataFrame(edge, EDGE), "memory_refs": spark.createDataFrame(refs, REF)}


def found(tracker):
    return {tuple(r) for r in tracker.orphans().select("src_table", "line_no", "ref_field").collect()}


def test_orphans_match_brute_force_however_batches_are_cut(spark):
    for seed, months, batches in ((1, 12, 3), (2, 4, 8)):
        data = random_archive(seed)
        tracker, days = orphans.track(spark, frames(spark, *data), months)
        assert found(tracker) == brute_orphans(*data)
        assert len(days) == batches == tracker.n
        # the last snapshot is what stands now, and what was settled is not among the orphans
        last = {(r.src_table, r.standing): r.n_orphans for r in tracker.snapshots().filter(f"batch_no = {batches}").collect()}
        now = tracker.refs().filter("standing <> 'ok'").groupBy("src_table", "standing").count().collect()
        assert last == {(r.src_table, r.standing): r["count"] for r in now}


def test_batches_in_any_order_and_taken_up_by_another_tracker(spark, tmp_path):
    mem, edge, refs = random_archive(3)
    # rows without a line number are told apart by what they name
    edge = [(None, *e[1:]) if n % 9 == 0 else e for n, e in enumerate(edge)]
    r = random.Random(3)
    rows = [("memories", x) for x in mem] + [("memory_edges", x) for x in edge] + [("memory_refs", x) for x in refs]
    r.shuffle(rows)
    folder = f"file://{tmp_path}/state"
    for k in range(5):
        part = [x for n, x in enumerate(rows) if n % 5 == k]
        tables = frames(spark, *([x for t, x in part if t == name] for name in ("memories", "memory_edges", "memory_refs")))
        tracker = orphans.OrphanTracker(spark, folder)
        assert tracker.n == k
        tracker.advance(tables, k + 1)
        tracker.advance(tables, k + 1)  # comes again
    assert tracker.n == 5 and tracker.refs().count() == sum(plain(v) is not None for v in [m[3] for m in mem] + [v for e in edge for v in e[1:3]] + [x[1] for x in refs])
    assert found(tracker) == brute_orphans(mem, edge, refs)


def test_parents_resolve_and_deletions_reopen(spark):
    t = orphans.OrphanTracker(spark)
    empty = spark.createDataFrame([], MEM)
    refs = spark.createDataFrame([(1, uid(7), T0)], REF)

    def standing(tables):
        t.advance(tables)
        return [r.standing for r in t.refs().collect()]

    assert standing({"memories": empty, "memory_refs": refs}) == ["absent"]
    assert standing({"memories": spark.createDataFrame([(2, uid(7), "active", None, T0, T0)], MEM)}) == ["ok"]
    assert standing({"memories": spark.createDataFrame([(3, uid(7), "DELETED", None, T0 + dt.timedelta(2), T0)], MEM)}) == ["deleted"]
    # an older version changes nothing, a newer one settles it again
    assert standing({"memories": spark.createDataFrame([(4, uid(7), "active", None, T0 + dt.timedelta(1), T0)], MEM)}) == ["deleted"]
    assert standing({"memories": spark.createDataFrame([(5, uid(7), "active", None, T0 + dt.timedelta(3), T0)], MEM)}) == ["ok"]
    counts = {(r.batch_no, r.standing): r.n_orphans for r in t.snapshots().collect()}
    assert counts == {(1, "absent"): 1, (3, "deleted"): 1, (4, "deleted"): 1}


def test_a_hot_parent_that_a_third_of_all_references_name(spark):
    n = 3000
    refs = spark.range(n).select(F.col("id").alias("line_no"), F.when(F.col("id") % 3 == 0, uid(1)).otherwise(F.format_string("00000000-0000-0000-0001-%012x", "id")).alias("memory_id"), F.lit(T0).alias("loaded_at"))
    t = orphans.OrphanTracker(spark)
    t.advance({"memories": spark.createDataFrame([], MEM), "memory_refs": refs})
    t.advance({"memories": spark.createDataFrame([(n, uid(1), "active", None, T0, T0)], MEM)})
    assert {r.standing: r["count"] for r in t.refs().groupBy("standing").count().collect()} == {"ok": 1000, "absent": 2000}


def test_a_stream_that_stops_goes_on_where_it_was(spark, tmp_path):
    from lorebase.streaming import jobs

    mem, edge, refs = random_archive(4)
    others = {k: v for k, v in frames(spark, [], edge, refs).items() if k != "memories"}
    for part in (mem[:50], mem[50:]):
        spark.createDataFrame(part, MEM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/memories.parquet")
        # each time a new stream and a new tracker on the same folder
        tracker = jobs.track_orphans(spark, jobs.stream(spark, str(tmp_path), "memories"), others, f"file://{tmp_path}/run")
    assert tracker.n == 2 and found(tracker) == brute_orphans(mem, edge, refs)


def test_columns_of_clashing_names_change_nothing(spark):
    data = frames(spark, *random_archive(5))
    odd = {n: t.selectExpr("*", *(f"'x' as {c}" for c in ("target", "standing", "was", "batch", "newest", "first_loaded", "again", "src_table", "ref_field", "ptr", "low", "p", "parent", "root", "depth", "path"))) for n, t in data.items()}
    plain, clash = (orphans.track(spark, d, 12)[0].refs() for d in (data, odd))
    assert sorted(map(str, plain.collect())) == sorted(map(str, clash.collect()))
    a, b = (hierarchy.full_hierarchy(spark, d["memories"]) for d in (data, odd))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_batches_leave_short_plan_texts_and_the_setting_as_it_was(spark):
    # Spark keeps the text of each plan; over many batches they would fill the driver's heap
    data = frames(spark, *random_archive(6))
    key, store = "spark.sql.maxPlanStringLength", spark._jsparkSession.sharedState().statusStore()
    for before in (None, "5000"):
        spark.conf.set(key, before) if before else spark.conf.unset(key)
        done = {e.executionId() for e in executions(store)}
        orphans.track(spark, data, 12)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        took = [len(e.physicalPlanDescription()) for e in executions(store) if e.executionId() not in done]
        assert len(took) > 6 and sum(n > 1000 for n in took) <= 3  # those before the first batch
        assert spark.conf.get(key, None) == before
    spark.conf.unset(key)


def test_plans_are_let_go_of_after_each_batch(spark, monkeypatch):
    data, freed = frames(spark, *random_archive(6)), []
    monkeypatch.setattr(orphans, "free_plans", lambda _: freed.append(1))
    _, days = orphans.track(spark, data, 12)
    assert len(freed) == len(days) > 1


def executions(store):
    every = store.executionsList()
    return [every.apply(n) for n in range(every.size())]


def test_orphans_of_empty_tables(spark):
    tracker, _ = orphans.track(spark, frames(spark, [], [], []))
    assert tracker.refs().count() == 0
    assert orphans.count_by_period(tracker.refs()).count() == 0 and tracker.snapshots().count() == 0


def brute_tree(parent):
    out = {}
    for i, p in parent.items():
        if p is None:
            continue
        seen, at, d = [i], p, 1
        while at not in seen and parent.get(at) is not None:
            seen.append(at)
            at, d = parent[at], d + 1
        if at in seen:
            out[i] = (min(seen[seen.index(at):]), -1)
        else:
            out[i] = (at, d)
    return out


def test_hierarchy_matches_brute_force(spark):
    for seed in (1, 2, 3):
        r = random.Random(seed)
        # a long tail into a cycle, a long chain, and random links
        parent = {uid(n): uid(r.randrange(80)) if r.random() < 0.7 else None for n in range(80)}
        parent |= {uid(100 + n): uid(101 + n) for n in range(40)} | {uid(140): uid(138)}
        parent |= {uid(200 + n): uid(201 + n) for n in range(37)} | {uid(237): None, uid(300): uid(300)}
        rows = [(n, i, "active", p, T0, T0) for n, (i, p) in enumerate(parent.items())]
        rows += [(1000, uid(0), "active", uid(5), T0 - dt.timedelta(1), T0)]  # an older version changes nothing
        m = spark.createDataFrame(rows, MEM)
        got = {x.id: (x.root, x.depth) for x in hierarchy.hierarchy(spark, m).collect()}
        assert got == brute_tree(parent)


def test_hierarchy_paths_and_descendants(spark):
    rows = [(0, uid(1), "active", None, T0, T0), (1, uid(2), "active", uid(1), T0, T0), (2, uid(3), "active", uid(2).upper(), T0, T0), (3, uid(4), "active", "unknown", T0, T0)]
    m = spark.createDataFrame(rows, MEM)
    full = {r.id: r for r in hierarchy.full_hierarchy(spark, m).collect()}
    assert full[uid(3)].path == "/".join([uid(1), uid(2), uid(3)]) and full[uid(3)].depth == 2
    assert full[uid(1)].n_descendants == 2 and full[uid(1)].root == uid(1) and full[uid(4)].depth == 0
    assert {tuple(r) for r in hierarchy.descendants(spark, m).collect()} == {(uid(1), uid(2), 1), (uid(1), uid(3), 2), (uid(2), uid(3), 1)}
    assert hierarchy.hierarchy(spark, m.limit(0)).count() == 0
