"""Formatting duplicates, survivors and groups against brute force."""

import datetime as dt
import itertools
import json
import random
import re

from pyspark.sql import functions as F

from lorebase.llm import components, formatting, survivors
from lorebase.session import Scratch

MEM = "line_no long, mem_type string, scope string, content string, extra string"
T0 = dt.datetime(2024, 1, 1)


def words(s):
    return " ".join(re.findall(r"[^\W_]+", s.lower()))


def canon(c):
    if c is None or not c.strip(" \n\t​﻿ "):
        return None
    if c.strip().startswith("{"):
        try:
            o = json.loads(c)
            return ("j", tuple(sorted((words(k), words(str(v) if not isinstance(v, str) else v)) for k, v in o.items())))
        except ValueError:
            pass
    items = [x for x in re.split(r"[;\r\n]+", c) if x.strip(" ")]
    if len(items) >= 2 and all(re.match(r"[^=]*\w[^=]*=", x) for x in items):
        return ("i", tuple(sorted(tuple(words(p) for p in x.split("=", 1)) for x in items)))
    return ("t", words(c))


def messy(r):
    base = r.choice(["Use tabs over spaces.", "port=80; env=prod; name=a b", '{"port": 80, "env": "prod"}', "한국어 문장", "x = y", "a=1", "...", "{broken"])
    if base.startswith('{"') and r.random() < 0.7:
        return r.choice(['{"env":"PROD","port":80}', '{ "port" : 80 ,\n"env" : "prod" }', '{"port": 81, "env": "prod"}'])
    if base.startswith("port") and r.random() < 0.7:
        return r.choice(["env = prod\nport=80\nname= A  B", "name=a b;env=prod;port=80", "port=80; env=prod; name=b a"])
    return r.choice([base, base.upper(), f"  {base} ", base.replace(" ", "  "), f"«{base}»", base + "!!"])


def test_copies_match_brute_force(spark):
    r = random.Random(1)
    rows = [(n, r.choice(["a", "b", None]), r.choice(["user", "USER ", "project:x/y", None]), r.choice([messy(r), messy(r), None, "", " \n", f"unique {n}"]), "x") for n in range(400)]
    df = spark.createDataFrame(rows, MEM).repartition(5)
    groups = {}
    for n, t, s, c, _ in rows:
        if canon(c) is not None:
            groups.setdefault((t, words(s or ""), canon(c)), []).append(n)
    want = {(min(g), n) for g in groups.values() for n in g if n != min(g)}
    assert {tuple(x) for x in formatting.copies(spark, df).collect()} == want
    whole = {tuple(x) for x in formatting.collapsed(spark, df).collect()}
    assert whole == {(min(g), len(g)) for g in groups.values()} | {(n, 1) for n, _, _, c, _ in rows if canon(c) is None}


def test_one_group_of_a_third_and_no_rows(spark):
    rows = spark.range(900).select(F.col("id").alias("line_no"), F.lit("t").alias("mem_type"), F.lit("user").alias("scope"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("u"), "id")).alias("content"))
    assert formatting.copies(spark, rows).count() == 299
    assert formatting.copies(spark, rows.limit(0)).count() == 0
    assert formatting.collapsed(spark, rows.limit(0)).count() == 0


def _marked(spark, h, monkeypatch, segments_at_once):
    monkeypatch.setattr(formatting, "RANGE_SEGMENTS", segments_at_once)
    n = h.count()
    prints = h.select(F.monotonically_increasing_id().alias("line_no"), F.col("h").cast("string").cast("binary").alias("fp"), "h")
    marked = formatting.mark_possible_repeats(Scratch(spark, "t"), prints, n)
    return marked.join(prints.groupBy("fp").agg(F.count("*").alias("n")), "fp").agg(
        F.count_if(F.expr("n > 1 and not maybe")).alias("lost"), F.avg(F.when(F.col("n") == 1, F.col("maybe").cast("int"))).alias("in_vain"), F.count("*").alias("all")
    ).first(), n


def test_filter_never_loses_a_repeat(spark, monkeypatch):
    h = spark.range(3000).select(F.xxhash64("id").alias("h"))
    got, n = _marked(spark, h.unionByName(h.limit(500)).repartition(6), monkeypatch, 512)
    assert got.lost == 0 and got["all"] == n and got.in_vain < 0.05


def test_singletons_stay_put_at_a_hundred_times_the_rows(spark, monkeypatch):
    """15,000 rows fill one segment; 1,500,000 take 23 of them, in six ranges of four."""
    for rows in (15_000, 1_500_000):
        h = spark.range(rows).select(F.xxhash64(F.when(F.col("id") % 20 == 0, F.col("id") - F.col("id") % 200).otherwise(F.col("id"))).alias("h"))
        got, n = _marked(spark, h, monkeypatch, 4)
        assert got.lost == 0 and got["all"] == n and got.in_vain < 0.05
    assert formatting.segments_for(10**11) == -(-(10**11) * formatting.BITS_A_ROW // formatting.SEGMENT_BITS)


def uid(n):
    return f"00000000-0000-0000-0000-{n:012x}"


def test_survivors_match_brute_force(spark):
    r = random.Random(4)
    mem, newest = [], {}
    for n in range(300):
        i = r.randrange(60)
        row = (
            n, uid(i), r.choice(["active", "deleted", "ACTIVE "]), r.choice(["user", "Agent", " external", "model", None]), r.choice([0.5, 0.9, None, float("nan"), 1.5, -1.0, 0.9]),
            r.choice([None, "", "N/A", "ses-1", "ses-2", " unknown "]), r.choice([None, "commit:a", "-"]), r.choice([None, T0]), r.choice([None, T0]),
            r.choice([None, T0 + dt.timedelta(days=r.randrange(9))]), T0 + dt.timedelta(days=r.randrange(9)), T0 + dt.timedelta(days=r.randrange(5)),
        )
        mem.append(row)
        if i not in newest or (row[10], n) > (newest[i][10], newest[i][0]):
            newest[i] = row
    prop = [(f"p{k}", r.choice(["duplicate", "DUPLICATE", "conflict"]), [r.choice([uid(r.randrange(70)), uid(r.randrange(70)).upper(), None, "x"]) for _ in range(r.randrange(7))]) for k in range(80)]
    prop += prop[:5] + [("none", "duplicate", None)]
    want = set()
    for pid, kind, ids in prop:
        if kind.lower() != "duplicate":
            continue
        ms = [newest[i] for i in {int(x[-12:], 16) for x in ids or [] if x and x != "x"} if i in newest and newest[i][2].strip().lower() != "deleted"]

        def order(m):
            sure = m[4] if m[4] is not None and 0 <= m[4] <= 1 else -1
            recent = m[9] if m[9] is not None and m[9] <= m[11] else dt.datetime.min
            return ({"user": 0, "agent": 1, "external": 2}.get((m[3] or "").strip().lower(), 3), -sure, -(recent - dt.datetime.min).total_seconds(), m[1])

        ms.sort(key=order)
        none = ("", "n/a", "unknown", "-")
        for f, has in (("keep_id", lambda m: True), ("source_session", lambda m: m[5] and m[5].strip().lower() not in none), ("evidence_uri", lambda m: m[6] and m[6] not in none), ("valid_from", lambda m: m[7]), ("valid_to", lambda m: m[8])):
            got = next((m for m in ms if has(m)), None)
            if got:
                want.add((pid, f, got[1]))
    m = spark.createDataFrame(mem, "line_no long, id string, status string, trust string, confidence double, source_session string, evidence_uri string, valid_from timestamp, valid_to timestamp, created_at timestamp, updated_at timestamp, loaded_at timestamp")
    p = spark.createDataFrame(prop, "proposal_id string, kind string, member_ids array<string>")
    assert {(x.proposal_id, x.field_name, x.member_id) for x in survivors.providers(p, m).collect()} == want
    assert survivors.providers(p.limit(0), m).count() == 0 and survivors.survivors(p, m.limit(0)).count() == 0


def _ahead(a, b):
    """Whether (level, sure, recent, id) a dominates b."""
    return a[0] <= b[0] and a[1] >= b[1] and a[2] >= b[2] and (a[:3] != b[:3] or a[3] < b[3])


def test_skyline_matches_pairwise_dominance(spark):
    r = random.Random(6)
    rows = [(k, f"m{n}", r.randrange(4), float(r.randrange(4)), r.randrange(5)) for k in range(3) for n in range(40)]
    df = spark.createDataFrame(rows, "k int, mem_id string, level int, sure double, recent long")
    want = {b[:2] for b in rows if not any(a[0] == b[0] and _ahead((*a[2:], a[1]), (*b[2:], b[1])) for a in rows)}
    for part in (1, 1000):  # every group cut into parts, and none
        flagged = survivors.flag_undominated(Scratch(spark, "t"), df, ["k"], part)
        assert {(x.k, x.mem_id) for x in flagged.filter("top").collect()} == want
        assert flagged.count() == len(rows)


def test_a_group_of_a_third_of_all_rows_whose_members_do_not_dominate_each_other(spark):
    n = 3000
    hot = spark.range(n).select(F.lit("hot").alias("k"), F.format_string("m%06d", "id").alias("mem_id"), F.lit(1).alias("level"), (F.col("id") / n).alias("sure"), (n - F.col("id")).alias("recent"))
    rest = spark.range(2 * n).select(F.format_string("k%d", F.floor(F.col("id") / 2)).alias("k"), F.format_string("m%06d", "id").alias("mem_id"), F.lit(1).alias("level"), (F.col("id") % 2 / 2).alias("sure"), F.col("id").alias("recent"))
    flagged = survivors.flag_undominated(Scratch(spark, "t"), hot.unionByName(rest), ["k"], part=100)
    got = {x.k: x.n for x in flagged.filter("top").groupBy((F.col("k") == "hot").alias("k")).agg(F.count("*").alias("n")).collect()}
    assert got == {True: n, False: n}


def test_layers_are_peeled_and_at_most_one_a_field(spark):
    r = random.Random(8)
    fields = survivors.FIELDS
    rows = [(f"p{k}", f"m{n}", r.randrange(4), float(r.randrange(3)), r.randrange(4), *((f"m{n}",) + tuple(r.choice([None, None, "v"]) for _ in fields[1:]))) for k in range(20) for n in range(12)]
    df = spark.createDataFrame(rows, "proposal_id string, mem_id string, level int, sure double, recent long, " + ", ".join(f"{f} string" for f in fields))
    scratch = Scratch(spark, "t")
    front = scratch.keep(survivors.fronts(scratch, df))
    got = {(x.proposal_id, x.mem_id): x.layer for x in survivors.layers(scratch, front).collect()}
    want = {}
    for p in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == p]
        key = lambda x: (*x[2:5], x[1])
        left = {x for j in range(len(fields)) for x in own if x[5 + j] and not any(y[5 + j] and _ahead(key(y), key(x)) for y in own)}
        n = 0
        while left:
            n += 1
            top = {x for x in left if not any(_ahead(key(y), key(x)) for y in left)}
            want |= {(p, x[1]): n for x in top}
            left -= top
    assert got == want and 1 < max(want.values()) <= len(fields)


def brute_groups(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {(find(x), x) for x in list(parent)}


def test_components_match_union_find(spark):
    for seed, n in ((1, 60), (2, 200), (3, 90)):
        r = random.Random(seed)
        links = [(f"v{r.randrange(n):03d}", f"v{r.randrange(n):03d}") for _ in range(int(n * 0.6))] + [(None, "v001"), ("v002", "v002")]
        links += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("hub", f"h{i:03d}") for i in range(80)]
        df = spark.createDataFrame(links, "u string, v string")
        assert {tuple(x) for x in components.connected(spark, df).collect()} == brute_groups(links)


def test_complete_group_and_no_links(spark):
    links = list(itertools.combinations([f"k{i:02d}" for i in range(12)], 2))
    df = spark.createDataFrame(links, "u string, v string")
    assert {tuple(x) for x in components.connected(spark, df).collect()} == {("k00", f"k{i:02d}") for i in range(12)}
    assert components.connected(spark, df.limit(0)).count() == 0


def test_links_of_pairs_and_proposals(spark):
    pairs = spark.createDataFrame([(uid(1), uid(2).upper(), "same"), (uid(3), uid(4), "distinct"), (None, uid(5), "same")], "a_id string, b_id string, relation string")
    prop = spark.createDataFrame([("duplicate", "pending", [uid(9), uid(2), None, uid(9)]), ("duplicate", "stale", [uid(7), uid(8)]), ("digest", "pending", [uid(7), uid(8)]), ("duplicate", "applied", None)], "kind string, status string, member_ids array<string>")
    assert {tuple(x) for x in components.groups(spark, pairs, prop).collect()} == {(uid(1), uid(1)), (uid(1), uid(2)), (uid(1), uid(9))}


def test_columns_of_clashing_names_change_nothing(spark, sf):
    from lorebase.llm import mixing
    from lorebase.sources.tables import table

    names = ("fp", "h", "key", "maybe", "first_line_no", "n_copies", "u", "v", "low", "least", "stays", "group_id", "mem_id", "level", "sure", "recent", "value", "f", "bucket", "before", "quota", "rounds", "n_tokens", "repeat", "slot", "block", "share", "most")

    def odd(t):
        return t.selectExpr("*", *(f"'x' as {c}" for c in names if c not in t.columns))

    m, p, q, d, g = (table(spark, sf, n) for n in ("memories", "proposals", "match_pairs", "documents", "mix_targets"))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(formatting.copies(spark, m), formatting.copies(spark, odd(m)))
    assert same(survivors.providers(p, m), survivors.providers(odd(p), odd(m)))
    assert same(components.groups(spark, q, p), components.groups(spark, odd(q), odd(p)))
    assert same(mixing.mix(spark, d, g)[0], mixing.mix(spark, odd(d), odd(g))[0])
