"""Registered queries over references and hierarchies (problems 1 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators import hierarchy, orphans
from lorebase.sources.tables import table


def _archive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in ("memories", "memory_edges", "memory_refs")}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    tracker, _ = orphans.track(spark, _archive(spark, folder))
    return tracker.orphans().select("src_table", "line_no", "ref_field")


def p1_by_period(spark: SparkSession, folder: str) -> DataFrame:
    tracker, _ = orphans.track(spark, _archive(spark, folder))
    return orphans.count_by_period(tracker.orphans())


def p1_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Open references at the end of each month of arrivals."""
    tracker, days = orphans.track(spark, _archive(spark, folder))
    period = F.element_at(F.array(*(F.lit(d) for d in days)), F.col("batch_no"))
    return tracker.snapshots().select(period.alias("period"), "src_table", "standing", "n_orphans")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = hierarchy.hierarchy(spark, table(spark, folder, "memories"))
    return found.select(F.col("id").alias("mem_id"), F.col("root").alias("root_id"), "depth")


def p6_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.full_hierarchy(spark, table(spark, folder, "memories"))


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(spark, table(spark, folder, "memories"))


QUERIES = {f.__name__: f for f in (p1_found, p1_by_period, p1_snapshots, p6_found, p6_hierarchy, p6_descendants)}

def cid(col: str) -> str:
    """DuckDB text for the canonical spelling of an id."""
    plain = f"lower(regexp_replace({col}, '^\\s+|\\s+$', '', 'g'))"
    hexes = f"regexp_replace(regexp_replace({plain}, '^\\{{?(urn:uuid:)?\\{{?', ''), '[-}}]', '', 'g')"
    parts = " || '-' || ".join(f"substr({hexes}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"CASE WHEN {plain} = '' THEN NULL WHEN regexp_matches({hexes}, '^[0-9a-f]{{32}}$') THEN {parts} ELSE {plain} END"


_PARENTS = f"""parents AS (SELECT id, min(loaded_at) first_loaded, arg_max(st, k) st FROM (
  SELECT {cid('id')} id, loaded_at, coalesce(lower(trim(status)), '') st, (epoch_us(updated_at)::HUGEINT * 1000000000 + line_no) k FROM memories) GROUP BY id)"""
_REFS = "refs AS (" + " UNION ALL ".join(
    f"SELECT '{t}' src_table, line_no, '{f}' ref_field, {cid(f)} target, loaded_at FROM {t}" for t, f in orphans.REFERENCES
) + ")"
JUDGED = f"""WITH {_PARENTS}, {_REFS}, judged AS (SELECT r.*, CASE WHEN p.id IS NULL THEN 'absent' WHEN p.st = 'deleted' THEN 'deleted'
  WHEN p.first_loaded > r.loaded_at THEN 'late' ELSE 'ok' END standing FROM refs r LEFT JOIN parents p ON r.target = p.id WHERE r.target IS NOT NULL)"""
_LINKS = f"""nodes AS (SELECT id, arg_max(coalesce(p, ''), k) p FROM (
  SELECT {cid('id')} id, {cid('supersedes')} p, (epoch_us(updated_at)::HUGEINT * 1000000000 + line_no) k FROM memories) GROUP BY id),
links AS (SELECT n.id, n.p FROM nodes n WHERE n.p IN (SELECT id FROM nodes)),
up AS (SELECT id, p here, 1 d, [id] seen, [p] path, (p = id) cyc FROM links
  UNION ALL SELECT u.id, l.p, u.d + 1, list_append(u.seen, u.here), list_append(u.path, l.p), (list_contains(u.seen, l.p) OR l.p = u.here)
  FROM up u JOIN links l ON l.id = u.here WHERE NOT u.cyc),
fin AS (SELECT id, arg_max(here, d) here, max(d) d, arg_max(seen, d) seen, arg_max(path, d) path, bool_or(cyc) cyc FROM up GROUP BY id),
found AS (SELECT id, CASE WHEN cyc THEN list_min(list_slice(seen, list_position(seen, here), len(seen))) ELSE here END root,
  CASE WHEN cyc THEN -1 ELSE d END::BIGINT depth, path, cyc FROM fin)"""

_STANDING = "CASE WHEN p.id IS NULL THEN 'absent' WHEN p.st = 'deleted' THEN 'deleted' WHEN p.first_loaded > r.loaded_at THEN 'late' ELSE 'ok' END"
# what had arrived by the end of each month; what has no time comes with the last
_BY_MONTH = f"""WITH {_REFS}, months AS (SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) m, date_trunc('month', hi) last
  FROM (SELECT min(loaded_at) lo, max(loaded_at) hi FROM (SELECT loaded_at FROM memories UNION ALL SELECT loaded_at FROM memory_edges UNION ALL SELECT loaded_at FROM memory_refs))),
vers AS (SELECT {cid('id')} id, loaded_at, coalesce(lower(trim(status)), '') st, (epoch_us(updated_at)::HUGEINT * 1000000000 + line_no) k FROM memories),
pm AS (SELECT m, id, min(loaded_at) first_loaded, arg_max(st, k) st FROM months JOIN vers ON loaded_at < m + INTERVAL 1 MONTH OR (loaded_at IS NULL AND m = last) GROUP BY m, id),
rm AS (SELECT m, r.* FROM months JOIN refs r ON r.loaded_at < m + INTERVAL 1 MONTH OR (r.loaded_at IS NULL AND m = last) WHERE r.target IS NOT NULL),
jm AS (SELECT r.m, r.src_table, {_STANDING} standing FROM rm r LEFT JOIN pm p ON p.id = r.target AND p.m = r.m)"""

ORACLE = {
    "p1_snapshots": f"{_BY_MONTH} SELECT strftime(m, '%Y-%m-%d') period, src_table, standing, count(*) n_orphans FROM jm WHERE standing <> 'ok' GROUP BY ALL",
    "p1_found": f"{JUDGED} SELECT src_table, line_no, ref_field FROM judged WHERE standing <> 'ok'",
    "p1_by_period": f"{JUDGED} SELECT src_table, ref_field, strftime(date_trunc('month', loaded_at), '%Y-%m-%d') period, standing, count(*) n_orphans FROM judged WHERE standing <> 'ok' GROUP BY ALL",
    "p6_found": f"WITH RECURSIVE {_LINKS} SELECT id mem_id, root root_id, depth FROM found",
    "p6_hierarchy": f"""WITH RECURSIVE {_LINKS}, below AS (SELECT a id, count(*) n FROM (SELECT unnest(path) a FROM found WHERE NOT cyc) GROUP BY a)
SELECT n.id, coalesce(f.root, n.id) root, coalesce(f.depth, 0)::BIGINT depth, CASE WHEN NOT coalesce(f.cyc, false) THEN array_to_string(list_append(list_reverse(coalesce(f.path, [])), n.id), '/') END path,
  coalesce(b.n, 0) n_descendants, coalesce(f.cyc, false) is_cycle FROM nodes n LEFT JOIN found f USING (id) LEFT JOIN below b USING (id)""",
    "p6_descendants": f"WITH RECURSIVE {_LINKS} SELECT unnest(path) ancestor, id descendant, unnest(range(1, len(path) + 1)) distance FROM found WHERE NOT cyc",
}
