"""The typed views as SQL text, for the twins of registered queries."""

from lorebase.plans.hygiene import cid

_SCOPE = "regexp_replace(regexp_replace(lower(scope), '\\s+', '', 'g'), '/+', '/', 'g')"
AS_OF = "TIMESTAMPTZ '2026-01-01 00:00:00+00'"

MEM = f"""mem AS (SELECT * EXCLUDE (rn) FROM (SELECT {cid('id')} id, line_no, mem_type, {_SCOPE} scope, content, attrs, source_agent, source_session, evidence_uri,
  lower(trim(trust)) trust, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END confidence, lower(trim(status)) status, {cid('supersedes')} supersedes,
  valid_from, valid_to, expires_at, least(created_at, loaded_at) created_at, updated_at,
  row_number() OVER (PARTITION BY {cid('id')} ORDER BY updated_at DESC NULLS LAST, line_no DESC) rn FROM memories) WHERE rn = 1 AND id IS NOT NULL)"""
EDGE = f"""edge AS (SELECT src, relation, dst, max(weight) weight, min(created_at) created_at FROM (SELECT {cid('src')} src, {cid('dst')} dst, relation, weight, created_at FROM memory_edges)
  WHERE src <> dst AND relation IS NOT NULL GROUP BY ALL)"""
REF = f"""ref AS (SELECT * EXCLUDE (rn) FROM (SELECT {cid('memory_id')} memory_id, coalesce(path, '') path, coalesce(symbol, '') symbol, line_no, {_SCOPE} scope, state, resolved_path, anchor_hash,
  anchor_commit, checked_commit, checked_at, created_at, row_number() OVER (PARTITION BY {cid('memory_id')}, coalesce(path, ''), coalesce(symbol, '') ORDER BY line_no DESC) rn FROM memory_refs)
  WHERE rn = 1 AND memory_id IS NOT NULL)"""
PROP = f"""prop AS (SELECT * EXCLUDE (rn) FROM (SELECT proposal_id, list_sort(list_distinct(list_filter(list_transform(member_ids, lambda x: {cid('x')}), lambda y: y IS NOT NULL))) member_ids,
  kind, scope, {cid('keep_id')} keep_id, content, reason, model, status, {cid('result_id')} result_id, decided_by, decided_at, created_at, updated_at,
  row_number() OVER (PARTITION BY proposal_id ORDER BY updated_at DESC) rn FROM proposals) WHERE rn = 1)"""
LIVE = f"live AS (SELECT * FROM mem WHERE status = 'active' AND (expires_at IS NULL OR expires_at > {AS_OF}))"
STALE = "stale AS (SELECT DISTINCT memory_id id FROM ref WHERE state = 'missing' OR (state = 'changed' AND symbol <> ''))"


def with_views(*views: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(views) + "\n"
