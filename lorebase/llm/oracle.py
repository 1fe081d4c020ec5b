"""SQL twins of the registered queries."""

from __future__ import annotations


def _id(col: str) -> str:
    plain = f"lower(regexp_replace({col}, '^\\s+|\\s+$', '', 'g'))"
    hexes = f"regexp_replace(regexp_replace({plain}, '^\\{{?(urn:uuid:)?\\{{?', ''), '[-}}]', '', 'g')"
    parts = " || '-' || ".join(f"substr({hexes}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"CASE WHEN {plain} = '' THEN NULL WHEN regexp_matches({hexes}, '^[0-9a-f]{{32}}$') THEN {parts} ELSE {plain} END"


def _words(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_CANON = f"""rows AS (SELECT line_no, coalesce(mem_type, '?') t, {_words("coalesce(scope, '')")} s, content c,
  CASE WHEN regexp_matches(content, '^\\s*\\{{') AND json_valid(content) THEN content END j,
  list_filter(regexp_split_to_array(content, '[;\\r\\n]+'), lambda x: trim(x) <> '') items
  FROM memories WHERE NOT regexp_matches(content, '^[\\s\\p{{Z}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]*$')),
canon AS (SELECT line_no, t, s, CASE WHEN j IS NOT NULL THEN 'j:' || list_aggregate(list_sort(list_transform(json_keys(j),
    lambda k: {_words('k')} || '=' || {_words("coalesce(json_extract_string(j, '$.\"' || k || '\"'), 'null')")})), 'string_agg', ';')
  WHEN len(items) >= 2 AND list_bool_and(list_transform(items, lambda x: regexp_matches(x, '^[^=]*\\w[^=]*=')))
  THEN 'i:' || list_aggregate(list_sort(list_transform(items, lambda x: {_words("regexp_extract(x, '^([^=]*)=', 1)")} || '=' || {_words("regexp_replace(x, '^[^=]*=', '')")})), 'string_agg', ';')
  ELSE 't:' || {_words('c')} END k FROM rows)"""

_NONE = "('none','null','n/a','na','nil','unknown','undefined','nan','tbd','-','--','?','')"


def _val(c: str) -> str:
    return f"CASE WHEN lower(trim({c}::VARCHAR)) NOT IN {_NONE} THEN {c}::VARCHAR END"


_NEWEST = f"""newest AS (SELECT * FROM (SELECT {_id('id')} mid, lower(trim(status)) st, lower(trim(trust)) tr, confidence cf, created_at cr, loaded_at la,
  {_val('source_session')} source_session, {_val('evidence_uri')} evidence_uri,
  valid_from, valid_to, row_number() OVER (PARTITION BY {_id('id')} ORDER BY updated_at DESC NULLS LAST, line_no DESC) rn FROM memories) WHERE rn = 1 AND st IS DISTINCT FROM 'deleted'),
named AS (SELECT DISTINCT proposal_id, {_id('m')} mid FROM (SELECT proposal_id, unnest(member_ids) m FROM proposals WHERE lower(trim(kind)) = 'duplicate')),
keyed AS (SELECT proposal_id, n.*, CASE tr WHEN 'user' THEN 0 WHEN 'agent' THEN 1 WHEN 'external' THEN 2 ELSE 3 END lv,
  CASE WHEN cf >= 0 AND cf <= 1 THEN cf ELSE -1 END sure, CASE WHEN cr > la OR cr IS NULL THEN -9e18::BIGINT ELSE epoch_us(cr) END recent FROM named JOIN newest n USING (mid)),
fields AS (SELECT *, 'keep_id' f, mid v FROM keyed UNION ALL SELECT *, 'source_session', source_session FROM keyed UNION ALL SELECT *, 'evidence_uri', evidence_uri FROM keyed
  UNION ALL SELECT *, 'valid_from', valid_from::TIMESTAMP::VARCHAR FROM keyed UNION ALL SELECT *, 'valid_to', valid_to::TIMESTAMP::VARCHAR FROM keyed)"""

_AHEAD = "(a.lv <= b.lv AND a.sure >= b.sure AND a.recent >= b.recent AND (a.lv < b.lv OR a.sure > b.sure OR a.recent > b.recent OR a.mid < b.mid))"
_LAYERS = f"""front AS (SELECT DISTINCT proposal_id, f, mid, lv, sure, recent, v FROM fields b WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fields a WHERE a.v IS NOT NULL AND a.proposal_id = b.proposal_id AND a.f = b.f AND {_AHEAD})),
u1 AS (SELECT DISTINCT proposal_id, mid, lv, sure, recent FROM front),
""" + ",\n".join(
    f"l{n} AS (SELECT * FROM u{n} b WHERE NOT EXISTS (SELECT 1 FROM u{n} a WHERE a.proposal_id = b.proposal_id AND {_AHEAD})), u{n + 1} AS (SELECT * FROM u{n} EXCEPT SELECT * FROM l{n})" for n in range(1, 6)
) + ",\nlayered AS (" + " UNION ALL ".join(f"SELECT proposal_id, mid, {n}::INT layer FROM l{n}" for n in range(1, 6)) + """),
won AS (SELECT proposal_id, f, arg_min((mid, v, layer), (lv, -sure, -recent::HUGEINT, mid)) w FROM front JOIN layered USING (proposal_id, mid) GROUP BY ALL)"""


def _cells() -> str:
    cells = ["max(CASE WHEN f = 'keep_id' THEN w[2] END) keep_id"]
    for f in ("source_session", "evidence_uri", "valid_from", "valid_to"):
        cells += [f"max(CASE WHEN f = '{f}' THEN w[{k}] END) {f}{end}" for k, end in ((2, ""), (1, "_from"), (3, "_layer"))]
    return ", ".join(cells)


_GROUPS = f"""WITH RECURSIVE links AS (SELECT {_id('a_id')} u, {_id('b_id')} v FROM match_pairs WHERE lower(trim(relation)) = 'same'
  UNION ALL SELECT list_min(m), unnest(m) FROM (SELECT list_filter(list_transform(member_ids, lambda x: {_id('x')}), lambda y: y IS NOT NULL) m FROM proposals
    WHERE lower(trim(kind)) = 'duplicate' AND lower(trim(status)) IN ('pending', 'applied'))),
two AS (SELECT u, v FROM links WHERE u <> v UNION SELECT v, u FROM links WHERE u <> v),
reach AS (SELECT u a, u b FROM two UNION SELECT r.a, t.v FROM reach r JOIN two t ON t.u = r.b WHERE t.v < r.a OR true),
grp AS (SELECT a mem_id, min(b) group_id FROM reach GROUP BY a)"""

ORACLE = {
    "p2_found": f"WITH {_CANON}, g AS (SELECT *, min(line_no) OVER (PARTITION BY t, s, k) f FROM canon) SELECT f first_line_no, line_no FROM g WHERE f <> line_no",
    "p2_records": f"WITH {_CANON} SELECT min(line_no) first_line_no, count(*) n_copies FROM canon GROUP BY t, s, k UNION ALL SELECT line_no, 1 FROM memories WHERE line_no NOT IN (SELECT line_no FROM canon)",
    "p3_found": f"WITH {_NEWEST} SELECT proposal_id, f field_name, arg_min(mid, (lv, -sure, -recent::HUGEINT, mid)) member_id FROM fields WHERE v IS NOT NULL GROUP BY ALL",
    "p3_survivors": f"WITH {_NEWEST}, {_LAYERS} SELECT proposal_id, {_cells()} FROM won GROUP BY ALL",
    "p3_fronts": f"""WITH {_NEWEST} SELECT proposal_id, count(*) n_members, count(DISTINCT CASE WHEN NOT EXISTS (SELECT 1 FROM keyed o WHERE o.proposal_id = k.proposal_id
      AND o.lv <= k.lv AND o.sure >= k.sure AND o.recent >= k.recent AND (o.lv < k.lv OR o.sure > k.sure OR o.recent > k.recent)) THEN (lv, sure, recent) END) n_undominated FROM keyed k GROUP BY ALL""",
    "p5_found": f"{_GROUPS} SELECT group_id, mem_id FROM grp WHERE group_id <> mem_id",
    "p5_sizes": f"{_GROUPS} SELECT group_id, count(*) n_members FROM grp GROUP BY ALL",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
