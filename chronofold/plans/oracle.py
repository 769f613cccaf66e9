"""The queries in DuckDB's SQL."""

from __future__ import annotations

_COS = "list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-12) * (sqrt(list_dot_product({b}, {b})) + 1e-12))"
_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
_XY = _COS.format(a="x.e", b="y.e")

_LOG = """e AS (SELECT event_id AS seq, user_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
n AS (SELECT *, CASE WHEN rn > 1 AND event_type = 'purchase' AND k % 5 = 0 THEN concat('c', user_id, '_', seq) END AS nid FROM e),
t AS (SELECT *, coalesce(last_value(nid IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), concat('c', user_id)) AS tgt FROM n),
log AS (SELECT seq, concat('c', user_id) AS lineage_id, CASE WHEN rn = 1 THEN 'assert' WHEN event_type IN ('click', 'view') THEN 'touch' WHEN event_type = 'error' AND k % 2 = 0 THEN 'supersede'
    WHEN event_type = 'error' THEN 'forget' WHEN event_type = 'signup' THEN 'restore' WHEN nid IS NOT NULL THEN 'supersede' ELSE 'confidence' END AS op,
  CASE WHEN rn = 1 THEN concat('c', user_id) END AS id, CASE WHEN rn > 1 THEN tgt END AS target, CASE WHEN rn = 1 OR nid IS NOT NULL THEN concat('t', seq) END AS text, nid AS new_id,
  (nid IS NOT NULL AND k % 2 = 0) AS carry, ts, CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS to_, event_type AS kind, concat('u', user_id % 10) AS entity FROM t)"""

_CLAIMS = (
    "WITH RECURSIVE "
    + _LOG
    + """,
birth AS (SELECT id, seq AS birth_seq FROM log WHERE op = 'assert' UNION ALL
  SELECT l.new_id, l.seq FROM birth b JOIN log l ON l.target = b.id AND l.seq > b.birth_seq WHERE l.op = 'supersede' AND coalesce(l.text, '') <> ''),
ops AS (SELECT b.id AS cid, l.* EXCLUDE (id), coalesce(last_value(CASE l.op WHEN 'supersede' THEN 'superseded' WHEN 'forget' THEN 'forgotten' WHEN 'restore' THEN 'active' END IGNORE NULLS)
  OVER (PARTITION BY b.id ORDER BY l.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'active') AS st FROM birth b JOIN log l ON l.target = b.id AND l.seq > b.birth_seq),
run AS MATERIALIZED (SELECT *, sum(CASE WHEN op = 'touch' AND st = 'active' THEN 1 ELSE 0 END) OVER w AS h, last_value(CASE WHEN op = 'touch' AND st = 'active' THEN ts END IGNORE NULLS) OVER w AS la,
  last_value(CASE WHEN op = 'confidence' THEN to_ END IGNORE NULLS) OVER w AS cf FROM ops WINDOW w AS (PARTITION BY cid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
base AS (SELECT id, text, kind, entity, 'low' AS confidence, ts AS created, CAST(0 AS BIGINT) AS hits, CAST(NULL AS VARCHAR) AS la, seq AS birth_seq, lineage_id FROM log WHERE op = 'assert' UNION ALL
  SELECT r.new_id, r.text, b.kind, b.entity, coalesce(r.cf, b.confidence), CASE WHEN r.carry THEN b.created ELSE r.ts END, CASE WHEN r.carry THEN CAST(b.hits + r.h AS BIGINT) ELSE 0 END,
    CASE WHEN r.carry THEN coalesce(r.la, b.la) END, r.seq, b.lineage_id FROM base b JOIN run r ON r.cid = b.id WHERE r.op = 'supersede' AND coalesce(r.text, '') <> ''),
last AS (SELECT cid, arg_max(st, seq) AS st, max(h) AS h, arg_max(la, seq) AS la, arg_max(cf, seq) AS cf FROM (SELECT * FROM run) GROUP BY cid),
claims AS (SELECT b.id, b.text, b.kind, b.entity, coalesce(l.cf, b.confidence) AS confidence, b.created, CAST(b.hits + coalesce(l.h, 0) AS BIGINT) AS hits, coalesce(l.la, b.la) AS last_accessed,
  coalesce(l.st, 'active') AS status, b.birth_seq, b.lineage_id FROM base b LEFT JOIN last l ON l.cid = b.id)
"""
)

_RANK = "CASE confidence WHEN 'low' THEN 0.3 WHEN 'mid' THEN 0.6 WHEN 'high' THEN 0.9 ELSE 0.0 END"
_IDLE = "CAST(floor((epoch(TIMESTAMP '2024-04-01 00:00:00') - epoch(strptime(coalesce(last_accessed, created), '%Y-%m-%dT%H:%M:%SZ'))) / 86400) AS BIGINT)"
_DOCS = """c AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text, d.lang AS kind, d.source AS entity, CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'mid' END AS confidence,
  d.doc_id % 7 AS hits, d.doc_id AS birth_seq FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_SQUEEZE = r"regexp_replace({t}, '[\x{{9}}-\x{{d}}\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')"
_GRAMS = "CASE WHEN length({s}) < 2 THEN [{s}] ELSE list_distinct(list_transform(range(1, length({s})), lambda i: substring({s}, i, 2))) END"


def _search(phrase: str) -> str:
    return f"""s AS (SELECT conv_id, turn, {_SQUEEZE.format(t="text")} AS s, {_SQUEEZE.format(t=f"'{phrase}'")} AS q FROM conversations),
g AS (SELECT conv_id, turn, {_GRAMS.format(s="s")} AS a, {_GRAMS.format(s="q")} AS b FROM s),
j AS (SELECT conv_id, turn, len(list_intersect(a, b)) / (len(list_distinct(list_concat(a, b))) + 1e-12) AS o FROM g),
deep AS (SELECT conv_id, turn, round(o, 4) AS score FROM j WHERE o > 0 ORDER BY round(o, 4) DESC, conv_id, turn LIMIT 5)"""


def oracle_sql(phrase: str, review: float, merge: float) -> dict[str, str]:
    top = f"top AS (SELECT y.id, round({_XY}, 4) AS score FROM v x, v y WHERE x.id = 0 ORDER BY {_XY} DESC, y.id LIMIT 5)"
    pairs = f"p AS (SELECT x.id AS a, y.id AS b, round({_XY}, 4) AS score FROM v x JOIN v y ON x.id < y.id WHERE {_XY} >= {review})"
    made = "CASE WHEN {x} % 3 = 0 THEN 1 ELSE 2 END"
    first = f"(a % 5 > b % 5 OR (a % 5 = b % 5 AND {made.format(x='a')} >= {made.format(x='b')}))"
    merging = f"""q AS (SELECT *, CASE WHEN {first} THEN a ELSE b END AS kept, CASE WHEN {first} THEN b ELSE a END AS loser, row_number() OVER (ORDER BY score DESC, a, b) AS i FROM p WHERE score >= {merge}),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone, false AS took UNION ALL
  SELECT q.i, CASE WHEN list_contains(w.gone, q.a) OR list_contains(w.gone, q.b) THEN w.gone ELSE list_append(w.gone, q.loser) END, NOT (list_contains(w.gone, q.a) OR list_contains(w.gone, q.b)) FROM w JOIN q ON q.i = w.i + 1),
m AS (SELECT q.* FROM q JOIN w USING (i) WHERE took)"""
    fold = "list_reduce(list_concat([0.0::DOUBLE], list({x} ORDER BY {o}) OVER (PARTITION BY {p} ORDER BY {o} ROWS UNBOUNDED PRECEDING)), lambda a, x: a + x)"
    return {
        "recall_topk": f"WITH {_V}, {top} SELECT * FROM top",
        "recall_topk_batch": f"WITH {_V}, r AS (SELECT x.id AS query_id, y.id, {_XY} AS s FROM v x JOIN v y ON x.id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM r) SELECT query_id, id, rank, round(s, 4) AS score FROM k WHERE rank <= 5",
        "find_similar": f"WITH {_V} SELECT y.id, round({_XY}, 4) AS score, round({_XY}, 4) >= 0.9 AS is_duplicate FROM v x, v y WHERE x.id = 7 AND y.id <> 7 ORDER BY {_XY} DESC, y.id LIMIT 1",
        "sim_pairs_review": f"WITH {_V}, {pairs} SELECT * FROM p WHERE score < {merge}",
        "sim_pairs_merge": f"WITH {_V}, {pairs} SELECT * FROM p WHERE score >= {merge}",
        "greedy_merge": f"""WITH RECURSIVE {_V}, {pairs}, q AS (SELECT *, CASE WHEN a % 5 >= b % 5 THEN a ELSE b END AS kept, CASE WHEN a % 5 >= b % 5 THEN b ELSE a END AS loser, row_number() OVER (ORDER BY score DESC, a, b) AS i FROM p),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone, false AS took UNION ALL
  SELECT q.i, CASE WHEN list_contains(w.gone, q.a) OR list_contains(w.gone, q.b) THEN w.gone ELSE list_append(w.gone, q.loser) END, NOT (list_contains(w.gone, q.a) OR list_contains(w.gone, q.b)) FROM w JOIN q ON q.i = w.i + 1)
SELECT a, b, score, kept, loser FROM q JOIN w USING (i) WHERE took""",
        "nn_join": f"WITH {_V}, l AS (SELECT * FROM v WHERE label = 0 ORDER BY id LIMIT 20), r AS (SELECT x.id, y.id AS nearest, {_XY} AS s, row_number() OVER (PARTITION BY x.id ORDER BY {_XY} DESC, y.id) AS k FROM l x JOIN v y ON y.label <> 0) SELECT id, nearest, round(s, 4) AS score FROM r WHERE k = 1",
        "replay_status": _CLAIMS + "SELECT id, status FROM claims",
        "log_on_disk": _CLAIMS + "SELECT id, text, status, confidence, hits, last_accessed FROM claims",
        "index_of_active": _CLAIMS + f", {_V}, a AS (SELECT v.id, v.e FROM v JOIN claims c ON c.id = concat('c', v.id) AND c.status = 'active'), r AS (SELECT y.id, {_XY} AS s FROM v x, a y WHERE x.id = 0 ORDER BY s DESC, y.id LIMIT 5) SELECT concat('c', id) AS id, round(s, 4) AS score FROM r",
        "command_session": _CLAIMS
        + f""", act AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY birth_seq) AS i FROM claims),
old AS (SELECT id, text, CAST(NULL AS VARCHAR) AS key, CASE WHEN status = 'active' AND i IN (2, 3) THEN 'superseded' WHEN status = 'active' AND i = 4 THEN 'forgotten' WHEN status = 'forgotten' AND i = 1 THEN 'active' ELSE status END AS status,
  CASE WHEN status = 'active' AND i = 1 AND {_RANK.replace("confidence", "CASE WHEN hits + 1 >= 8 THEN 'high' WHEN hits + 1 >= 3 THEN 'mid' END")} > {_RANK} THEN CASE WHEN hits + 1 >= 8 THEN 'high' ELSE 'mid' END ELSE confidence END AS confidence,
  CASE WHEN status = 'active' AND i = 1 THEN hits + 1 ELSE hits END AS hits, CASE WHEN status = 'active' AND i = 1 THEN '2024-04-01T00:00:00Z' ELSE last_accessed END AS last_accessed, created, lineage_id FROM act)
SELECT * FROM old UNION ALL SELECT 'm1', 'said again', NULL, 'active', confidence, hits, last_accessed, created, lineage_id FROM act WHERE status = 'active' AND i = 2
UNION ALL SELECT 'm2', 'put right', NULL, 'active', confidence, 0, NULL, '2024-04-01T00:00:00Z', lineage_id FROM act WHERE status = 'active' AND i = 3
UNION ALL SELECT 'm3', 'tea at nine', 'drink', 'superseded', 'low', 0, NULL, '2024-04-01T00:00:00Z', 'm3' UNION ALL SELECT 'm4', 'coffee at ten', 'drink', 'active', 'low', 0, NULL, '2024-04-01T00:00:00Z', 'm4'""",
        "hard_forget_in_home": _CLAIMS + "SELECT id, text, status, confidence, hits, created FROM claims WHERE birth_seq <> (SELECT min(birth_seq) FROM claims WHERE status = 'active')",
        "snapshot_in_home": _CLAIMS + "SELECT id, text, status, confidence, hits, last_accessed, created, birth_seq, lineage_id FROM claims",
        "import_chain": "SELECT concat('e', max(event_id)) AS id, concat('t', max(event_id)) AS text, strftime(arg_min(ts, event_id), '%Y-%m-%dT%H:%M:%SZ') AS created, concat('e', min(event_id)) AS lineage_id FROM events GROUP BY user_id",
        "context_in_home": f"""WITH {_V}, r AS (SELECT y.id, round({_XY}, 4) AS score, row_number() OVER (ORDER BY {_XY} DESC, y.id) AS rank FROM v x, v y WHERE x.id = 3),
t AS (SELECT *, sum(length(concat('text ', id)) / 1.5::DOUBLE) OVER (ORDER BY score DESC, rank) AS used, row_number() OVER (ORDER BY score DESC, rank) AS rn FROM r WHERE rank <= 20)
SELECT concat('v', id) AS id, concat('text ', id) AS text, score, id % 5 AS hits FROM t WHERE rn = 1 OR used <= 60""",
        "recall_in_home": f"""WITH {_V}, r AS (SELECT y.id, row_number() OVER (ORDER BY {_XY} DESC, y.id) AS rank FROM v x, v y WHERE x.id = 7),
h AS (SELECT id, CAST(id % 5 + CASE WHEN rank = 1 THEN 2 WHEN rank <= 10 THEN 1 ELSE 0 END AS BIGINT) AS hits, rank FROM r)
SELECT concat('v', id) AS id, 'active' AS status, CASE WHEN id % 2 = 1 THEN 'high' WHEN rank <= 10 AND hits >= 8 THEN 'high' WHEN rank <= 10 AND hits >= 3 THEN 'mid' ELSE 'low' END AS confidence, hits, CASE WHEN rank <= 10 THEN '2024-04-01T00:00:00Z' END AS last_accessed FROM h""",
        "status_in_home": "SELECT count(*) AS total, count(*) - 1 AS active_claims, round((count(*) - 1) / 3000.0::DOUBLE, 4) AS pressure, count(*) - 1 AS indexed FROM embeddings",
        "sleep_merged": f"WITH RECURSIVE {_V}, {pairs}, {merging} SELECT concat('v', v.id) AS id, CASE WHEN v.id IN (SELECT loser FROM m) THEN 'superseded' WHEN v.id % 30 = 0 THEN 'forgotten' ELSE 'active' END AS status, v.id % 5 AS hits FROM v",
        "sleep_report": f"""WITH RECURSIVE {_V}, {pairs}, {merging} SELECT 'merge' AS part, concat('v', kept) AS a, concat('v', loser) AS b, score FROM m
UNION ALL SELECT 'review', concat('v', a), concat('v', b), score FROM p WHERE score < {merge} UNION ALL SELECT 'forget', concat('v', id), '91', round(exp(-91 / 30.0::DOUBLE), 3) FROM v WHERE id % 30 = 0
UNION ALL SELECT 'cluster', concat('e', label), CAST(count(*) AS VARCHAR), 0.0 FROM v GROUP BY label HAVING count(*) >= 3""",
        "sleep_audit": f"WITH RECURSIVE {_V}, {pairs}, {merging} SELECT 'supersede' AS action, concat('v', loser) AS target, '2024-04-01T00:00:00Z' AS ts FROM m UNION ALL SELECT 'forget', concat('v', id), '2024-04-01T00:00:00Z' FROM v WHERE id % 30 = 0",
        "episodic_in_home": "SELECT concat('ep_', event_id) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, concat('saw ', event_type) AS text, CAST(user_id AS VARCHAR) AS entity FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-12' AND event_type = 'error'",
        "sleep_applied": _CLAIMS + f"SELECT id, CASE WHEN status = 'active' AND confidence = 'low' AND exp(-{_IDLE} / (30.0::DOUBLE * (1 + hits))) < 0.2 THEN 'forgotten' ELSE status END AS status, confidence, hits FROM claims",
        "replay_hits": _CLAIMS + "SELECT id, hits, last_accessed FROM claims",
        "replay_confidence": _CLAIMS + "SELECT id, confidence FROM claims",
        "replay_lineage": _CLAIMS + "SELECT id, text, kind, entity, created, birth_seq, lineage_id FROM claims",
        "query_filter": _CLAIMS + "SELECT id, text, status FROM claims WHERE entity = 'u3'",
        "query_min_confidence": _CLAIMS + f"SELECT id, confidence FROM claims WHERE status = 'active' AND {_RANK} >= 0.6",
        "point_lookup": _CLAIMS + "SELECT id, text, status, hits FROM claims WHERE id = 'c1'",
        "episodic_range": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, event_type AS topic, CAST(user_id AS VARCHAR) AS entity FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' AND event_type = 'click'",
        "deep_search": f"WITH {_search(phrase)} SELECT * FROM deep",
        "deep_recall_in_home": f"WITH {_search(phrase)} SELECT concat(conv_id, '/', turn) AS id, score FROM deep",
        "recall_deep": f"WITH {_V}, {top}, {_search(phrase)} SELECT 0 AS layer, CAST(id AS VARCHAR) AS id, score FROM top UNION ALL SELECT 1, concat(conv_id, '/', turn), score FROM deep",
        "context_pack": f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, {fold.format(x="length(text) / 1.5::DOUBLE", o="doc_id", p="source")} AS used FROM documents)
SELECT doc_id, source, rn, CAST(trunc(used) AS BIGINT) AS used FROM r WHERE rn = 1 OR used <= 2000""",
        "profile_pack": f"""WITH {_DOCS}, o AS (SELECT *, row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'mid' THEN 2 ELSE 1 END DESC, hits DESC, birth_seq) AS rn FROM c WHERE text <> ''),
r AS (SELECT *, {fold.format(x="length(text) / 1.5::DOUBLE", o="rn", p="1")} AS used FROM o WHERE rn <= 3002) SELECT id, rn, confidence, hits, CAST(trunc(used) AS BIGINT) AS used FROM r WHERE rn = 1 OR used <= 2000""",
        "forget_candidates": _CLAIMS + f", r AS (SELECT id, {_IDLE} AS days_idle, exp(-{_IDLE} / (30.0::DOUBLE * (1 + hits))) AS r FROM claims WHERE status = 'active' AND confidence = 'low') SELECT id, days_idle, round(r, 3) AS retention FROM r WHERE r < 0.2",
        "retention_scores": _CLAIMS + f"SELECT id, {_IDLE} AS days_idle, round(exp(-{_IDLE} / (30.0::DOUBLE * (1 + hits))), 6) AS retention FROM claims",
        "entity_clusters": _CLAIMS + "SELECT entity, count(*) AS count, min(birth_seq) AS first_seq, string_agg(id, ',' ORDER BY birth_seq) AS ids FROM claims WHERE status = 'active' AND entity <> '' GROUP BY entity HAVING count(*) >= 3",
        "pressure_status": _CLAIMS + "SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active_claims, round(count(*) FILTER (status = 'active') / 3000.0::DOUBLE, 4) AS pressure FROM claims",
        "promotions": _CLAIMS + f""", w AS (SELECT *, CASE WHEN hits >= 8 THEN 'high' WHEN hits >= 3 THEN 'mid' END AS "to" FROM claims) SELECT id, hits, "to" FROM w WHERE {_RANK.replace("confidence", '"to"')} > {_RANK}""",
        "render_view": f"WITH {_DOCS} SELECT id, md5(concat('[', coalesce(kind, ''), '|', coalesce(entity, ''), '|2024-01] ', coalesce(text, ''))) AS rendered_md5 FROM c",
        "bigram_sets": f"WITH s AS (SELECT conv_id, turn, {_SQUEEZE.format(t='text')} AS s FROM conversations) SELECT conv_id, turn, CAST(len({_GRAMS.format(s='s')}) AS BIGINT) AS n_bigrams FROM s",
        "supersede_by_key": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
        "keyed_writes_in_home": "SELECT concat('o', o_orderkey) AS id, concat('c', o_custkey) AS key, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'active' ELSE 'superseded' END AS status, CAST(0 AS BIGINT) AS hits, '2024-04-01T00:00:00Z' AS created FROM orders",
        "copies_in_home": """WITH g AS (SELECT coalesce(min(doc_id) FILTER (doc_id % 2 = 0), min(doc_id)) AS id, count(*) - 1 AS hits FROM documents WHERE text <> '' GROUP BY coalesce(lang, ''), coalesce(source, ''), text)
SELECT concat('d', id) AS id, 'active' AS status, CASE WHEN hits >= 8 THEN 'high' WHEN hits >= 3 THEN 'mid' ELSE 'low' END AS confidence, hits, CASE WHEN hits > 0 THEN '2024-04-01T00:00:00Z' END AS last_accessed FROM g""",
        "reindex_in_home": "SELECT CASE WHEN i = 1 THEN 'm1' ELSE concat('v', vec_id) END AS id, 'table' AS model, i = 1 AS made_here FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings) WHERE i <> 2",
        "profile_in_home": f"""WITH o AS (SELECT vec_id AS id, concat('text ', vec_id) AS text, row_number() OVER (ORDER BY vec_id % 2 DESC, vec_id % 5 DESC, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 2 END, vec_id) AS rn FROM embeddings),
r AS (SELECT *, {fold.format(x="length(text) / 1.5::DOUBLE", o="rn", p="1")} AS used FROM o WHERE rn <= 200) SELECT concat('- [fact] ', text) AS line FROM r WHERE rn = 1 OR used <= 100""",
        "sleep_entries": f"""WITH {_V}, r AS (SELECT y.id, round({_XY}, 4) AS score FROM v x, v y WHERE x.id = 9 ORDER BY {_XY} DESC, y.id LIMIT 1),
n AS (SELECT event_id FROM events WHERE event_id % 40 >= 34 ORDER BY event_id % 40 >= 36, event_id LIMIT 20) SELECT concat('ep_', event_id) AS entry, concat('v', r.id) AS claim, r.score FROM n, r""",
        "exact_dup_text": "SELECT md5(text) AS text_md5, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY md5(text) HAVING count(*) > 1",
    }
