"""Queries of entity states, edits of logs and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.operators import entities, keyframes
from chronogrid.sources.views import derive, oracle, view
from chronogrid.streaming import entity_state

ASOF = "2024-01-15 00:00:00"


def _on(sql):
    return lambda s, d: derive(s, d, sql)


def log(s, d):
    return derive(s, d, LOG)


#: The event log with a key taken away here and there.
LOG = "SELECT id, date, k, CASE WHEN seq % 11 = 0 THEN NULL ELSE v END AS v, seq FROM {entity_log}"
SLOTS = "SELECT id, date, seq, CAST(seq % 3 AS INT) AS slot, CASE WHEN seq % 3 = 2 THEN 'variables.' || k ELSE k END AS k, CASE WHEN seq % 7 < 2 THEN NULL ELSE v END AS v FROM {entity_log}"
SOME = "SELECT id, date, k, 'patched' AS v, seq + 1000000000 AS seq FROM {entity_log} WHERE seq % 5 = 0"
GONE = "SELECT DISTINCT id, date FROM {entity_log} WHERE seq % 9 = 0"
MOVES = "SELECT id, date, max(CASE WHEN seq % 2 = 0 THEN date + INTERVAL 1 DAYS ELSE date + INTERVAL 2 DAYS END) AS to FROM {entity_log} WHERE seq % 13 = 0 GROUP BY id, date"
IDS = "SELECT c_custkey AS id FROM {customer} WHERE c_custkey % 3 = 0"
TAGGED = "SELECT c_custkey AS id, split(c_mktsegment || ' ' || CAST(c_nationkey AS STRING), ' ') AS tags FROM {customer}"
MUTATIONS = "SELECT o_custkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'set' WHEN o_orderkey % 3 = 0 THEN 'remove' ELSE 'add' END AS op, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 25 ELSE o_orderkey % 5 END AS VARCHAR(8)) AS tag FROM {orders}"
STATE = "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS coords, CASE WHEN p_partkey % 5 = 0 THEN TRUE WHEN p_partkey % 3 = 0 THEN FALSE END AS hidden, CASE WHEN p_size % 2 = 0 THEN p_size / 10.0 END AS min_zoom, CASE WHEN p_size % 3 = 0 THEN p_size / 5.0 END AS max_zoom FROM {part}"
DATED = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS date FROM {events}"
SHEET = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE '19' || lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR(4)), 2, '0') || '.0' || CAST(o_orderkey % 9 + 1 AS VARCHAR(4)) || '.15' END AS date, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END AS priority FROM {orders}"
SIGHTINGS = "SELECT event_type AS source, 'r' || CAST(user_id % 20 AS VARCHAR(4)) AS region, CAST(user_id % 7 AS INT) AS lng, CAST(event_id % 5 AS INT) AS lat, ts AS date, event_id AS seq FROM {events}"
TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey > 3 THEN CAST(floor(p_partkey / 4.0) AS BIGINT) END AS parent, p_size AS position FROM {part}"
SHAPES = "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'polygon' WHEN 1 THEN 'point' WHEN 2 THEN 'line' ELSE 'label' END AS kind FROM {part}"
LINES = "SELECT CASE WHEN event_id % 17 = 0 THEN 'no record here' WHEN event_id % 19 = 0 THEN 'id broken json' ELSE CAST(user_id AS VARCHAR(12)) || ' <\"type\":\"' || event_type || '\",\"date\":' || CAST(1700000000000 + event_id * 1000 AS VARCHAR(20)) || ',\"data\":<\"n\":\"' || CAST(event_id AS VARCHAR(12)) || '\">>' END AS value FROM {events}"


def _tags(s, d):
    out = keyframes.apply_tag_mutations(_on(TAGGED)(s, d), _on(MUTATIONS)(s, d).select("id", "op", F.array("tag").alias("tags")))
    return out.select("id", F.array_join("tags", "|").alias("tags"))


QUERIES = {
    "resolve_slots": lambda s, d: keyframes.resolve_slots(_on(SLOTS)(s, d), ASOF),
    "resolve_negative": lambda s, d: keyframes.resolve_negative(keyframes.head_state(log(s, d)), entities.negative_diff(log(s, d)), ASOF),
    "resolve_all": lambda s, d: keyframes.snapshots(log(s, d)),
    "first_last_with_property": lambda s, d: keyframes.first_last_with_property(log(s, d), "click"),
    "upsert_keyframe": lambda s, d: keyframes.upsert_keyframe(log(s, d), _on(SOME)(s, d)),
    "delete_keyframe": lambda s, d: keyframes.delete_keyframe(log(s, d), _on(GONE)(s, d)),
    "move_keyframe": lambda s, d: keyframes.move_keyframe(log(s, d), _on(MOVES)(s, d)),
    "bulk_patch": lambda s, d: keyframes.bulk_patch(log(s, d), _on(IDS)(s, d), ASOF, {"colour": "red", "name": None}, 0),
    "apply_tag_mutations": _tags,
    "visible_entities": lambda s, d: keyframes.visible_entities(_on(STATE)(s, d), 2.5).select("id", "coords"),
    "recent_events": lambda s, d: keyframes.recent_events(_on(DATED)(s, d), ASOF, 72.5),
    "variables_to_keyframes": lambda s, d: keyframes.variables_to_keyframes(_on(SHEET)(s, d), ["status", "priority"]),
    "geometry_events": lambda s, d: keyframes.geometry_events(_on(SIGHTINGS)(s, d)),
    "descendants": lambda s, d: keyframes.descendants(_on(TREE)(s, d), _on("SELECT p_partkey AS id FROM {part} WHERE p_partkey < 3")(s, d)),
    "draw_order": lambda s, d: keyframes.draw_order(_on(SHAPES)(s, d), "kind", "id"),
    "read_entity_log": lambda s, d: entity_state.parse_log_lines(_on(LINES)(s, d).select(F.translate("value", "<>", "{}").alias("value"))).select("id", "type", "date", F.element_at("data", "n").alias("n")),
}

SET = "list_sort(list_distinct(list_filter(list_concat(COALESCE(s.t, string_split(c.seg || ' ' || c.n, ' ')), COALESCE(a.t, [])), lambda x: NOT list_contains(COALESCE(r.t, []), x))))"
ORACLES = {
    k: oracle(sql)
    for k, sql in {
        "resolve_slots": f"SELECT id, slot, k, v FROM (SELECT id, slot, k, v, row_number() OVER (PARTITION BY id, slot, k ORDER BY date DESC, seq DESC) AS n FROM ({SLOTS}) WHERE date <= TIMESTAMP '{ASOF}' AND (slot = 0 OR v IS NOT NULL)) WHERE n = 1 AND v IS NOT NULL",
        "resolve_negative": f"SELECT id, k, v FROM (SELECT id, k, v, row_number() OVER (PARTITION BY id, k ORDER BY date DESC, seq DESC) AS n FROM ({LOG}) WHERE date <= TIMESTAMP '{ASOF}') WHERE n = 1 AND v IS NOT NULL",
        "resolve_all": f"WITH l AS ({LOG}), ks AS (SELECT DISTINCT id, k FROM l), g AS (SELECT l.id, l.date, l.seq, ks.k, CASE WHEN l.k = ks.k THEN COALESCE(l.v, chr(1)) END AS own FROM l JOIN ks USING (id)), f AS (SELECT id, date, seq, k, last_value(own IGNORE NULLS) OVER (PARTITION BY id, k ORDER BY date, seq ROWS UNBOUNDED PRECEDING) AS v FROM g) SELECT * FROM f WHERE v <> chr(1)",
        "first_last_with_property": f"SELECT id, min(date) AS first_date, max(date) AS last_date FROM (SELECT id, date, last_value(CASE WHEN k = 'click' THEN COALESCE(v, chr(1)) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY date, seq ROWS UNBOUNDED PRECEDING) AS own FROM ({LOG})) WHERE own <> chr(1) GROUP BY id",
        "upsert_keyframe": f"SELECT id, date, k, v, seq FROM ({LOG}) l WHERE NOT EXISTS (SELECT 1 FROM ({SOME}) p WHERE p.id = l.id AND p.date = l.date AND p.k = l.k) UNION ALL SELECT * FROM ({SOME})",
        "delete_keyframe": f"SELECT id, date, k, v, seq FROM ({LOG}) l WHERE NOT EXISTS (SELECT 1 FROM ({GONE}) p WHERE p.id = l.id AND p.date = l.date)",
        "move_keyframe": f"WITH l AS ({LOG}), m AS ({MOVES}), moved AS (SELECT l.id, m.to AS date, l.k, l.v, l.seq FROM l JOIN m ON m.id = l.id AND m.date = l.date) SELECT id, date, k, v, seq FROM l WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = l.id AND m.date = l.date) AND NOT EXISTS (SELECT 1 FROM moved p WHERE p.id = l.id AND p.date = l.date AND p.k = l.k) UNION ALL SELECT * FROM moved",
        "bulk_patch": f"SELECT id, date, k, v, seq FROM ({LOG}) WHERE NOT (date = TIMESTAMP '{ASOF}' AND k IN ('colour', 'name') AND id % 3 = 0) UNION ALL SELECT id, TIMESTAMP '{ASOF}', t.k, t.v, 0 FROM ({IDS}) CROSS JOIN (VALUES ('colour', 'red'), ('name', NULL)) AS t(k, v)",
        "apply_tag_mutations": f"WITH m AS ({MUTATIONS}), g AS (SELECT id, op, list(tag) AS t FROM m GROUP BY id, op) SELECT c.id, array_to_string({SET}, '|') AS tags FROM (SELECT c_custkey AS id, c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS n FROM {{customer}}) c LEFT JOIN g s ON s.id = c.id AND s.op = 'set' LEFT JOIN g a ON a.id = c.id AND a.op = 'add' LEFT JOIN g r ON r.id = c.id AND r.op = 'remove'",
        "visible_entities": f"SELECT id, coords FROM ({STATE}) WHERE coords IS NOT NULL AND NOT COALESCE(hidden, FALSE) AND COALESCE(min_zoom <= 2.5, TRUE) AND COALESCE(max_zoom >= 2.5, TRUE)",
        "recent_events": f"SELECT * FROM ({DATED}) WHERE date IS NULL OR date >= TIMESTAMP '{ASOF}' - INTERVAL '72 hours 30 minutes'",
        "variables_to_keyframes": f"SELECT id, strptime(date, '%Y.%m.%d') AS date, 'variables.status' AS k, status AS v FROM ({SHEET}) WHERE date <> 'unknown' AND status IS NOT NULL UNION ALL SELECT id, strptime(date, '%Y.%m.%d'), 'variables.priority', priority FROM ({SHEET}) WHERE date <> 'unknown' AND trim(priority) <> ''",
        "geometry_events": f"SELECT source || '_' || region || '_' || lower(printf('%x', abs(h))) AS event_id, date, seq, source, region, lng, lat FROM (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST(lng AS VARCHAR) || ',' || CAST(lat AS VARCHAR), ''), lambda c: ord(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM ({SIGHTINGS})) QUALIFY row_number() OVER (PARTITION BY source, region, lng, lat ORDER BY date, seq) = 1",
        "descendants": f"WITH RECURSIVE t AS ({TREE}), w AS (SELECT id AS root, id, 0 AS depth, '' AS path FROM t WHERE id < 3 UNION ALL SELECT w.root, t.id, w.depth + 1, CASE WHEN path = '' THEN '' ELSE path || '/' END || lpad(CAST(t.position AS VARCHAR), 10, '0') || ':' || lpad(CAST(t.id AS VARCHAR), 12, '0') FROM w JOIN t ON t.parent = w.id) SELECT * FROM w WHERE depth > 0",
        "draw_order": f"SELECT *, CAST(CASE kind WHEN 'polygon' THEN 0 WHEN 'line' THEN 1 WHEN 'point' THEN 2 ELSE 3 END AS INT) AS rank FROM ({SHAPES})",
        "read_entity_log": "SELECT CAST(user_id AS VARCHAR) AS id, event_type AS type, epoch_ms(1700000000000 + event_id * 1000) AS date, CAST(event_id AS VARCHAR) AS n FROM {events} WHERE event_id % 17 <> 0 AND event_id % 19 <> 0",
    }.items()
}
