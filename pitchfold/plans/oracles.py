"""The same queries in SQL, for DuckDB; the fold is a recursive query over one row a track."""

from __future__ import annotations

from ..operators.report import PALETTE, STYLES
from ..sources.tables import MIXED_VIDEOS
from .queries import EARLIER, HOMOGRAPHY, SHORT_MATCH

DETECTIONS = """
e AS (SELECT event_id, user_id % 16 AS slot, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
d0 AS (
  SELECT CAST(floor(event_id / 10000) AS BIGINT) AS match_id, 28771 + CAST(floor(event_id / 12) AS BIGINT) AS frame, event_id AS ord,
         slot + 1 + 16 * CAST(floor((event_id + slot * 90) / 1440) AS BIGINT) AS tid,
         CASE event_type WHEN 'error' THEN 32 WHEN 'signup' THEN 2 ELSE 0 END AS cls, CAST(k + 1 AS DOUBLE) / 100 AS conf,
         CAST(40 + slot * 45 + CASE WHEN slot % 5 = 0 THEN k % 12 ELSE 2 * k END AS BIGINT) AS x1,
         CAST(35 + (slot % 4) * 50 + k % 14 + CASE WHEN slot % 5 = 0 THEN 20 ELSE 0 END AS BIGINT) AS y1,
         CASE WHEN slot % 5 = 0 THEN 30 ELSE 20 + k % 45 END AS w, CASE WHEN slot % 5 = 0 THEN 70 ELSE 15 + (k * 13) % 140 END AS h
  FROM e),
d AS (SELECT match_id, frame, ord, tid, cls, conf, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM d0),
s AS (SELECT * FROM d WHERE cls IN (0, 32) AND conf >= 0.15),
v AS (SELECT * FROM s WHERE cls = 0 AND y1 >= 50 AND NOT (x1 < 20 AND x2 < 20) AND x1 <= 1260 AND y1 <= 700
      AND CAST(greatest(y2 - y1, 1) / greatest(x2 - x1, 1) AS FLOAT) BETWEEN CAST(0.8 AS FLOAT) AND CAST(7.0 AS FLOAT)),
b AS (SELECT * FROM s WHERE cls = 32),
t AS (SELECT match_id, frame, ord, tid, x1, y1, x2, y2, CAST(floor((x1 + x2) / 2) AS BIGINT) AS cx, CAST(floor((y1 + y2) / 2) AS BIGINT) AS cy FROM v
      WHERE tid >= 1 QUALIFY row_number() OVER (PARTITION BY match_id, frame, tid ORDER BY ord) = 1),
spine AS (SELECT match_id, unnest(generate_series(min(frame), max(frame))) AS frame FROM d GROUP BY match_id),
bb AS (SELECT match_id, frame, CAST(floor((x1 + x2) / 2) AS BIGINT) AS x, CAST(floor((y1 + y2) / 2) AS BIGINT) AS y, conf, ord, x1, y1, x2, y2 FROM b
       QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY conf DESC, ord) = 1)"""


def _iou(a: str, b: str) -> str:
    inter = f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter})"
    return f"(CASE WHEN {inter} > 0 AND {union} > 0 THEN {inter} / {union} ELSE 0.0 END)"


def _put(name: str, value: str) -> str:
    """List ``name`` with ``value`` at the row's slot, unchanged without one."""
    return f"CASE WHEN k IS NULL THEN {name} ELSE list_transform({name}, lambda v, i: CASE WHEN i = k THEN {value} ELSE v END) END"


#: State: tids, last x, y and frame, dead and seen of each slot, and of the frame its active slots and boxes.
FOLD = f"""
q AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame, ord) AS seq FROM t),
fold AS (
  SELECT match_id, CAST(0 AS BIGINT) AS seq, CAST(-1 AS BIGINT) AS frame, list_transform(range(13), lambda i: CAST(0 AS BIGINT)) AS tids,
         list_transform(range(13), lambda i: CAST(0 AS BIGINT)) AS lx, list_transform(range(13), lambda i: CAST(0 AS BIGINT)) AS ly,
         list_transform(range(13), lambda i: CAST(-1 AS BIGINT)) AS lf, list_transform(range(13), lambda i: false) AS dead,
         list_transform(range(13), lambda i: CAST([] AS STRUCT(x BIGINT, y BIGINT)[])) AS seen, CAST([] AS BIGINT[]) AS act,
         CAST([] AS STRUCT(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[]) AS boxes, CAST(NULL AS BIGINT) AS k, false AS occ, '' AS outcome, '' AS status, CAST(NULL AS BIGINT) AS reid_d2
  FROM (SELECT DISTINCT match_id FROM q)
  UNION ALL
  SELECT match_id, seq, frame, tids2, lx2, ly2, lf2, dead2, seen2, act2, boxes2, k, occ, outcome, status, CASE WHEN outcome = 'reid' THEN near // 100 END FROM (
    SELECT *,
      CASE WHEN fires THEN {_put("tids1", "CAST(0 AS BIGINT)")} ELSE tids1 END AS tids2,
      CASE WHEN fires THEN {_put("dead", "true")} ELSE dead END AS dead2,
      CASE WHEN k IS NULL OR occ OR was_dead THEN seen WHEN fires THEN {_put("seen", "CAST([] AS STRUCT(x BIGINT, y BIGINT)[])")}
           WHEN len(h) >= 48 THEN {_put("seen", "h[-12:]")} ELSE {_put("seen", "h")} END AS seen2,
      CASE WHEN outcome = 'duplicate' OR outcome = 'unresolved' OR outcome = 'unknown' THEN 'dropped' WHEN occ THEN 'occluded' WHEN was_dead THEN 'hidden' WHEN fires THEN 'tombstoned' ELSE 'exported' END AS status
    FROM (
      SELECT *,
        coalesce(NOT occ AND NOT was_dead AND len(h) >= 48 AND greatest(list_max(list_transform(h[-48:], lambda p: p.x)) - list_min(list_transform(h[-48:], lambda p: p.x)),
                 list_max(list_transform(h[-48:], lambda p: p.y)) - list_min(list_transform(h[-48:], lambda p: p.y))) < 18, false) AS fires,
        CASE WHEN k IS NULL THEN act0 ELSE list_append(act0, k) END AS act2,
        CASE WHEN outcome IN ('duplicate', 'unresolved') THEN boxes0 ELSE list_append(boxes0, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) END AS boxes2,
        {_put("lx", "cx")} AS lx2, {_put("ly", "cy")} AS ly2, {_put("lf", "frame")} AS lf2, {_put("tids", "tid")} AS tids1
      FROM (
        SELECT *, CASE WHEN k IS NOT NULL THEN list_append(seen[k], {{'x': cx, 'y': cy}}) END AS h, coalesce(dead[k], false) AS was_dead
        FROM (
          SELECT *,
            CASE WHEN own > 0 AND list_contains(act0, own) THEN 'duplicate' WHEN own > 0 THEN 'known' WHEN occ THEN 'unknown'
                 WHEN free > 0 THEN CASE WHEN lf[free] >= 0 THEN 'recycled' ELSE 'new' END WHEN near IS NOT NULL THEN 'reid' ELSE 'unresolved' END AS outcome,
            CASE WHEN own > 0 AND list_contains(act0, own) THEN NULL WHEN own > 0 THEN own WHEN occ THEN NULL WHEN free > 0 THEN free WHEN near IS NOT NULL THEN near % 100 END AS k
          FROM (
            SELECT *, coalesce(list_position(tids, tid), 0) AS own, coalesce(list_position(tids, 0), 0) AS free,
              len(list_filter(boxes0, lambda o: {_iou("o", "me")} > 0.4)) > 0 AS occ,
              list_min(list_filter(list_transform(range(1, 14), lambda i: CASE WHEN lf[i] >= 0 AND NOT list_contains(act0, i) AND frame - lf[i] >= 8
                AND (lx[i] - cx) * (lx[i] - cx) + (ly[i] - cy) * (ly[i] - cy) <= 40000
                THEN ((lx[i] - cx) * (lx[i] - cx) + (ly[i] - cy) * (ly[i] - cy)) * 100 + i END), lambda z: z IS NOT NULL)) AS near
            FROM (
              SELECT q.*, {{'x1': q.x1, 'y1': q.y1, 'x2': q.x2, 'y2': q.y2}} AS me, f.tids, f.lx, f.ly, f.lf, f.dead, f.seen,
                CASE WHEN f.frame = q.frame THEN f.act ELSE CAST([] AS BIGINT[]) END AS act0,
                CASE WHEN f.frame = q.frame THEN f.boxes ELSE CAST([] AS STRUCT(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[]) END AS boxes0
              FROM fold f JOIN q ON q.match_id = f.match_id AND q.seq = f.seq + 1)))))
  )),
log AS (
  SELECT q.match_id, q.frame, q.ord, q.tid, q.x1, q.y1, q.x2, q.y2, q.cx, q.cy, f.occ AS occluded, CAST(f.k AS INT) AS id, f.outcome, f.status, f.reid_d2,
         CAST(len(list_filter(f.tids, lambda z: z = 0)) AS INT) AS free, CAST(len(list_filter(f.dead, lambda z: z)) AS INT) AS static
  FROM fold f JOIN q USING (match_id, seq)),
gone AS (SELECT DISTINCT match_id, id FROM log WHERE status = 'tombstoned'),
obs AS (SELECT match_id, frame, id, cx AS x, cy AS y, x1, y1, x2, y2, occluded AS en_oclusion FROM log ANTI JOIN gone USING (match_id, id) WHERE status = 'exported')"""

COUNTS = """
counts AS (SELECT match_id, frame, count(s.frame) AS n_dets_raw, count(v.ord) AS n_dets FROM spine LEFT JOIN s USING (match_id, frame)
           LEFT JOIN (SELECT match_id, frame, ord FROM v) v USING (match_id, frame, ord) GROUP BY match_id, frame)"""
METRICS = """
ends AS (SELECT match_id, frame, arg_max(free, ord) AS free, arg_max(static, ord) AS static, count(DISTINCT id) AS n_active FROM log GROUP BY match_id, frame),
held AS (SELECT c.*, coalesce(n_active, 0) AS n_active,
           coalesce(last_value(e.free IGNORE NULLS) OVER (PARTITION BY c.match_id ORDER BY c.frame), 13) AS free,
           coalesce(last_value(e.static IGNORE NULLS) OVER (PARTITION BY c.match_id ORDER BY c.frame), 0) AS static
         FROM counts c LEFT JOIN ends e USING (match_id, frame)),
fm AS (SELECT match_id, frame, n_dets_raw, n_dets, CAST(13 - free - static AS BIGINT) AS ids_assigned, n_active, CAST(static AS BIGINT) AS n_static,
         (match_id, frame) IN (SELECT (match_id, frame) FROM b) AS ball_detected, frame / 23.976::DOUBLE / 60 AS minute FROM held)"""
WINDOWS = """
n AS (SELECT *, row_number() OVER o AS sighting, greatest(max(cx) OVER w - min(cx) OVER w, max(cy) OVER w - min(cy) OVER w) AS extent FROM t
      WINDOW o AS (PARTITION BY match_id, tid ORDER BY frame, ord), w AS (PARTITION BY match_id, tid ORDER BY frame, ord ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)),
looks AS (SELECT match_id, tid, sighting, frame, extent, extent < 18 AS is_static FROM n WHERE sighting >= 48 AND (sighting - 48) % 36 = 0),
still AS (SELECT match_id, tid, min(sighting) AS sighting, min(frame) AS frame FROM looks WHERE is_static GROUP BY match_id, tid)"""


def _sql(body: str, *parts: str) -> str:
    return f"WITH RECURSIVE {','.join([DETECTIONS, *parts])}\n{body}"


_palette = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in PALETTE.items())
PALETTE_SQL = f"SELECT *, greatest(c1 - 80, 0) AS d1, greatest(c2 - 80, 0) AS d2, greatest(c3 - 80, 0) AS d3 FROM (VALUES {_palette}) AS p(id, c1, c2, c3)"
_styles = ", ".join(f"('{kind}', {a}, " + (f"{b}::DOUBLE, {c}, {d}, {e}, '{colour}', " if colour else "NULL, NULL, NULL, NULL, NULL, ") + (f"{wider}, {higher}, " if wider else "NULL, NULL, ") + f"{dot or 'NULL'})" for kind, (a, b, c, d, e, colour, wider, higher, dot) in STYLES.items())
_h = [f"(x * {a}::DOUBLE + y * {b}::DOUBLE + {c}::DOUBLE)" for a, b, c in HOMOGRAPHY]

ORACLES = {
    "det_source_filter": _sql("SELECT * FROM s"),
    "start_frame_prune": _sql("SELECT * FROM d WHERE frame >= 29130"),
    "video_meta_derived": _sql("SELECT match_id, CAST(24 AS BIGINT) AS fps_rounded, (max(frame) + 1) / 23.976::DOUBLE / 60 AS minutes, CAST(trunc(20.25::DOUBLE * 60 * 23.976::DOUBLE) AS BIGINT) AS start_frame FROM d GROUP BY match_id"),
    "det_class_split": _sql("SELECT *, CASE cls WHEN 0 THEN 'player' ELSE 'ball' END AS route FROM d WHERE cls IN (0, 32)"),
    "player_geometry_filter": _sql("SELECT * FROM v"),
    "frame_detection_counts": _sql("SELECT * FROM counts", COUNTS),
    "frames_without_tracks": _sql("SELECT match_id, count(*) AS frames, count(*) FILTER ((match_id, frame) NOT IN (SELECT (match_id, frame) FROM t)) AS frames_without_tracks FROM spine GROUP BY match_id"),
    "track_centers": _sql("SELECT * FROM t"),
    "box_iou_pairs": _sql(f"SELECT l.match_id, l.frame, l.ord, r.ord AS other_ord, round({_iou('l', 'r')}, 9) AS iou FROM t l JOIN t r ON l.match_id = r.match_id AND l.frame = r.frame AND r.ord < l.ord WHERE {_iou('l', 'r')} > 0"),
    "occlusion_candidates": _sql(f"SELECT match_id, frame, ord, tid, x1, y1, x2, y2 FROM t l WHERE EXISTS (SELECT 1 FROM t r WHERE l.match_id = r.match_id AND l.frame = r.frame AND r.ord < l.ord AND {_iou('l', 'r')} > 0.4)"),
    "nearest_absent_track": _sql("""
        SELECT match_id, frame, tid, near.tid AS near_tid, near.d2 AS d2 FROM (
          SELECT a.match_id, a.frame, a.tid, min(CASE WHEN o.tid IS NOT NULL THEN {'d2': o.d2, 'tid': o.tid} END) AS near
          FROM (SELECT match_id, tid, min(frame) AS frame, arg_min(cx, frame) AS cx, arg_min(cy, frame) AS cy FROM t GROUP BY match_id, tid) a
          LEFT JOIN LATERAL (
            SELECT p.tid, (p.cx - a.cx) * (p.cx - a.cx) + (p.cy - a.cy) * (p.cy - a.cy) AS d2
            FROM (SELECT t.tid, max(t.frame) AS frame, arg_max(t.cx, t.frame) AS cx, arg_max(t.cy, t.frame) AS cy FROM t WHERE t.match_id = a.match_id AND t.frame < a.frame AND t.tid <> a.tid GROUP BY t.tid) p
            WHERE a.frame - p.frame >= 8 AND (p.cx - a.cx) * (p.cx - a.cx) + (p.cy - a.cy) * (p.cy - a.cy) <= 40000) o ON true
          GROUP BY a.match_id, a.frame, a.tid)"""),
    "ball_best_per_frame": _sql("SELECT * FROM bb"),
    "ball_detection_rate": _sql("SELECT match_id, count(*) AS frames, count(*) FILTER (ball) AS ball_frames, count(*) FILTER (ball) / count(*) AS ball_rate FROM (SELECT *, (match_id, frame) IN (SELECT (match_id, frame) FROM b) AS ball FROM spine) GROUP BY match_id"),
    "static_windows_by_track": _sql("SELECT * FROM looks", WINDOWS),
    "static_tracks": _sql("SELECT * FROM still", WINDOWS),
    "non_static_observations": _sql("SELECT * FROM t ANTI JOIN still USING (match_id, tid)", WINDOWS),
    "identity_resolved": _sql("SELECT * FROM log", FOLD),
    "identity_events": _sql("SELECT match_id, frame, ord, tid, id, outcome AS event, CASE WHEN outcome <> 'reid' THEN free END AS pool, CASE WHEN outcome = 'reid' THEN round(sqrt(CAST(reid_d2 AS DOUBLE)), 6) END AS distance FROM log WHERE outcome IN ('new', 'recycled', 'reid') UNION ALL SELECT match_id, frame, ord, tid, id, 'static', NULL, NULL FROM log WHERE status = 'tombstoned'", FOLD),
    "player_observations": _sql("SELECT * FROM obs", FOLD),
    "player_observations_with_occlusion": _sql("SELECT * FROM obs UNION ALL SELECT match_id, frame, id, cx, cy, x1, y1, x2, y2, true FROM log ANTI JOIN gone USING (match_id, id) WHERE status = 'occluded'", FOLD),
    "visible_frames_per_id": _sql("SELECT match_id, id, count(*) AS frames FROM obs GROUP BY match_id, id", FOLD),
    "static_ids": _sql("SELECT * FROM gone", FOLD),
    "run_summary": _sql("""
        SELECT match_id, frames, frames_without_tracks, dets_raw, dets_valid, coalesce(player_ids, 0) AS player_ids, coalesce(player_rows, 0) AS player_rows,
               coalesce(static_ids, 0) AS static_ids, coalesce(static_list, '') AS static_list, coalesce(ball_frames, 0) AS ball_frames
        FROM (SELECT match_id, count(*) AS frames, count(*) FILTER ((match_id, frame) NOT IN (SELECT (match_id, frame) FROM t)) AS frames_without_tracks FROM spine GROUP BY match_id)
        JOIN (SELECT match_id, CAST(sum(n_dets_raw) AS BIGINT) AS dets_raw, CAST(sum(n_dets) AS BIGINT) AS dets_valid FROM counts GROUP BY match_id) USING (match_id)
        LEFT JOIN (SELECT match_id, count(DISTINCT id) AS player_ids, count(*) AS player_rows FROM obs GROUP BY match_id) USING (match_id)
        LEFT JOIN (SELECT match_id, count(*) AS static_ids, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS static_list FROM gone GROUP BY match_id) USING (match_id)
        LEFT JOIN (SELECT match_id, count(DISTINCT frame) AS ball_frames FROM b GROUP BY match_id) USING (match_id)""", FOLD, COUNTS),
    "frame_metrics": _sql("SELECT * FROM fm", FOLD, COUNTS, METRICS),
    "progress_every_150": _sql("SELECT match_id, frame, elapsed, minute, ids_assigned, n_active, n_static, ball_detected FROM (SELECT *, frame - min(frame) OVER (PARTITION BY match_id) AS elapsed FROM fm) WHERE elapsed > 0 AND elapsed % 150 = 0", FOLD, COUNTS, METRICS),
    "annotations": _sql(f"""
        SELECT a.*, line_width, x1 + dx AS label_x, y1 + dy AS label_y, label_scale, label_width, label_colour, field_wider, field_higher,
               CASE WHEN dot_radius IS NOT NULL THEN CAST(floor((x1 + x2) / 2) AS BIGINT) END AS dot_x, CASE WHEN dot_radius IS NOT NULL THEN CAST(floor((y1 + y2) / 2) AS BIGINT) END AS dot_y, dot_radius
        FROM (VALUES {_styles}) AS p(kind, line_width, label_scale, label_width, dx, dy, label_colour, field_wider, field_higher, dot_radius) JOIN (
        SELECT match_id, frame, 'raw' AS kind, x1, y1, x2, y2, '' AS label, '0,220,0' AS colour FROM v
        UNION ALL SELECT match_id, frame, 'ball', x1, y1, x2, y2, 'PELOTA', '0,255,255' FROM bb
        UNION ALL SELECT match_id, frame, 'player', x1, y1, x2, y2, 'ID:' || id, c1 || ',' || c2 || ',' || c3 FROM log JOIN ({PALETTE_SQL}) USING (id) WHERE status = 'exported'
        UNION ALL SELECT match_id, frame, 'occluded', x1, y1, x2, y2, 'ID:' || id || '~', d1 || ',' || d2 || ',' || d3 FROM log JOIN ({PALETTE_SQL}) USING (id) WHERE status = 'occluded') a USING (kind)""", FOLD),
    "hud": _sql("SELECT match_id, frame, 10 AS x, 35 AS y, printf('Min:%.1f | Dets:%d/%d | IDs:%d/13 | Activos:%d | Pelota:%s', minute, n_dets, n_dets_raw, ids_assigned, n_active, CASE WHEN ball_detected THEN 'SI' ELSE 'NO' END) AS label, '0,255,0' AS colour FROM fm", FOLD, COUNTS, METRICS),
    "progress_lines": _sql("SELECT match_id, frame, printf('  Min %.1f | IDs:%d/13 | Activos:%d | Estáticos:%d | Pelota:%s', minute, ids_assigned, n_active, n_static, CASE WHEN ball_detected THEN 'SI' ELSE 'NO' END) AS line FROM (SELECT *, frame - min(frame) OVER (PARTITION BY match_id) AS elapsed FROM fm) WHERE elapsed > 0 AND elapsed % 150 = 0", FOLD, COUNTS, METRICS),
    "palette_colors": _sql(f"SELECT * FROM (SELECT DISTINCT match_id, id FROM obs) JOIN ({PALETTE_SQL}) USING (id)", FOLD),
    "ext_heatmap": _sql("SELECT match_id, id, CAST(floor(x / 40) AS BIGINT) AS cell_x, CAST(floor(y / 40) AS BIGINT) AS cell_y, count(*) AS n FROM obs GROUP BY ALL", FOLD),
    "ext_distance_speed": _sql("""
        SELECT match_id, id, round(coalesce(sum(d), 0), 6) AS distance, round(max(d * 23.976::DOUBLE / frames), 6) AS top_speed FROM (
          SELECT match_id, id, frame - lag(frame) OVER o AS frames, sqrt(CAST((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2 AS DOUBLE)) AS d
          FROM obs WINDOW o AS (PARTITION BY match_id, id ORDER BY frame)) GROUP BY match_id, id""", FOLD),
    "ext_homography": _sql(f"SELECT match_id, frame, id, round(CASE WHEN {_h[2]} <> 0 THEN {_h[0]} / {_h[2]} END, 6) AS field_x, round(CASE WHEN {_h[2]} <> 0 THEN {_h[1]} / {_h[2]} END, 6) AS field_y FROM obs", FOLD),
}


def _mixed(sql: str) -> str:
    """A query over short matches, each with its own rate and picture size."""
    (fps, width, height), (other_fps, other_width, other_height) = MIXED_VIDEOS
    of_match = lambda a, b: f"(CASE WHEN match_id % 2 = 1 THEN {b} ELSE {a} END)"
    rate = of_match(f"{fps}::DOUBLE", f"{other_fps}::DOUBLE")
    return (
        sql.replace("floor(event_id / 10000)", f"floor(event_id / {SHORT_MATCH})")
        .replace("x1 <= 1260", f"x1 <= {of_match(width, other_width)} - 20")
        .replace("y1 <= 700", f"y1 <= {of_match(height, other_height)} - 20")
        .replace("23.976::DOUBLE", rate)
    )


ORACLES |= {
    "event_lines": f"""SELECT match_id, frame, ord, CASE event WHEN 'static' THEN printf('  [ESTÁTICO] ID:%d descartado, slot devuelto', id)
        WHEN 'reid' THEN printf('  [REID] ByteID:%d → ID:%d (dist=%.0fpx)', tid, id, distance) ELSE printf('  [NUEVO] ByteID:%d → ID:%d (pool restante:%d)', tid, id, pool) END AS line
        FROM ({ORACLES["identity_events"]})""",
    "summary_lines": f"""SELECT match_id, CAST(nth AS INT) AS nth, line FROM (SELECT match_id, unnest([
          'Frames procesados:         ' || frames, 'Detecciones totales:       ' || dets_raw, 'Frames sin tracks:         ' || frames_without_tracks,
          'IDs estáticos descartados: ' || static_ids || ' → [' || replace(static_list, ',', ', ') || ']',
          CASE WHEN player_rows > 0 THEN 'IDs únicos jugadores: ' || player_ids END, CASE WHEN player_rows > 0 THEN 'Registros jugadores:  ' || player_rows END,
          CASE WHEN ball_frames > 0 THEN 'Frames con pelota detectada: ' || ball_frames END]) AS line, unnest(range(7)) AS nth FROM ({ORACLES["run_summary"]})) WHERE line IS NOT NULL""",
}
_start = f"CAST(trunc({EARLIER.start_minute}::DOUBLE * 60 * 23.976::DOUBLE) AS BIGINT)"
ORACLES |= {
    "meta_player_filter": _mixed(ORACLES["player_geometry_filter"]),
    "meta_start_prune": _mixed(_sql(f"SELECT * FROM d WHERE frame >= {_start}")),
    "meta_derived": _mixed(_sql(f"SELECT match_id, CAST(round_even(23.976::DOUBLE, 0) AS BIGINT) AS fps_rounded, (max(frame) + 1) / 23.976::DOUBLE / 60 AS minutes, {_start} AS start_frame FROM d GROUP BY match_id")),
    "meta_frame_metrics": _mixed(ORACLES["frame_metrics"]),
    "meta_run_summary": _mixed(ORACLES["run_summary"]),
    "meta_distance_speed": _mixed(ORACLES["ext_distance_speed"]),
}
