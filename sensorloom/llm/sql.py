"""SQL with the same results as the queries of this subpackage, for those that SQL can express."""

_RECORDS = r"""
records AS (
  SELECT DISTINCT rec_id, seq, split,
    ltrim(regexp_extract(regexp_extract(rgb_name, '([^/\\]*)$', 1), '([0-9]+)', 1), '0') AS digits,
    CASE WHEN len(tmat) >= 12 AND len(list_filter(tmat[1:12], lambda v: v IS NOT NULL AND NOT isnan(v) AND abs(v) < 1e9)) = 12 THEN tmat END AS m
  FROM split_frames WHERE seq IS NOT NULL AND rec_id IS NOT NULL AND split IN ('train', 'val', 'test')
), stamped AS (
  SELECT *, CASE WHEN length(digits) BETWEEN 1 AND 16 THEN CAST(digits AS HUGEINT) * 1000 WHEN length(digits) BETWEEN 17 AND 19 THEN CAST(digits AS HUGEINT) END AS stamp FROM records
), pairs AS (
  SELECT e.seq, e.rec_id AS eval_id, e.split AS eval_split, t.rec_id AS train_id,
    coalesce(e.stamp = t.stamp, false) AS same_stamp,
    coalesce((e.m[4] - t.m[4])**2 + (e.m[8] - t.m[8])**2 + (e.m[12] - t.m[12])**2 <= 0.0004
      AND e.m[1]*t.m[1] + e.m[2]*t.m[2] + e.m[3]*t.m[3] + e.m[5]*t.m[5] + e.m[6]*t.m[6] + e.m[7]*t.m[7] + e.m[9]*t.m[9] + e.m[10]*t.m[10] + e.m[11]*t.m[11]
        >= 1 + 2 * cos(radians(1.0)), false) AS same_pose,
    (e.stamp IS NOT NULL)::INT + (e.m IS NOT NULL)::INT AS kinds
  FROM stamped e JOIN stamped t ON e.seq = t.seq WHERE e.split <> 'train' AND t.split = 'train'
), hits AS (
  SELECT seq, eval_id, eval_split, train_id, bool_or(same_stamp) AS same_stamp, bool_or(same_pose) AS same_pose, max(kinds) AS kinds
  FROM pairs WHERE same_stamp OR same_pose GROUP BY ALL
)
"""

_CUTOFFS = """
frames AS (
  SELECT seq, name, min(rate_px_per_ms_med) AS rate FROM per_frame
  WHERE seq IS NOT NULL AND rate_px_per_ms_med IS NOT NULL AND NOT isnan(rate_px_per_ms_med) AND NOT isinf(rate_px_per_ms_med) AND rate_px_per_ms_med >= 0 GROUP BY seq, name
), fractions AS (
  SELECT seq, max(keep_fraction) AS q FROM recordings WHERE seq IS NOT NULL AND keep_fraction > 0 AND keep_fraction <= 1 GROUP BY seq
), ranked AS (
  SELECT f.seq, f.rate, q, count(*) OVER (PARTITION BY f.seq) AS n, count(*) OVER (PARTITION BY f.seq ORDER BY f.rate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM frames f JOIN fractions USING (seq)
), cutoffs AS (
  SELECT seq, any_value(n) AS n, CAST(ceil(any_value(q) * any_value(n)) AS BIGINT) AS need, min(rate) FILTER (WHERE upto >= q * n) AS cutoff FROM ranked GROUP BY seq
)
"""

_READINGS = """
frames AS (
  SELECT frame_id, seq, min(CAST(round(t * 1e6) AS BIGINT)) FILTER (WHERE NOT isnan(t)) AS t, min(CAST(round(t_depth * 1e6) AS BIGINT)) FILTER (WHERE NOT isnan(t_depth)) AS t_depth
  FROM frame_record WHERE frame_id IS NOT NULL AND seq IS NOT NULL GROUP BY ALL
), asked AS (
  SELECT frame_id, seq, 'rgb_pose' AS clock, 'pose' AS track, t AS us, 20000 AS tol FROM frames UNION ALL
  SELECT frame_id, seq, 'depth_pose', 'pose', coalesce(t_depth, t), 20000 FROM frames UNION ALL
  SELECT frame_id, seq, 'rgb_imu', 'imu', t, 8000 FROM frames
), readings AS (
  SELECT DISTINCT 'pose' AS track, seq, line, CAST(round(t * 1e6) AS BIGINT) AS us FROM pose_track WHERE t IS NOT NULL AND NOT isnan(t) AND seq IS NOT NULL AND line IS NOT NULL UNION ALL
  SELECT DISTINCT 'imu', seq, line, CAST(round(t * 1e6) AS BIGINT) FROM imu_track WHERE t IS NOT NULL AND NOT isnan(t) AND seq IS NOT NULL AND line IS NOT NULL
), keyed AS (
  SELECT *, unnest(range(us // 20000 - 1, us // 20000 + 2)) AS tick FROM readings
), near AS (
  SELECT a.frame_id, a.clock, r.line, abs(r.us - a.us) AS d, r.us FROM asked a JOIN keyed r ON r.seq = a.seq AND r.track = a.track AND r.tick = a.us // 20000 WHERE abs(r.us - a.us) <= a.tol
), matched AS (
  SELECT frame_id, clock, line, d FROM near QUALIFY row_number() OVER (PARTITION BY frame_id, clock ORDER BY d, us, line) = 1
)
"""

ORACLE = {
    "p1_found": f"WITH {_RECORDS} SELECT DISTINCT least(eval_id, train_id) AS rec_a, greatest(eval_id, train_id) AS rec_b FROM hits WHERE eval_id <> train_id",
    "p1_report": f"""WITH {_RECORDS}, per AS (
        SELECT eval_split, seq, eval_id, count(*) AS links, max((same_stamp::INT + same_pose::INT) / kinds) AS containment FROM hits GROUP BY ALL)
        SELECT eval_split, seq, count(*) AS eval_records, CAST(sum(links) AS BIGINT) AS links, count(*) FILTER (WHERE containment >= 1) AS contained_whole FROM per GROUP BY ALL""",
    "p1_classes": f"""WITH {_RECORDS}, raw AS (
        SELECT DISTINCT rec_id, seq, split, ltrim(regexp_extract(regexp_extract(rgb_name, '([^/\\\\]*)$', 1), '([0-9]+)', 1), '0') AS digits, tmat[1:12] AS m FROM split_frames WHERE seq IS NOT NULL AND rec_id IS NOT NULL AND split IS NOT NULL
        ), coded AS (SELECT *, CASE WHEN length(digits) BETWEEN 1 AND 16 THEN CAST(digits AS HUGEINT) * 1000 WHEN length(digits) BETWEEN 17 AND 19 THEN CAST(digits AS HUGEINT) END AS stamp FROM raw
        ), cls AS (SELECT DISTINCT rec_id, min(rec_id) OVER (PARTITION BY seq, split, stamp, m) AS class_id FROM coded
        ), k AS (SELECT DISTINCT e.class_id AS a, t.class_id AS b FROM hits h JOIN cls e ON e.rec_id = h.eval_id JOIN cls t ON t.rec_id = h.train_id
        ), n AS (SELECT class_id, count(*) AS links FROM (SELECT a AS class_id FROM k UNION ALL SELECT b FROM k) GROUP BY 1)
        SELECT rec_id, class_id, coalesce(links, 0) AS links FROM cls LEFT JOIN n USING (class_id)""",
    "p3_found": f"WITH {_CUTOFFS} SELECT f.seq, f.name FROM frames f JOIN cutoffs c USING (seq) WHERE f.rate <= c.cutoff",
    "p3_cutoffs": f"""WITH {_CUTOFFS} SELECT c.seq, c.n, c.need, count(*) FILTER (WHERE f.rate <= c.cutoff) AS kept, c.cutoff,
        round(sum(CASE WHEN f.rate > c.cutoff THEN q * (f.rate - c.cutoff) ELSE (1 - q) * (c.cutoff - f.rate) END) + 2e-9, 6) AS loss FROM frames f JOIN cutoffs c USING (seq) JOIN fractions USING (seq) GROUP BY c.seq, c.n, c.need, c.cutoff""",
    "p4_found": f"WITH {_READINGS} SELECT frame_id, clock, line FROM matched",
    "p4_offsets": f"WITH {_READINGS} SELECT clock, count(*) AS matched, max(d) AS worst_us, CAST(sum(d) AS BIGINT) AS total_us FROM matched GROUP BY clock",
}
