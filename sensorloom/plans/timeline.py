"""As-of, window and gating queries over the sensor tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import geometry as geo
from sensorloom.operators import asof, gating, ordered, sync
from sensorloom.plans.base import BLUR, FRAMES, IMU, POSES, blur, frames, imu, poses
from sensorloom.session import cut_lineage, table

XYZ = ["x", "y", "z"]


def _frames_on_poses(spark: SparkSession, d: str) -> DataFrame:
    return asof.bracket(frames(spark, d).select("frame_id", "seq", "us"), poses(spark, d), "seq", "us", "us", XYZ, tie="line")


def j01_asof_interp(spark: SparkSession, d: str) -> DataFrame:
    out = asof.interpolate(_frames_on_poses(spark, d), "us", XYZ)
    return out.where("at_x is not null").select("frame_id", *[F.round(f"at_{c}", 4).alias(c) for c in XYZ])


def j01_asof_slerp(spark: SparkSession, d: str) -> DataFrame:
    b = asof.bracket(frames(spark, d).select("frame_id", "seq", "us"), imu(spark, d).where("quat is not null"), "seq", "us", "us", ["quat"], tie="line")
    q = geo.slerp(F.col("before.quat"), F.col("after.quat"), asof.weight(F.col("us")))
    b = b.where("before is not null and after is not null").select("frame_id", q.alias("q"))
    return b.select("frame_id", F.round(geo.quat_norm(F.col("q")), 6).alias("norm"), *[F.round(F.abs(F.col("q")[c]), 5).alias(f"q{c}") for c in "wxyz"])


def j02_asof_clamp(spark: SparkSession, d: str) -> DataFrame:
    return gating.rate_at(frames(spark, d).select("frame_id", "seq", "us"), imu(spark, d)).select("frame_id", F.round("omega", 4).alias("omega"))


def j03_asof_null_outside(spark: SparkSession, d: str) -> DataFrame:
    out = asof.interpolate(_frames_on_poses(spark, d), "us", ["z"])
    return out.groupBy("seq").agg(F.count("*").alias("asked"), F.count("at_z").alias("inside"))


def j04_asof_tol(spark: SparkSession, d: str) -> DataFrame:
    b = asof.within(_frames_on_poses(spark, d), "us", 10_000)
    return asof.interpolate(b, "us", ["x"]).select("frame_id", F.round("at_x", 4).alias("x"))


def j05_nearest_asof(spark: SparkSession, d: str) -> DataFrame:
    b = asof.bracket(frames(spark, d).select("frame_id", "seq", "us"), poses(spark, d), "seq", "us", "us", ["line"], tie="line")
    return b.select("frame_id", asof.nearest(b, "us")["line"].alias("line")).where("line is not null")


def _streams(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("seq", F.lit("rgb").alias("stream"), "us", F.col("frame_id").alias("id"))
    p = poses(spark, d).select("seq", F.lit("pose").alias("stream"), "us", F.col("line").alias("id"))
    return f.unionByName(p).unionByName(imu(spark, d).select("seq", F.lit("imu").alias("stream"), "us", F.col("line").alias("id")))


def j06_rig_nway(spark: SparkSession, d: str) -> DataFrame:
    s = asof.complete_sets(_streams(spark, d), "seq", "stream", "us", "id", "rgb", ["rgb", "pose", "imu"], 8_000)
    return s.select("entity", F.col("ids")[0].alias("frame_id"), F.col("ids")[1].alias("pose_line"), F.col("ids")[2].alias("imu_line")).withColumnRenamed("entity", "seq")


def j07_neighbour_correction(spark: SparkSession, d: str) -> DataFrame:
    """Every 8th frame's blur corrected from its neighbours: interpolated, one-sided at ends, null over gaps of more than 1 s."""
    b = ordered.adjacent(blur(spark, d).where("us is not null and rate is not null"), ["seq"], "us", ["name"], ["us", "rate"])
    p, n = F.col("prev"), F.col("next")
    near_p, near_n = F.col("us") - p["us"] <= 1_000_000, n["us"] - F.col("us") <= 1_000_000
    mix = p["rate"] + (n["rate"] - p["rate"]) * (F.col("us") - p["us"]) / (n["us"] - p["us"])
    out = F.when(near_p & near_n, mix).when(near_p, p["rate"]).when(near_n, n["rate"])
    return b.select("seq", "name", F.round(out, 4).alias("corrected"))


def w01_delta(spark: SparkSession, d: str) -> DataFrame:
    a = ordered.adjacent(poses(spark, d), ["seq"], "us", ["line"], ["us", *XYZ])
    step = F.coalesce(F.col("next.us") - F.col("us"), F.col("us") - F.col("prev.us"))  # the last row repeats
    return a.select("seq", "line", step.alias("step_us"), ((F.col("next.x") - F.col("prev.x")) / 2).alias("central_x"))


def w02_dedup_consecutive(spark: SparkSession, d: str) -> DataFrame:
    a = ordered.adjacent(imu(spark, d), ["seq"], "us", ["line"], ["ox"]).where("prev is null or prev.ox <> ox")
    return a.groupBy("seq").agg(F.count("*").alias("changes"))


def w03_holdout(spark: SparkSession, d: str) -> DataFrame:
    return ordered.holdout(frames(spark, d).select("frame_id", "seq", "us"), ["seq"], "us", ["frame_id"], 8).select("frame_id", "split")


def w04_halves(spark: SparkSession, d: str) -> DataFrame:
    n = ordered.running(poses(spark, d), ["seq"], "us", ["line"])
    return n.groupBy("seq", (F.col("rn") % 2).alias("half")).agg(F.count("*").alias("n"), F.max("line").alias("last_line"))


def w05_preamble(spark: SparkSession, d: str) -> DataFrame:
    w = sync.motion_windows(imu(spark, d))
    return sync.preamble_end(w).select("seq", "swings", "end_window")


def w06_rolling_median(spark: SparkSession, d: str) -> DataFrame:
    b = blur(spark, d).where("us is not null and rate is not null").select("seq", "name", "us", "rate")
    a = ordered.rolling(b, ["seq"], "us", ["name"], "rate", 3, "median", "nearest")
    return a.select("seq", "name", F.round("rolled", 6).alias("level"))


def w08_segments(spark: SparkSession, d: str) -> DataFrame:
    s = ordered.gap_segments(poses(spark, d).select("seq", "line", "us"), ["seq"], "us", ["line"], 5.0, 16)
    return s.groupBy("seq", "segment").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def w09_merge_close(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("seq", (F.col("us") / 1e6).alias("t"))
    first = f.groupBy("seq").agg(F.min("t").alias("t0"))
    m = ordered.merge_close(f.join(first, "seq").select("seq", F.round(F.col("t") - F.col("t0"), 3).alias("rel")), ["seq"], "rel", 0.15)
    return m.select("seq", "group", "n", F.round("mean", 7).alias("mean"))


def w10_minavg(spark: SparkSession, d: str) -> DataFrame:
    b = blur(spark, d).where("us is not null and rate is not null").select("seq", "name", "us", "rate")
    low = ordered.rolling(b, ["seq"], "us", ["name"], "rate", 4, "min").select("seq", "name", "us", F.col("rolled").alias("low"))
    return ordered.rolling(low, ["seq"], "us", ["name"], "low", 4, "mean", "nearest").select("seq", "name", F.round("rolled", 6).alias("smooth"))


def w11_even_rows(spark: SparkSession, d: str) -> DataFrame:
    from sensorloom.functions.keys import even_rows

    n = ordered.running(poses(spark, d).select("seq", "line", "us"), ["seq"], "us", ["line"])
    picks = n.groupBy("seq").agg((F.max("rn") + 1).alias("k")).select("seq", F.explode(even_rows(F.lit(25).cast("bigint"), F.col("k"))).alias("rn"))
    return n.join(picks, ["seq", "rn"]).select("seq", "line")


def w15_guard(spark: SparkSession, d: str) -> DataFrame:
    """Frames at least three positions from every held-out one."""
    n = ordered.running(frames(spark, d).select("frame_id", "seq", "us"), ["seq"], "us", ["frame_id"])
    test = n.where(F.col("rn") % 8 == 0).select("seq", F.explode(F.sequence(F.col("rn") - 2, F.col("rn") + 2)).alias("rn")).distinct()
    return n.join(test, ["seq", "rn"], "left_anti").select("frame_id")


def w16_slot_best(spark: SparkSession, d: str) -> DataFrame:
    b = blur(spark, d).where("us is not null").select("seq", "name", "us", "rate")
    return ordered.best_per_slot(b, ["seq"], "us", 2_000_000, "rate", "name", highest=False)


def w17_deskew_bins(spark: SparkSession, d: str) -> DataFrame:
    """One interpolated position a 2 ms bin of the depth clock."""
    bins = frames(spark, d).select("seq", (F.bround(F.col("depth_us") / 2000) * 2000).cast("bigint").alias("us")).distinct()
    b = asof.bracket(bins, poses(spark, d), "seq", "us", "us", XYZ, tie="line")
    return asof.interpolate(b, "us", ["x"]).select("seq", "us", F.round("at_x", 4).alias("x"))


def j25_lag_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ordered.lagged_pairs(frames(spark, d).select("seq", "frame_id", "us"), ["seq"], "us", ["frame_id"], "frame_id", 10, 20)


def f01_range_gate(spark: SparkSession, d: str) -> DataFrame:
    return gating.inside_track(frames(spark, d), poses(spark, d)).select("frame_id")


def _gated(spark: SparkSession, d: str) -> DataFrame:
    f = gating.rate_at(frames(spark, d).select("frame_id", "seq", "us", "rgb_name"), imu(spark, d))
    b = blur(spark, d).select(F.col("seq").alias("b_seq"), "name", "rate")
    return f.join(b, (F.col("seq") == F.col("b_seq")) & (F.col("rgb_name") == F.col("name")), "left").drop("b_seq", "name")


def f04_motion_gate(spark: SparkSession, d: str) -> DataFrame:
    rated = cut_lineage(_gated(spark, d))  # a row a frame; the percentile, the gate and the split read it instead of the IMU track
    g = gating.motion_gate(rated, "seq", "omega", 0.6, F.coalesce(F.col("rate") <= 1.0, F.lit(False)))
    return ordered.holdout(g.where("kept"), ["seq"], "us", ["frame_id"], 8).select("frame_id", F.round("threshold", 6).alias("threshold"), "split")


def f05_preamble(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("frame_id", "seq", "us")
    first = f.groupBy("seq").agg((F.min("us") + 3_000_000).alias("end_us"))
    kept, dropped = gating.drop_preamble(f, first, "seq", "us")
    return kept.groupBy("seq").agg(F.count("*").alias("kept")).join(dropped, "seq", "full").select("seq", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


def f15_funnel(spark: SparkSession, d: str) -> DataFrame:
    g = _gated(spark, d)
    tests = [("timed", F.col("us").isNotNull()), ("moving", F.col("omega") > 0.05), ("calm", F.col("omega") < 0.8), ("sharp", F.col("rate") <= 1.0)]
    return gating.funnel(g, ["seq"], tests)


def f11_percentile_crop(spark: SparkSession, d: str) -> DataFrame:
    c = gating.percentile_crop(poses(spark, d), ["seq"], XYZ, 0.02, 0.98, 0.5)
    return c.groupBy("seq").agg(F.count("*").alias("inside"))


def f12_robust_box(spark: SparkSession, d: str) -> DataFrame:
    b = gating.robust_box(poses(spark, d), ["seq"], XYZ, 0.01, 0.99)
    return b.select("seq", *[F.round(f"{e}_{c}", 4).alias(f"{e}_{c}") for c in XYZ for e in ("lo", "hi")])


def a46_xcorr(spark: SparkSession, d: str) -> DataFrame:
    i = imu(spark, d)
    return sync.stream_lag(poses(spark, d), i, sync.track_ends(i)).select("seq", "lag", F.round("lag_ms", 3).alias("lag_ms"))


def a47_drift(spark: SparkSession, d: str) -> DataFrame:
    """Lags of the first and last ten seconds, after the preamble."""
    i = imu(spark, d)
    first = i.groupBy("seq").agg(F.min("us").alias("us"))
    ends = sync.preamble_end(sync.motion_windows(i)).join(first, "seq").select("seq", (F.col("us") + F.col("end_window") * 1_000_000).alias("start_us"))
    return sync.clock_drift(poses(spark, d), i, ends).select("seq", *[F.round(c, 3).alias(c) for c in ("first_ms", "last_ms", "drift_ms")])


def a05_path_length(spark: SparkSession, d: str) -> DataFrame:
    a = ordered.adjacent(poses(spark, d), ["seq"], "us", ["line"], XYZ)
    step = F.sqrt(sum((F.col(c) - F.col(f"prev.{c}")) ** 2 for c in XYZ))
    return a.groupBy("seq").agg(F.round(F.sum(step), 3).alias("length"), *[F.round(F.max(c) - F.min(c), 4).alias(f"extent_{c}") for c in XYZ], *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in XYZ])


def a02_rates(spark: SparkSession, d: str) -> DataFrame:
    return _streams(spark, d).groupBy("seq", "stream").agg(F.round(F.try_divide(F.count("*") - 1, (F.max("us") - F.min("us")) / 1e6), 5).alias("hz"))


_STREAMS = "streams AS (SELECT seq, 'rgb' AS stream, us, frame_id AS id FROM frames UNION ALL SELECT seq, 'pose', us, line FROM poses UNION ALL SELECT seq, 'imu', us, line FROM imu)"


def _near(a: str, b: str, cols: str) -> str:
    """Rows of a with the last row of b at or before (p_) and the first at or after (n_)."""
    take = ", ".join(f"p.{c} AS p_{c}, n.{c} AS n_{c}" for c in cols.split())
    return f"SELECT a.*, {take} FROM {a} a ASOF LEFT JOIN {b} p ON a.seq = p.seq AND a.us >= p.us ASOF LEFT JOIN {b} n ON a.seq = n.seq AND a.us <= n.us"


def _mix(c: str) -> str:
    return f"p_{c} + (n_{c} - p_{c}) * CASE WHEN n_us > p_us THEN (us - p_us) / (n_us - p_us) ELSE 0 END"


_ON_POSES = f"{FRAMES}, {POSES}, br AS ({_near('(SELECT frame_id, seq, us FROM frames)', 'poses', 'us x y z line')})"
_ON_IMU = f"{FRAMES}, {IMU}, br AS ({_near('(SELECT frame_id, seq, us, rgb_name FROM frames)', 'imu', 'us ox oy oz quat')})"
_RATE = f"rates AS (SELECT frame_id, seq, us, rgb_name, sqrt({' + '.join(f'pow(coalesce({_mix(c)}, p_{c}, n_{c}), 2)' for c in ('ox', 'oy', 'oz'))}) AS omega FROM br)"
_GATED = f"{_ON_IMU}, {_RATE}, {BLUR}, gated AS (SELECT r.*, b.rate FROM rates r LEFT JOIN blur b ON r.seq = b.seq AND r.rgb_name = b.name)"
_BLURRED = f"{BLUR}, known AS (SELECT seq, name, us, rate FROM blur WHERE us IS NOT NULL AND rate IS NOT NULL)"


def _padded(value: str, source: str, half: int) -> str:
    """Frames padded by repeating the end rows: list of values around each row."""
    return f"""SELECT a.seq, a.name, a.us, list(b.{value}) AS vals FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY us, name) AS rn, count(*) OVER (PARTITION BY seq) AS n FROM {source}) a
      CROSS JOIN range(-{half}, {half + 1}) s(o) JOIN (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY us, name) AS rn FROM {source}) b ON b.seq = a.seq AND b.rn = greatest(1, least(a.n, a.rn + s.o)) GROUP BY ALL"""


QUERIES = {
    f.__name__: f
    for f in (
        j01_asof_interp, j01_asof_slerp, j02_asof_clamp, j03_asof_null_outside, j04_asof_tol, j05_nearest_asof, j06_rig_nway, j07_neighbour_correction, j25_lag_pairs,
        w01_delta, w02_dedup_consecutive, w03_holdout, w04_halves, w05_preamble, w06_rolling_median, w08_segments, w09_merge_close, w10_minavg, w11_even_rows, w15_guard, w16_slot_best, w17_deskew_bins,
        f01_range_gate, f04_motion_gate, f05_preamble, f11_percentile_crop, f12_robust_box, f15_funnel, a02_rates, a05_path_length, a46_xcorr, a47_drift,
    )
}

ORACLE = {
    "j01_asof_interp": f"WITH {_ON_POSES} SELECT frame_id, round({_mix('x')}, 4) AS x, round({_mix('y')}, 4) AS y, round({_mix('z')}, 4) AS z FROM br WHERE p_us IS NOT NULL AND n_us IS NOT NULL",
    "j02_asof_clamp": f"WITH {_ON_IMU}, {_RATE} SELECT frame_id, round(omega, 4) AS omega FROM rates",
    "j03_asof_null_outside": f"WITH {_ON_POSES} SELECT seq, count(*) AS asked, count(p_us + n_us) AS inside FROM br GROUP BY seq",
    "j04_asof_tol": f"WITH {_ON_POSES} SELECT frame_id, round({_mix('x')}, 4) AS x FROM br WHERE least(us - p_us, n_us - us) <= 10000",
    "j05_nearest_asof": f"WITH {_ON_POSES} SELECT frame_id, CASE WHEN n_us IS NOT NULL AND (p_us IS NULL OR n_us - us < us - p_us) THEN n_line ELSE p_line END AS line FROM br WHERE coalesce(p_us, n_us) IS NOT NULL",
    "j06_rig_nway": f"""WITH {FRAMES}, {POSES}, {IMU}, bp AS ({_near('(SELECT frame_id, seq, us FROM frames)', 'poses', 'us line')}),
        bi AS ({_near('(SELECT frame_id, seq, us FROM frames)', 'imu', 'us line')}),
        p AS (SELECT frame_id, seq, CASE WHEN n_us IS NOT NULL AND (p_us IS NULL OR n_us - us < us - p_us) THEN n_line ELSE p_line END AS pose_line, coalesce(least(us - p_us, n_us - us), us - p_us, n_us - us) AS d FROM bp),
        i AS (SELECT frame_id, CASE WHEN n_us IS NOT NULL AND (p_us IS NULL OR n_us - us < us - p_us) THEN n_line ELSE p_line END AS imu_line, coalesce(least(us - p_us, n_us - us), us - p_us, n_us - us) AS d FROM bi)
        SELECT p.seq, p.frame_id, pose_line, imu_line FROM p JOIN i USING (frame_id) WHERE p.d <= 8000 AND i.d <= 8000""",
    "j07_neighbour_correction": f"""WITH {_BLURRED}, a AS (SELECT seq, name, us, lag(us) OVER w AS pu, lag(rate) OVER w AS pr, lead(us) OVER w AS nu, lead(rate) OVER w AS nr FROM known WINDOW w AS (PARTITION BY seq ORDER BY us, name))
        SELECT seq, name, round(CASE WHEN us - pu <= 1000000 AND nu - us <= 1000000 THEN pr + (nr - pr) * (us - pu) / (nu - pu) WHEN us - pu <= 1000000 THEN pr WHEN nu - us <= 1000000 THEN nr END, 4) AS corrected FROM a""",
    "j25_lag_pairs": f"""WITH {FRAMES}, n AS (SELECT seq, frame_id, row_number() OVER (PARTITION BY seq ORDER BY us, frame_id) - 1 AS rn FROM frames), l AS (SELECT seq, max(rn) - 10 AS last FROM n GROUP BY seq HAVING max(rn) >= 10),
        s AS (SELECT DISTINCT seq, CAST(floor(i * last / 19) AS BIGINT) AS rn FROM l CROSS JOIN range(20) r(i))
        SELECT s.seq, a.frame_id AS first, b.frame_id AS second FROM s JOIN n a ON a.seq = s.seq AND a.rn = s.rn JOIN n b ON b.seq = s.seq AND b.rn = s.rn + 10""",
    "w01_delta": f"WITH {POSES} SELECT seq, line, coalesce(lead(us) OVER w - us, us - lag(us) OVER w) AS step_us, (lead(x) OVER w - lag(x) OVER w) / 2 AS central_x FROM poses WINDOW w AS (PARTITION BY seq ORDER BY us, line)",
    "w02_dedup_consecutive": f"WITH {IMU}, a AS (SELECT seq, ox, lag(ox) OVER (PARTITION BY seq ORDER BY us, line) AS p FROM imu) SELECT seq, count(*) AS changes FROM a WHERE p IS NULL OR p <> ox GROUP BY seq",
    "w03_holdout": f"WITH {FRAMES} SELECT frame_id, CASE WHEN (row_number() OVER (PARTITION BY seq ORDER BY us, frame_id) - 1) % 8 = 0 THEN 'val' ELSE 'train' END AS split FROM frames",
    "w04_halves": f"WITH {POSES}, n AS (SELECT seq, line, (row_number() OVER (PARTITION BY seq ORDER BY us, line) - 1) % 2 AS half FROM poses) SELECT seq, half, count(*) AS n, max(line) AS last_line FROM n GROUP BY ALL",
    "w06_rolling_median": f"WITH {_BLURRED}, p AS ({_padded('rate', 'known', 3)}) SELECT seq, name, round(list_median(vals), 6) AS level FROM p",
    "w08_segments": f"""WITH {POSES}, a AS (SELECT seq, line, us, us - lag(us) OVER (PARTITION BY seq ORDER BY us, line) AS step FROM poses), m AS (SELECT seq, 5.0::DOUBLE * quantile_cont(step, 0.5) AS lim FROM a GROUP BY seq),
        s AS (SELECT a.seq, line, CAST(sum(coalesce(step > lim, false)::INT) OVER (PARTITION BY a.seq ORDER BY us, line) AS BIGINT) AS segment FROM a JOIN m USING (seq))
        SELECT seq, segment, count(*) AS n, min(line) AS first_line, max(line) AS last_line FROM s GROUP BY ALL HAVING count(*) >= 16""",
    "w09_merge_close": f"""WITH {FRAMES}, r AS (SELECT seq, round(us / 1e6 - min(us / 1e6) OVER (PARTITION BY seq), 3) AS rel FROM frames), a AS (SELECT seq, rel, rel - lag(rel) OVER (PARTITION BY seq ORDER BY rel) AS step FROM r),
        g AS (SELECT seq, rel, CAST(sum(coalesce(step >= 0.15::DOUBLE, false)::INT) OVER (PARTITION BY seq ORDER BY rel ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM a)
        SELECT seq, "group", count(*) AS n, round(avg(rel), 7) AS mean FROM g GROUP BY ALL""",
    "w10_minavg": f"""WITH {_BLURRED}, low AS (SELECT seq, name, us, min(rate) OVER (PARTITION BY seq ORDER BY us, name ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS low FROM known),
        p AS ({_padded('low', 'low', 4)}) SELECT seq, name, round(list_avg(vals), 6) AS smooth FROM p""",
    "w11_even_rows": f"""WITH {POSES}, n AS (SELECT seq, line, row_number() OVER (PARTITION BY seq ORDER BY us, line) - 1 AS rn, count(*) OVER (PARTITION BY seq) AS k FROM poses)
        SELECT DISTINCT seq, line FROM n CROSS JOIN range(25) r(i) WHERE (k <= 25 AND i = rn) OR (k > 25 AND rn = CAST(round_even(i * ((k - 1) / 24), 0) AS BIGINT))""",
    "w15_guard": f"WITH {FRAMES}, n AS (SELECT seq, frame_id, row_number() OVER (PARTITION BY seq ORDER BY us, frame_id) - 1 AS rn FROM frames) SELECT frame_id FROM n WHERE NOT EXISTS (SELECT 1 FROM n t WHERE t.seq = n.seq AND t.rn % 8 = 0 AND abs(t.rn - n.rn) <= 2)",
    "w16_slot_best": f"""WITH {BLUR}, s AS (SELECT seq, name, rate, (us - min(us) OVER (PARTITION BY seq)) // 2000000 AS slot FROM blur WHERE us IS NOT NULL)
        SELECT seq, slot, name, rate FROM s WHERE rate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq, slot ORDER BY rate, name) = 1""",
    "w17_deskew_bins": f"""WITH {FRAMES}, {POSES}, b AS (SELECT DISTINCT seq, CAST(round_even(depth_us / 2000, 0) * 2000 AS BIGINT) AS us FROM frames), br AS ({_near('b', 'poses', 'us x')}) SELECT seq, us, round({_mix('x')}, 4) AS x FROM br""",
    "f01_range_gate": f"WITH {FRAMES}, {POSES}, r AS (SELECT seq, min(us) AS lo, max(us) AS hi FROM poses GROUP BY seq) SELECT frame_id FROM frames JOIN r USING (seq) WHERE us BETWEEN lo AND hi AND depth_us BETWEEN lo AND hi",
    "f04_motion_gate": f"""WITH {_GATED}, th AS (SELECT seq, round(quantile_cont(omega, 0.6), 6) AS threshold FROM gated GROUP BY seq), k AS (SELECT g.*, threshold FROM gated g JOIN th USING (seq) WHERE omega <= threshold AND rate <= 1.0)
        SELECT frame_id, threshold, CASE WHEN (row_number() OVER (PARTITION BY seq ORDER BY us, frame_id) - 1) % 8 = 0 THEN 'val' ELSE 'train' END AS split FROM k""",
    "f05_preamble": f"WITH {FRAMES}, e AS (SELECT seq, us, min(us) OVER (PARTITION BY seq) + 3000000 AS e FROM frames) SELECT seq, count(*) FILTER (WHERE us > e) AS kept, count(*) FILTER (WHERE us <= e) AS dropped FROM e GROUP BY seq",
    "f11_percentile_crop": f"""WITH {POSES}, b AS (SELECT seq, {', '.join(f'quantile_cont({c}, 0.02) - 0.5::DOUBLE AS l{c}, quantile_cont({c}, 0.98) + 0.5::DOUBLE AS h{c}' for c in 'xyz')} FROM poses GROUP BY seq)
        SELECT seq, count(*) AS inside FROM poses JOIN b USING (seq) WHERE x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz GROUP BY seq""",
    "f12_robust_box": f"WITH {POSES} SELECT seq, {', '.join(f'round(quantile_cont({c}, {q}), 4) AS {n}_{c}' for c in 'xyz' for n, q in (('lo', 0.01), ('hi', 0.99)))} FROM poses GROUP BY seq",
    "f15_funnel": f"""WITH {_GATED} SELECT seq, count(*) AS "all", count(*) AS timed, count(*) FILTER (WHERE omega > 0.05) AS moving, count(*) FILTER (WHERE omega > 0.05 AND omega < 0.8) AS calm,
        count(*) FILTER (WHERE omega > 0.05 AND omega < 0.8 AND rate <= 1.0) AS sharp FROM gated GROUP BY seq""",
    "a02_rates": f"WITH {FRAMES}, {POSES}, {IMU}, {_STREAMS} SELECT seq, stream, round((count(*) - 1) / nullif((max(us) - min(us)) / 1e6, 0), 5) AS hz FROM streams GROUP BY ALL",
    "a05_path_length": f"""WITH {POSES}, a AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM poses WINDOW w AS (PARTITION BY seq ORDER BY us, line))
        SELECT seq, round(sum(step), 3) AS length, {', '.join(f'round(max({c}) - min({c}), 4) AS extent_{c}, round(avg({c}), 4) AS mean_{c}' for c in 'xyz')} FROM a GROUP BY seq""",
}
_SHARE = "CASE WHEN n_us > p_us THEN (us - p_us) / (n_us - p_us) ELSE 0.0::DOUBLE END"
ORACLE["j01_asof_slerp"] = f"""WITH {FRAMES}, {IMU}, turned AS (SELECT * FROM imu WHERE quat IS NOT NULL), br AS ({_near('(SELECT frame_id, seq, us FROM frames)', 'turned', 'us quat')}),
    a AS (SELECT frame_id, p_quat AS p, n_quat AS n, {_SHARE} AS s, {' + '.join(f'p_quat.{c} * n_quat.{c}' for c in 'xyzw')} AS dot FROM br WHERE p_us IS NOT NULL AND n_us IS NOT NULL),
    b AS (SELECT *, least(1, abs(dot)) AS c, acos(least(1, abs(dot))) AS angle, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sign FROM a),
    k AS (SELECT *, CASE WHEN c > 0.9995 THEN 1 - s ELSE sin((1 - s) * angle) / sin(angle) END AS u, sign * CASE WHEN c > 0.9995 THEN s ELSE sin(s * angle) / sin(angle) END AS v FROM b),
    m AS (SELECT frame_id, {', '.join(f'p.{c} * u + n.{c} * v AS {c}' for c in 'wxyz')} FROM k), q AS (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS len FROM m)
    SELECT frame_id, round(sqrt({' + '.join(f'({c} / len) * ({c} / len)' for c in 'wxyz')}), 6) AS norm, {', '.join(f'round(abs({c} / len), 5) AS q{c}' for c in 'wxyz')} FROM q"""
ORACLE["w05_preamble"] = f"""WITH {IMU}, e AS (SELECT seq, min(us) AS t0, max(us) AS t1, count(*) AS total FROM imu GROUP BY seq), j AS (SELECT i.seq, (us - t0) // 1000000 AS win, CAST(ceil((t1 - t0) / 1000000) AS BIGINT) AS windows, total, ox, oy, oz FROM imu i JOIN e USING (seq)),
    g AS (SELECT seq, win, windows, total, count(*) AS rows, avg(sqrt(ox * ox + oy * oy + oz * oz)) AS level, stddev_pop(ox) AS sx, stddev_pop(oy) AS sy, stddev_pop(oz) AS sz FROM j GROUP BY ALL),
    w AS (SELECT seq, win, windows, total, CASE WHEN rows < 3 THEN 0 ELSE level END AS level, CASE WHEN rows < 3 THEN 0 ELSE greatest(sx, sy, sz) / (sx + sy + sz + 1e-9::DOUBLE) END AS share FROM g WHERE win < windows),
    m AS (SELECT seq, quantile_cont(level, 0.5) / 2 AS thr FROM w WHERE level > 1e-6::DOUBLE GROUP BY seq), a AS (SELECT w.*, thr FROM w JOIN m USING (seq) WHERE total >= 30 AND windows >= 4),
    n AS (SELECT a.*, coalesce(b.level, 0) AS l1, coalesce(c.level, 0) AS l2 FROM a LEFT JOIN a b ON b.seq = a.seq AND b.win = a.win + 1 LEFT JOIN a c ON c.seq = a.seq AND c.win = a.win + 2),
    s AS (SELECT seq, windows, win, level > thr AND share > 0.6::DOUBLE AND win < least(25, windows) AS swing, level > thr AND l1 > thr AND l2 > thr AND share < 0.55::DOUBLE AND win < windows - 3 AS calm FROM n),
    f AS (SELECT seq, windows, count(*) FILTER (WHERE swing) AS swings, min(win) FILTER (WHERE swing) AS first, max(win) FILTER (WHERE swing) AS last FROM s GROUP BY ALL),
    k AS (SELECT f.seq, min(win) AS start FROM f JOIN s ON s.seq = f.seq AND calm AND win > first GROUP BY f.seq)
    SELECT f.seq, swings, CASE WHEN swings > 0 THEN coalesce(start, least(last + 1, windows - 1)) END AS end_window FROM f LEFT JOIN k ON k.seq = f.seq"""
