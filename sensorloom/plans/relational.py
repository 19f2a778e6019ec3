"""Set, sampling, statistics and rollup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import keys
from sensorloom.operators import gating
from sensorloom.operators import relational as rel
from sensorloom.operators.spatial import voxel_mean
from sensorloom.operators.fitting import geometry_scores
from sensorloom.operators.regular_grid import micros
from sensorloom.plans.base import BLUR, FRAMES, IMU, POSES, VIEWS, blur, frames, imu, poses, views
from sensorloom.session import table



def a01_stats(spark: SparkSession, d: str) -> DataFrame:
    s = rel.summary(imu(spark, d).withColumn("w", F.sqrt(F.col("ox") ** 2 + F.col("oy") ** 2 + F.col("oz") ** 2)), ["seq"], "w")
    return s.select("seq", "n", *[F.round(c, 5).alias(c) for c in ("median", "p10", "p90", "p95", "max")])


def a03_percentile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.6), 6).alias("p60"))


def a04_population_std(spark: SparkSession, d: str) -> DataFrame:
    return blur(spark, d).groupBy("seq").agg(F.round(F.stddev_pop("rate"), 6).alias("std"), F.round(F.var_pop("rate"), 6).alias("var"))


def a16_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q, cents = F.col("l_quantity").cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return li.groupBy("l_partkey").agg(F.try_divide(F.sum(q * cents).cast("double"), F.sum(q).cast("double")).alias("price"))


def a18_cond_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of usable frames that are not blurred, per recording, then its plain mean over recordings of a site."""
    b = blur(spark, d).groupBy("seq").agg(F.count("rate").alias("valid"), F.count_if(F.col("rate") > 1).alias("blurred")).where("valid > 0")
    r = table(spark, d, "recordings").select("seq", "site").dropDuplicates(["seq"])
    return b.join(r, "seq").groupBy("site").agg(F.round(F.avg(1 - F.col("blurred") / F.col("valid")), 6).alias("sharp"), F.count("*").alias("recordings"))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_shipdate", "l_suppkey", (F.col("l_discount") * F.col("l_tax")).alias("se"), F.col("l_quantity").alias("px"))


def a19_pooled_vs_macro(spark: SparkSession, d: str) -> DataFrame:
    p = rel.pooled_and_macro(_pixels(spark, d).withColumn("frame", F.to_date("l_shipdate")), ["l_suppkey"], "frame", "se", "px", 20)
    return p.select("l_suppkey", "frames", F.round("macro_psnr", 4).alias("macro_psnr"), F.round("pooled_psnr", 4).alias("pooled_psnr"))


def a21_ssim(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 12).alias("b"))
    return rel.global_ssim(li, ["l_partkey"], "a", "b").select("l_partkey", F.round("ssim", 5).alias("ssim"), F.round("psnr", 4).alias("psnr"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.concat(F.lit("report/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.lit("m").alias("chain"),
        F.col("p_brand").alias("seq"), (F.col("p_size") % 3).cast("bigint").alias("n"), F.col("p_type").alias("set_name"), F.col("p_name").alias("tag"),
        F.when(F.col("p_size") % 2 == 0, F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))).alias("pred_dir"),
        (F.col("p_retailprice") / 50).alias("psnr"), (F.col("p_size") / 50.0).alias("ssim"), F.round(F.col("p_retailprice") % 1, 1).alias("lpips"),
    )


def a20_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return rel.leaderboard(_records(spark, d)).select("seq", "n", "set_name", "rank", "path", F.round("psnr", 6).alias("psnr"), "best", "group_size")


def a22_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rel.spearman(blur(spark, d), ["seq"], "rate", "omega").select("seq", "n", F.round("rho", 6).alias("rho"))


def a23_trimmed_ols(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice")).alias("y"))
    t = rel.trimmed_line(li, ["l_returnflag"], "x", "y")
    return t.select("l_returnflag", "n", F.round("slope", 3).alias("slope"), F.round("r2", 5).alias("r2"), "accepted")


def a24_cum_share(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", F.floor(F.col("o_totalprice")).cast("double").alias("w"))
    return rel.carriers(o, ["o_orderstatus"], "o_orderkey", "w", 0.8).select("o_orderstatus", "o_orderkey")


def a25_chunk_quant(spark: SparkSession, d: str) -> DataFrame:
    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000").select("seq", "line", "x", "y", "z")
    c = rel.quantised_chunks(p, ["seq"], ["line"], ["x", "y", "z"], [2047, 1023, 2047])
    return c.select("seq", "line", "chunk", "code_x", "code_y", "code_z")


def a27_overlap_classes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    classes = [("cheap", F.col("l_extendedprice") < 20000), ("late", F.month("l_shipdate") > 9), ("big", F.col("l_quantity") >= 40)]
    return rel.overlapping_classes(li, ["l_returnflag"], classes, "l_quantity").select("l_returnflag", "class", "rows", F.round("weight_share", 6).alias("weight_share"))


def a28_case_classes(spark: SparkSession, d: str) -> DataFrame:
    b = blur(spark, d)
    c = F.when(F.col("rate").isNull(), "unknown").when(F.col("rate") <= 0.2, "sharp").when((F.col("rate") <= 1) & (F.col("used") == 1), "usable").when(F.col("rate") <= 1, "unused").otherwise("blurred")
    g = b.groupBy("seq", c.alias("class")).agg(F.count("*").alias("n"))
    total = b.groupBy("seq").agg(F.count("*").alias("all"))
    return g.join(total, "seq").select("seq", "class", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def a29_fscore(spark: SparkSession, d: str) -> DataFrame:
    """How well the views of a recording lie on its path: distances to the nearest neighbour both ways, at three thresholds."""
    rec = views(spark, d).select("seq", F.col("rec_id").alias("id"), *[F.col("tmat")[i].alias(c) for c, i in zip("xyz", (3, 7, 11))])
    whole = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < 1000" for c in "xyz")
    truth = poses(spark, d).select("seq", F.col("line").alias("id"), "x", "y", "z")
    s = geometry_scores(rec.where(whole), truth.where(whole), ["seq"], "id", [0.01, 0.05, 0.1], 0.2)
    return s.select("seq", "threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


def a30_depth_report(spark: SparkSession, d: str) -> DataFrame:
    """Depth-like errors: predicted total price against the truth per priority."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("pred")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    e = F.abs(F.col("pred") - F.col("o_totalprice"))
    return o.groupBy("o_orderpriority").agg(
        F.round(F.count("pred") / F.count("*"), 6).alias("coverage"), F.round(F.avg(e / F.col("o_totalprice")), 5).alias("abs_rel"), F.round(F.median(e), 3).alias("median_abs"),
        F.round(F.avg((e < 0.05 * F.col("o_totalprice")).cast("double")), 6).alias("within5"),
    )


def a31_gate(spark: SparkSession, d: str) -> DataFrame:
    b = blur(spark, d).groupBy("seq").agg(F.count("*").alias("frames"), F.count("rate").alias("known"), F.percentile("rate", 0.5).alias("median"), F.max("omega").alias("fastest"))
    return gating.verdict(b, ["seq"], [("known_share", F.round(F.col("known") / F.col("frames"), 6), ">=", 0.9), ("median_rate", F.round("median", 6), "<=", 0.5), ("fastest", F.col("fastest"), "<=", 3.0)])


def a52_cost(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("key"), (F.length("text") * 0.5).alias("usd"), F.length("text").cast("bigint").alias("tokens"))
    return rel.cost_rollup(doc, ["source"], "key", ["doc_id"], "usd", ["tokens"])


def a53_summary(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recordings").dropDuplicates(["seq"]).select("seq", "platform")
    f = frames(spark, d).groupBy("seq").agg(F.count("*").alias("frames"))
    b = blur(spark, d).groupBy("seq").agg(F.count_if(F.col("rate") > 1).alias("blurred"))
    j = r.join(f, "seq", "left").join(b, "seq", "left")
    return j.select("seq", "platform", "frames", "blurred", (F.col("blurred") > 0.2 * F.col("frames")).alias("rejected"))


def j08_inner(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("seq", "frame_id", F.col("rgb_name").alias("name"))
    return f.join(blur(spark, d), ["seq", "name"]).select("frame_id", "rate")


def j09_left_default(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("seq", "frame_id", F.col("rgb_name").alias("name"))
    return f.join(blur(spark, d), ["seq", "name"], "left").select("frame_id", F.coalesce("rate", F.lit(99.0)).alias("rate"))


def j10_semi(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("seq", "frame_id", F.col("rgb_name").alias("name"))
    return f.join(blur(spark, d).where("used = 1"), ["seq", "name"], "left_semi").select("frame_id")


def j11_anti(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("seq", "frame_id", F.col("rgb_name").alias("name"))
    return f.join(blur(spark, d).where("used = 1"), ["seq", "name"], "left_anti").select("frame_id")


def j12_accept_gate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("set")).agg(
        F.avg(F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice"))).alias("b1"), F.avg(F.when(F.col("p_size") % 2 == 1, F.col("p_retailprice"))).alias("c1"),
        F.avg(F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 100)).alias("b2"), F.avg(F.when(F.col("p_size") % 2 == 1, F.col("p_size") / 100)).alias("c2"),
    )
    long = p.select("set", F.explode(F.array(F.struct(F.lit("psnr").alias("metric"), F.round("b1", 4).alias("baseline"), F.round("c1", 4).alias("candidate")), F.struct(F.lit("lpips").alias("metric"), F.round("b2", 6).alias("baseline"), F.round("c2", 6).alias("candidate")))).alias("m")).select("set", "m.*")
    return rel.accept_gate(long, "set", "metric", "baseline", "candidate").select("set", "metric", F.round("delta", 4).alias("delta"), "worse")


def j31_sweep_argmin(spark: SparkSession, d: str) -> DataFrame:
    """Clock offset of each recording's frames, in ms, at which the gyro's rate is closest to the stated one: 100 ms to both sides in steps of 20, then 20 in steps of 4 around the best."""
    f = table(spark, d, "per_frame").where("seq is not null and name is not null and t is not null and not isnan(t) and omega_mocap is not null and not isnan(omega_mocap)")
    f = f.groupBy("seq", "name").agg(F.min("t").alias("t"), F.min("omega_mocap").alias("stated")).select("seq", "name", micros(F.col("t")).alias("us"), "stated")
    gyro = imu(spark, d)

    def cost(candidates: DataFrame) -> DataFrame:
        moved = f.join(candidates, "seq").withColumn("at", F.col("us") + F.col("candidate") * 1000)
        r = gating.rate_at(moved, gyro, "at")
        return r.groupBy("seq", "candidate").agg(F.round(F.avg(F.abs(F.col("omega") - F.col("stated"))), 7).alias("cost"))

    best = rel.two_level_sweep(f.select("seq").distinct(), ["seq"], cost, 100, 20, 4)
    return best.select("seq", "candidate", "cost")


def j33_cache(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose content was asked before in another source."""
    doc = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    first = rel.first_wins(doc, ["key"], ["doc_id"]).select("key", F.col("doc_id").alias("first_id"))
    j = doc.join(first, "key")
    return j.groupBy("source").agg(F.count("*").alias("calls"), F.count_if(F.col("doc_id") != F.col("first_id")).alias("hits"))


def u01_union_reduce(spark: SparkSession, d: str) -> DataFrame:
    a = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000").select("seq", "x", "y", "z")
    b = views(spark, d).select("seq", *[F.col("tmat")[i].alias(c) for c, i in zip("xyz", (3, 7, 11))])
    return voxel_mean(a.unionByName(b), ["seq"], 0.5).select("seq", "ix", "iy", "iz", "n", F.round("x", 4).alias("x"))


def u02_offset_union(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return rel.offset_union(s, c, "id", 1_000_000)


def u03_rename(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("name"), "p_partkey")
    return rel.rename_collisions(p, "name", ["p_partkey"]).select("p_partkey", "new_name")


def u04_first_wins(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "per_frame").where("seq is not null and name is not null").select("name", "seq", "used")
    return rel.first_wins(b, ["name"], ["seq", "used"])


def u05_diff(spark: SparkSession, d: str) -> DataFrame:
    a = frames(spark, d).select("seq", F.col("rgb_name").alias("name"))
    b = blur(spark, d).where("rate is not null").select("seq", "name")
    i = a.intersect(b).select("seq", "name", F.lit("both").alias("side"))
    return i.unionByName(a.subtract(b).select("seq", "name", F.lit("frames").alias("side"))).unionByName(b.subtract(a).select("seq", "name", F.lit("blur").alias("side")))


def u06_and_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") != "R").alias("kept"))


def u07_sorted_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frame_record").where("depth_name is not null").select(keys.stem(F.col("depth_name")).alias("stem")).distinct()


def u08_split_check(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "split_frames").where("rec_id is not null").select("rec_id", "split").distinct()
    return rel.split_mismatches(s, "rec_id", "split", 8).groupBy("split").agg(F.count("*").alias("mismatches"))


def l02_topk(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("seq").orderBy(F.desc_nulls_last("rate"), "name")
    return blur(spark, d).select("seq", "name", "rate", F.row_number().over(w).alias("rank")).where("rank <= 15")


def l04_sample(spark: SparkSession, d: str) -> DataFrame:
    return rel.hashed_sample(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 500)


def l05_stride(spark: SparkSession, d: str) -> DataFrame:
    return rel.stride_sample(poses(spark, d), "line", 4).groupBy("seq").agg(F.count("*").alias("n"))


def l06_weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    return rel.weighted_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 500)


def w14_only_in_window(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.month("l_shipdate").cast("bigint").alias("m"))
    return rel.only_inside_window(li, ["l_suppkey"], "l_partkey", "m", 4).select("l_suppkey", "start", "samples")


def w20_top_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Parts kept by the top tenth of the price within their brand, and the share of price kept."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("p_brand")
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rk"), F.count("*").over(w).alias("n"))
    g = p.groupBy("p_brand").agg(F.count_if(F.col("rk") <= F.ceil(F.col("n") * 0.1)).alias("kept"), F.round(F.sum(F.when(F.col("rk") <= F.ceil(F.col("n") * 0.1), F.col("p_retailprice"))) / F.sum("p_retailprice"), 6).alias("share"))
    return g


def f09_shapes(spark: SparkSession, d: str) -> DataFrame:
    p = poses(spark, d).where("abs(x) < 1000 and abs(y) < 1000 and abs(z) < 1000")
    s = F.array(F.abs("x") + 0.001, F.abs("y") + 0.001, F.abs("z") + 0.001)
    return p.select("seq", gating.shape_class(s, giant=15.0).alias("shape")).groupBy("seq", "shape").agg(F.count("*").alias("n"))


def f02_ranges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    m = gating.depth_metres(F.col("l_quantity").cast("int"), 0.1, 7, 0.5, 4.0)
    inside = gating.lidar_range(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), 2.0, 40.0)
    return li.groupBy("l_returnflag").agg(F.count(m).alias("valid"), F.round(F.max(m), 6).alias("deepest"), F.count_if(inside).alias("ranged"))


def x18_stamps(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "frame_record").where("frame_id is not null").dropDuplicates(["frame_id"])
    n = keys.leading_integer(F.col("rgb_name"))
    return f.select("frame_id", n.alias("stamp"), F.round(keys.stamp_seconds(n.cast("string")), 3).alias("seconds"), F.regexp_replace(keys.stem(F.col("rgb_name")), "_rgb$", "").alias("stem"))


def x24_hash_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256).alias("key"))


def s21_json_tree(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), keys.first_object(F.col("props")).isNotNull().alias("parses"))


def _sweep_sql(name: str, candidates: str) -> str:
    """CTEs {name}_best: seq, candidate and cost of the best of the candidates."""
    value = lambda c: f"coalesce(p.{c} + (n.{c} - p.{c}) * CASE WHEN n.us > p.us THEN (m.at - p.us) / (n.us - p.us) ELSE 0 END, p.{c}, n.{c})"
    rate = f"sqrt({' + '.join(f'pow({value(c)}, 2)' for c in ('ox', 'oy', 'oz'))})"
    return f"""{name}_m AS (SELECT f.seq, stated, candidate, us + candidate * 1000 AS at FROM f JOIN {candidates} k ON k.seq = f.seq),
        {name}_c AS (SELECT m.seq, m.candidate, round(avg(abs({rate} - stated)), 7) AS cost FROM {name}_m m ASOF LEFT JOIN imu p ON m.seq = p.seq AND m.at >= p.us ASOF LEFT JOIN imu n ON m.seq = n.seq AND m.at <= n.us GROUP BY ALL),
        {name}_best AS (SELECT * FROM {name}_c WHERE cost IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq ORDER BY cost, candidate) = 1)"""


_P = f"{POSES}, pts AS (SELECT seq, line, x, y, z FROM poses WHERE abs(x) < 1000 AND abs(y) < 1000 AND abs(z) < 1000)"

QUERIES = {
    f.__name__: f
    for f in (
        a01_stats, a03_percentile, a04_population_std, a16_weighted_mean, a18_cond_ratio, a19_pooled_vs_macro, a20_leaderboard, a21_ssim, a22_spearman, a23_trimmed_ols, a24_cum_share, a25_chunk_quant, a27_overlap_classes, a28_case_classes, a29_fscore, a30_depth_report, a31_gate, a52_cost, a53_summary,
        j08_inner, j09_left_default, j10_semi, j11_anti, j12_accept_gate, j31_sweep_argmin, j33_cache, u01_union_reduce, u02_offset_union, u03_rename, u04_first_wins, u05_diff, u06_and_merge, u07_sorted_distinct, u08_split_check,
        l02_topk, l04_sample, l05_stride, l06_weighted_sample, w14_only_in_window, w20_top_fraction, f02_ranges, f09_shapes, x18_stamps, x24_hash_key, s21_json_tree,
    )
}

_FB = f"{FRAMES}, {BLUR}"
ORACLE = {
    "a01_stats": f"WITH {IMU}, w AS (SELECT seq, sqrt(pow(ox, 2) + pow(oy, 2) + pow(oz, 2)) AS w FROM imu) SELECT seq, count(*) AS n, {', '.join(f'round(quantile_cont(w, {q}), 5) AS {n}' for q, n in ((0.5, 'median'), (0.1, 'p10'), (0.9, 'p90'), (0.95, 'p95')))}, round(max(w), 5) AS max FROM w GROUP BY seq",
    "a03_percentile": "SELECT event_type, round(quantile_cont(value, 0.6), 6) AS p60 FROM events GROUP BY event_type",
    "a04_population_std": f"WITH {BLUR} SELECT seq, round(stddev_pop(rate), 6) AS std, round(var_pop(rate), 6) AS var FROM blur GROUP BY seq",
    "a16_weighted_mean": "SELECT l_partkey, sum(CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / nullif(sum(CAST(l_quantity AS BIGINT))::DOUBLE, 0) AS price FROM lineitem GROUP BY l_partkey",
    "a18_cond_ratio": f"WITH {BLUR}, b AS (SELECT seq, count(rate) AS valid, count(*) FILTER (WHERE rate > 1) AS blurred FROM blur GROUP BY seq HAVING count(rate) > 0) SELECT site, round(avg(1 - blurred / valid), 6) AS sharp, count(*) AS recordings FROM b JOIN recordings USING (seq) GROUP BY site",
    "a19_pooled_vs_macro": """WITH f AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS frame, sum(l_discount * l_tax) AS se, sum(l_quantity) AS px FROM lineitem GROUP BY ALL HAVING sum(l_quantity) >= 20)
        SELECT l_suppkey, count(*) AS frames, round(avg(CASE WHEN se / px > 0 THEN -10 * log10(se / px) ELSE 'inf'::DOUBLE END), 4) AS macro_psnr, round(-10 * log10(sum(se) / sum(px)), 4) AS pooled_psnr FROM f GROUP BY l_suppkey""",
    "a20_leaderboard": """WITH r AS (SELECT 'report/' || p_brand || '/' || p_partkey AS path, 'm' AS chain, p_brand AS seq, CAST(p_size % 3 AS BIGINT) AS n, p_type AS set_name, CASE WHEN p_size % 2 = 0 THEN p_brand || '-' || p_size END AS pred_dir, p_retailprice / 50 AS psnr, round(p_retailprice % 1, 1) AS lpips FROM part),
        d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY coalesce(pred_dir, path || chr(1) || chain) ORDER BY path, chain) = 1),
        w AS (SELECT *, count(*) OVER g AS group_size, coalesce(lpips = min(lpips) OVER g, false) AS best, CAST(row_number() OVER (PARTITION BY seq, n, set_name ORDER BY psnr DESC NULLS LAST, path, chain) AS INTEGER) AS rank FROM d WINDOW g AS (PARTITION BY seq, n, set_name))
        SELECT seq, n, set_name, rank, path, round(psnr, 6) AS psnr, best, group_size FROM w WHERE group_size >= 2 AND rank <= 15""",
    "a21_ssim": """WITH g AS (SELECT l_partkey, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab, avg((a - b) * (a - b)) AS mse FROM (SELECT l_partkey, l_discount * 10 AS a, l_tax * 12 AS b FROM lineitem) GROUP BY l_partkey)
        SELECT l_partkey, round(((2 * ma * mb + 0.0001::DOUBLE) * (2 * cab + 0.0009::DOUBLE)) / ((ma * ma + mb * mb + 0.0001::DOUBLE) * (va + vb + 0.0009::DOUBLE)), 5) AS ssim, round(CASE WHEN mse > 0 THEN -10 * log10(mse) ELSE 'inf'::DOUBLE END, 4) AS psnr FROM g""",
    "a22_spearman": f"""WITH {BLUR}, d AS (SELECT seq, rate, omega FROM blur WHERE rate IS NOT NULL AND omega IS NOT NULL), r AS (SELECT seq, rank() OVER (PARTITION BY seq ORDER BY rate) + (count(*) OVER (PARTITION BY seq, rate) - 1) / 2 AS a, rank() OVER (PARTITION BY seq ORDER BY omega) + (count(*) OVER (PARTITION BY seq, omega) - 1) / 2 AS b FROM d)
        SELECT seq, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY seq""",
    "a23_trimmed_ols": """WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY 1), r AS (SELECT l.l_returnflag, l_quantity AS x, l_extendedprice AS y, abs(l_extendedprice - s * l_quantity - i) AS r FROM lineitem l JOIN f USING (l_returnflag)),
        p AS (SELECT l_returnflag, quantile_cont(r, 0.9) AS p FROM r GROUP BY 1) SELECT l_returnflag, count(*) AS n, round(regr_slope(y, x), 3) AS slope, round(regr_r2(y, x), 5) AS r2, regr_r2(y, x) > 0.3 AND count(*) > 50 AS accepted FROM r JOIN p USING (l_returnflag) WHERE r < p GROUP BY 1""",
    "a24_cum_share": """WITH w AS (SELECT o_orderstatus, o_orderkey, floor(o_totalprice) AS w FROM orders WHERE floor(o_totalprice) > 0), c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY o_orderstatus ORDER BY w DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 0.8::DOUBLE * sum(w) OVER (PARTITION BY o_orderstatus) AS goal FROM w)
        SELECT o_orderstatus, o_orderkey FROM c WHERE before < goal""",
    "a25_chunk_quant": f"""WITH {_P}, n AS (SELECT *, CAST((row_number() OVER (PARTITION BY seq ORDER BY line) - 1) // 256 AS BIGINT) AS chunk FROM pts)
        SELECT seq, line, chunk, {', '.join(f'CAST(greatest(0, least({lv}, floor(CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-5 THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END * {lv} + 0.5::DOUBLE))) AS INTEGER) AS code_{c}' for c, lv in (('x', 2047), ('y', 1023), ('z', 2047)))} FROM n WINDOW w AS (PARTITION BY seq, chunk)""",
    "a27_overlap_classes": """WITH e AS (SELECT l_returnflag, l_quantity, unnest(list_filter([CASE WHEN l_extendedprice < 20000 THEN 'cheap' END, CASE WHEN month(l_shipdate) > 9 THEN 'late' END, CASE WHEN l_quantity >= 40 THEN 'big' END], lambda v: v IS NOT NULL)) AS class FROM lineitem), t AS (SELECT l_returnflag, sum(l_quantity) AS s FROM lineitem GROUP BY 1)
        SELECT e.l_returnflag, class, count(*) AS rows, round(sum(l_quantity) / any_value(s), 6) AS weight_share FROM e JOIN t USING (l_returnflag) GROUP BY ALL""",
    "a28_case_classes": f"WITH {BLUR}, c AS (SELECT seq, CASE WHEN rate IS NULL THEN 'unknown' WHEN rate <= 0.2 THEN 'sharp' WHEN rate <= 1 AND used = 1 THEN 'usable' WHEN rate <= 1 THEN 'unused' ELSE 'blurred' END AS class, count(*) OVER (PARTITION BY seq) AS total FROM blur) SELECT seq, class, count(*) AS n, round(count(*) / any_value(total), 6) AS share FROM c GROUP BY ALL",
    "a29_fscore": f"""WITH {_P}, {VIEWS}, v AS (SELECT seq, rec_id, tmat[4] AS x, tmat[8] AS y, tmat[12] AS z FROM views WHERE {' AND '.join(f'tmat[{i}] IS NOT NULL AND NOT isnan(tmat[{i}]) AND abs(tmat[{i}]) < 1000' for i in (4, 8, 12))}),
        j AS (SELECT v.seq, rec_id, line, sqrt(pow(v.x - p.x, 2) + pow(v.y - p.y, 2) + pow(v.z - p.z, 2)) AS d FROM v JOIN pts p ON p.seq = v.seq),
        a AS (SELECT seq, rec_id, min(d) AS d FROM j GROUP BY ALL), b AS (SELECT seq, line, min(d) AS d FROM j GROUP BY ALL), th AS (SELECT * FROM (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) t(threshold)),
        p AS (SELECT seq, threshold, avg((d < threshold)::INT) AS p FROM a, th GROUP BY ALL), r AS (SELECT seq, threshold, avg((d < threshold)::INT) AS r FROM b, th GROUP BY ALL)
        SELECT p.seq, p.threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM p JOIN r ON p.seq = r.seq AND p.threshold = r.threshold""",
    "a30_depth_report": """WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS pred FROM lineitem GROUP BY 1), o AS (SELECT o_orderpriority, o_totalprice AS gt, pred, abs(pred - o_totalprice) AS e FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
        SELECT o_orderpriority, round(count(pred) / count(*), 6) AS coverage, round(avg(e / gt), 5) AS abs_rel, round(median(e), 3) AS median_abs, round(avg((e < 0.05 * gt)::INT), 6) AS within5 FROM o GROUP BY 1""",
    "a31_gate": f"""WITH {BLUR}, b AS (SELECT seq, round(count(rate) / count(*), 6) AS k, round(quantile_cont(rate, 0.5), 6) AS m, max(omega) AS f FROM blur GROUP BY seq),
        c AS (SELECT seq, 'known_share' AS "check", k AS value, 0.9::DOUBLE AS "limit", coalesce(k >= 0.9, false) AS ok FROM b UNION ALL SELECT seq, 'median_rate', m, 0.5::DOUBLE, coalesce(m <= 0.5, false) FROM b UNION ALL SELECT seq, 'fastest', f, 3.0::DOUBLE, coalesce(f <= 3, false) FROM b)
        SELECT *, bool_and(ok) OVER (PARTITION BY seq) AS passed FROM c""",
    "a52_cost": """WITH d AS (SELECT doc_id, source, sha256(text) AS key, length(text) * 0.5::DOUBLE AS usd, length(text) AS tokens FROM documents WHERE text IS NOT NULL), f AS (SELECT source, tokens FROM d QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY doc_id) = 1), g AS (SELECT source, count(*) AS distinct_calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM f GROUP BY 1)
        SELECT d.source, sum(usd) AS usd, count(*) AS calls, any_value(distinct_calls) AS distinct_calls, any_value(g.tokens) AS tokens FROM d JOIN g USING (source) GROUP BY 1""",
    "a53_summary": f"""WITH {_FB}, f AS (SELECT seq, count(*) AS frames FROM frames GROUP BY 1), b AS (SELECT seq, count(*) FILTER (WHERE rate > 1) AS blurred FROM blur GROUP BY 1)
        SELECT r.seq, platform, f.frames, b.blurred, b.blurred > 0.2 * f.frames AS rejected FROM (SELECT DISTINCT seq, platform FROM recordings) r LEFT JOIN f USING (seq) LEFT JOIN b USING (seq)""",
    "j08_inner": f"WITH {_FB} SELECT frame_id, rate FROM frames f JOIN blur b ON f.seq = b.seq AND f.rgb_name = b.name",
    "j09_left_default": f"WITH {_FB} SELECT frame_id, coalesce(rate, 99.0::DOUBLE) AS rate FROM frames f LEFT JOIN blur b ON f.seq = b.seq AND f.rgb_name = b.name",
    "j10_semi": f"WITH {_FB} SELECT frame_id FROM frames f WHERE EXISTS (SELECT 1 FROM blur b WHERE f.seq = b.seq AND f.rgb_name = b.name AND used = 1)",
    "j11_anti": f"WITH {_FB} SELECT frame_id FROM frames f WHERE NOT EXISTS (SELECT 1 FROM blur b WHERE f.seq = b.seq AND f.rgb_name = b.name AND used = 1)",
    "j12_accept_gate": """WITH p AS (SELECT p_brand AS set, avg(p_retailprice) FILTER (WHERE p_size % 2 = 0) AS b1, avg(p_retailprice) FILTER (WHERE p_size % 2 = 1) AS c1, avg(p_size / 100) FILTER (WHERE p_size % 2 = 0) AS b2, avg(p_size / 100) FILTER (WHERE p_size % 2 = 1) AS c2 FROM part GROUP BY 1),
        l AS (SELECT set, 'psnr' AS metric, round(c1, 4) - round(b1, 4) AS delta FROM p UNION ALL SELECT set, 'lpips', round(c2, 6) - round(b2, 6) FROM p) SELECT set, metric, round(delta, 4) AS delta, CASE WHEN metric = 'lpips' THEN delta > 0.002 ELSE delta < -0.05 END AS worse FROM l WHERE delta IS NOT NULL""",
    "j31_sweep_argmin": f"""WITH {IMU}, f AS (SELECT seq, name, CAST(round(min(t) * 1e6) AS BIGINT) AS us, min(omega_mocap) AS stated FROM per_frame WHERE seq IS NOT NULL AND name IS NOT NULL AND t IS NOT NULL AND NOT isnan(t) AND omega_mocap IS NOT NULL AND NOT isnan(omega_mocap) GROUP BY ALL),
        {_sweep_sql('a', "(SELECT seq, unnest(range(-100, 101, 20)) AS candidate FROM (SELECT DISTINCT seq FROM f))")}, {_sweep_sql('b', "(SELECT seq, unnest(range(candidate - 20, candidate + 21, 4)) AS candidate FROM a_best)")}
        SELECT seq, CAST(candidate AS INTEGER) AS candidate, cost FROM b_best""",
    "j33_cache": "WITH d AS (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents WHERE text IS NOT NULL) SELECT source, count(*) AS calls, count(*) FILTER (WHERE doc_id <> first_id) AS hits FROM d GROUP BY 1",
    "u01_union_reduce": f"""WITH {_P}, {VIEWS}, u AS (SELECT seq, x, y, z FROM pts UNION ALL SELECT seq, tmat[4], tmat[8], tmat[12] FROM views) SELECT seq, {', '.join(f'CAST(floor({c} / 0.5::DOUBLE) AS BIGINT) AS i{c}' for c in 'xyz')}, count(*) AS n, round(avg(x), 4) AS x FROM u GROUP BY 1, 2, 3, 4""",
    "u02_offset_union": "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey + 1000000, c_name FROM customer",
    "u03_rename": "WITH k AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part) SELECT p_partkey, CASE WHEN k > 0 THEN 'u' || k || '_' || p_brand ELSE p_brand END AS new_name FROM k",
    "u04_first_wins": "SELECT name, seq, used FROM per_frame WHERE seq IS NOT NULL AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq, used) = 1",
    "u05_diff": f"""WITH {_FB}, a AS (SELECT seq, rgb_name AS name FROM frames), b AS (SELECT seq, name FROM blur WHERE rate IS NOT NULL)
        SELECT *, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'frames' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'blur' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "u06_and_merge": "SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS kept FROM lineitem GROUP BY 1",
    "u07_sorted_distinct": "SELECT DISTINCT regexp_replace(regexp_extract(depth_name, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM frame_record WHERE depth_name IS NOT NULL",
    "u08_split_check": "SELECT split, count(*) AS mismatches FROM (SELECT DISTINCT rec_id, split FROM split_frames WHERE rec_id IS NOT NULL) WHERE split IS DISTINCT FROM CASE WHEN rec_id % 8 = 0 THEN 'val' ELSE 'train' END GROUP BY 1",
    "l02_topk": f"WITH {BLUR} SELECT seq, name, rate, CAST(row_number() OVER (PARTITION BY seq ORDER BY rate DESC NULLS LAST, name) AS INTEGER) AS rank FROM blur QUALIFY rank <= 15",
    "l05_stride": f"WITH {POSES} SELECT seq, count(*) AS n FROM poses WHERE line % 4 = 0 GROUP BY 1",
    "w14_only_in_window": """WITH s AS (SELECT l_suppkey, l_partkey, min(month(l_shipdate)) AS lo, max(month(l_shipdate)) AS hi FROM lineitem GROUP BY ALL HAVING max(month(l_shipdate)) - min(month(l_shipdate)) < 4), c AS (SELECT l_suppkey, a AS start, count(*) AS samples FROM s JOIN range(0, 13) r(a) ON a BETWEEN greatest(0, hi - 3) AND lo GROUP BY ALL)
        SELECT l_suppkey, start, samples FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY samples DESC, start) = 1""",
    "w20_top_fraction": """WITH p AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
        SELECT p_brand, count(*) FILTER (WHERE rk <= ceil(n * 0.1::DOUBLE)) AS kept, round(sum(p_retailprice) FILTER (WHERE rk <= ceil(n * 0.1::DOUBLE)) / sum(p_retailprice), 6) AS share FROM p GROUP BY 1""",
    "f02_ranges": """SELECT l_returnflag, count(*) FILTER (WHERE CAST(l_quantity AS INTEGER) <> 7 AND CAST(l_quantity AS INTEGER) * 0.1::DOUBLE BETWEEN 0.5 AND 4.0) AS valid, round(max(CAST(l_quantity AS INTEGER) * 0.1::DOUBLE) FILTER (WHERE CAST(l_quantity AS INTEGER) <> 7 AND CAST(l_quantity AS INTEGER) * 0.1::DOUBLE BETWEEN 0.5 AND 4.0), 6) AS deepest,
        count(*) FILTER (WHERE sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) > 2 AND sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) < 40) AS ranged FROM lineitem GROUP BY 1""",
    "f09_shapes": f"""WITH {_P}, s AS (SELECT seq, list_sort([abs(x) + 0.001::DOUBLE, abs(y) + 0.001::DOUBLE, abs(z) + 0.001::DOUBLE]) AS s FROM pts)
        SELECT seq, CASE WHEN s[3] > 15 THEN 'giant' WHEN s[3] > 10 * s[2] THEN 'needle' WHEN s[1] < 0.1::DOUBLE * s[2] THEN 'disc' ELSE 'round' END AS shape, count(*) AS n FROM s GROUP BY ALL""",
    "x18_stamps": """WITH f AS (SELECT DISTINCT frame_id, rgb_name FROM frame_record WHERE frame_id IS NOT NULL), n AS (SELECT frame_id, rgb_name, TRY_CAST(nullif(regexp_extract(rgb_name, '^\\s*([0-9]+)', 1), '') AS BIGINT) AS stamp FROM f)
        SELECT frame_id, stamp, round(CASE length(stamp::VARCHAR) WHEN 10 THEN stamp * 1.0::DOUBLE WHEN 13 THEN stamp / 1e3 WHEN 16 THEN stamp / 1e6 WHEN 19 THEN stamp / 1e9 END, 3) AS seconds, regexp_replace(regexp_replace(regexp_extract(rgb_name, '([^/]*)$', 1), '\\.[^.]*$', ''), '_rgb$', '') AS stem FROM n""",
    "x24_hash_key": "SELECT o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority) AS key FROM orders",
    "s21_json_tree": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS parses FROM events",
}
