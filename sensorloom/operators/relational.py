"""Set operations, samplers, rollups, quality metrics and rank statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in `order` (which should end with a unique column): a map-side minimum, no sort of a group."""
    names = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r"))
    return g.select(*key, "_r.*").select(*df.columns)


def rename_collisions(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """df with new_name: later rows of an equal name get the prefix u{k}_, k counted from 1."""
    w = Window.partitionBy(name).orderBy(*order)
    k = F.row_number().over(w) - 1
    return df.withColumn("new_name", F.when(k > 0, F.concat(F.lit("u"), k.cast("string"), F.lit("_"), F.col(name))).otherwise(F.col(name)))


def offset_union(left: DataFrame, right: DataFrame, id_col: str, offset: int | None = None) -> DataFrame:
    """UNION ALL whose right ids are moved by `offset`, or past the left's largest."""
    if offset is None:
        offset = (left.agg(F.max(id_col)).first()[0] or 0) + 1
    return left.unionByName(right.withColumn(id_col, F.col(id_col) + offset))


def split_mismatches(df: DataFrame, number: str, split: str, every: int, held: str = "val") -> DataFrame:
    """Rows whose stored split is not what number % every says."""
    want = F.when(F.col(number) % every == 0, held).otherwise("train")
    return df.where(~F.col(split).eqNullSafe(want))


def hashed_sample(df: DataFrame, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all if fewer), the same for the same ids and seed: the smallest hashes, by a distributed top-n."""
    return df.orderBy(F.xxhash64(row_id, F.lit(seed)), row_id).limit(n)


def weighted_sample(df: DataFrame, row_id: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement with chances by weight (Gumbel top-n); rows without a positive weight are never drawn."""
    u = (F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    score = F.log(F.col(weight)) - F.log(-F.log(u))
    return df.where(F.col(weight) > 0).withColumn("_g", score).orderBy(F.desc("_g"), row_id).limit(n).drop("_g")


def stride_sample(df: DataFrame, number: str, k: int) -> DataFrame:
    return df.where(F.col(number) % k == 0)


def pooled_and_macro(df: DataFrame, by: list[str], frame: str, squared_error: str, pixels: str, min_pixels: int = 500) -> DataFrame:
    """(by, frames, macro_psnr, pooled_psnr): mean of the frames' PSNR over frames with enough pixels, and PSNR of all their errors together. Values in 0..1."""
    f = df.groupBy(*by, frame).agg(F.sum(squared_error).alias("se"), F.sum(pixels).alias("px")).where(F.col("px") >= min_pixels)

    def db(mse: Column) -> Column:
        return F.when(mse > 0, -10 * F.log10(mse)).otherwise(F.lit(float("inf")))

    return f.groupBy(*by).agg(F.count("*").alias("frames"), F.avg(db(F.col("se") / F.col("px"))).alias("macro_psnr"), db(F.sum("se") / F.sum("px")).alias("pooled_psnr"))


def global_ssim(df: DataFrame, by: list[str], a: str, b: str, c1: float = 0.01**2, c2: float = 0.03**2) -> DataFrame:
    """(by, ssim, psnr) of two signals in 0..1 from their means, population variances and covariance; PSNR infinite for equal ones."""
    g = df.groupBy(*by).agg(
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cab"), F.avg((F.col(a) - F.col(b)) ** 2).alias("mse")
    )
    s = ((2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("cab") + c2)) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (F.col("va") + F.col("vb") + c2))
    return g.select(*by, s.alias("ssim"), F.when(F.col("mse") > 0, -10 * F.log10("mse")).otherwise(F.lit(float("inf"))).alias("psnr"))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, rho): correlation of average ranks; rows with a null are left out.

    Ranks come from the counts of distinct values, so the ordered rows of a group are its
    distinct values, not its rows.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranks(c: str, name: str) -> DataFrame:
        v = d.groupBy(*by, c).agg(F.count("*").alias("_k"))
        w = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        return v.select(*by, c, (F.coalesce(F.sum("_k").over(w), F.lit(0)) + (F.col("_k") + 1) / 2).alias(name))

    j = d.join(ranks(a, "_ra"), [*by, a]).join(ranks(b, "_rb"), [*by, b])
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def trimmed_line(df: DataFrame, by: list[str], x: str, y: str, keep: float = 0.9, min_r2: float = 0.3, min_rows: int = 50) -> DataFrame:
    """(by, n, slope, intercept, r2, accepted): least squares, then again without the residuals at or beyond their `keep` percentile."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    f = d.groupBy(*by).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    r = d.join(f, by).withColumn("_r", F.abs(F.col(y) - F.col("_s") * F.col(x) - F.col("_i")))
    p = r.groupBy(*by).agg(F.percentile("_r", keep).alias("_p"))
    g = r.join(p, by).where(F.col("_r") < F.col("_p")).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    return g.withColumn("accepted", (F.col("r2") > min_r2) & (F.col("n") > min_rows))


def carriers(df: DataFrame, by: list[str], row_id: str, weight: str, share: float = 0.8) -> DataFrame:
    """Rows of each group that together carry the first `share` of its weight, heaviest first, the one that reaches it included.

    Equal weights are ordered by id. Weights are first summed in logarithmic bins, so that only the bin in
    which the share is reached has to be ordered row by row.
    """
    d = df.where(F.col(weight) > 0).withColumn("_bin", F.floor(F.log2(weight) * 64).cast("bigint"))
    bins = d.groupBy(*by, "_bin").agg(F.sum(weight).alias("_w"))
    up = Window.partitionBy(*by).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    b = bins.select(*by, "_bin", "_w", F.coalesce(F.sum("_w").over(up), F.lit(0.0)).alias("_before"), (F.sum("_w").over(Window.partitionBy(*by)) * share).alias("_goal"))
    j = d.join(b, [*by, "_bin"]).where(F.col("_before") < F.col("_goal"))
    whole = j.where(F.col("_before") + F.col("_w") < F.col("_goal"))
    part = j.where(F.col("_before") + F.col("_w") >= F.col("_goal"))
    w = Window.partitionBy(*by).orderBy(F.desc(weight), row_id).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_c", F.col("_before") + F.coalesce(F.sum(weight).over(w), F.lit(0.0))).where(F.col("_c") < F.col("_goal")).drop("_c")
    return whole.unionByName(part).select(*df.columns)


def quantised_chunks(df: DataFrame, by: list[str], order: list[str], columns: Sequence[str], levels: Sequence[int], size: int = 256) -> DataFrame:
    """df with chunk and code_c: in order, groups of `size` rows; each value coded between the chunk's ends, halves up."""
    from sensorloom.functions.keys import quantise

    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    c = df.withColumn("chunk", F.floor(n / size).cast("bigint"))
    w = Window.partitionBy(*by, "chunk")
    for col, lv in zip(columns, levels):
        c = c.withColumn(f"code_{col}", quantise(F.col(col), F.min(col).over(w), F.max(col).over(w), lv))
    return c


def scores_at(distances: DataFrame, by: list[str], side: str, distance: str, thresholds: Sequence[float]) -> DataFrame:
    """(by, threshold, precision, recall, f): shares of side 'p' and side 'r' rows strictly under each threshold; f is 0 where both are."""
    t = distances.withColumn("threshold", F.explode(F.array(*[F.lit(float(v)) for v in thresholds])))
    near = F.col(distance) < F.col("threshold")
    g = t.groupBy(*by, "threshold").agg(
        F.avg(F.when(F.col(side) == "p", near.cast("double"))).alias("precision"), F.avg(F.when(F.col(side) == "r", near.cast("double"))).alias("recall")
    )
    total = F.col("precision") + F.col("recall")
    return g.withColumn("f", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def accept_gate(metrics: DataFrame, set_col: str, metric: str, baseline: str, candidate: str) -> DataFrame:
    """(set, metric, baseline, candidate, delta, worse): a metric is worse beyond its family's tolerance; pairs with a null are left out.

    LPIPS and DISTS may rise by 0.002, SSIM fall by 0.002, any other fall by 0.05.
    """
    m = metrics.where(F.col(baseline).isNotNull() & F.col(candidate).isNotNull()).withColumn("delta", F.col(candidate) - F.col(baseline))
    name = F.lower(metric)
    lower_is_better = name.contains("lpips") | name.contains("dists")
    worse = F.when(lower_is_better, F.col("delta") > 0.002).when(name.contains("ssim"), F.col("delta") < -0.002).otherwise(F.col("delta") < -0.05)
    return m.select(set_col, metric, baseline, candidate, "delta", worse.alias("worse"))


def leaderboard(records: DataFrame, top: int = 15) -> DataFrame:
    """Rollup of metric records (path, chain, seq, n, set_name, tag, pred_dir, psnr, ssim, lpips).

    Records of an equal pred_dir (else path and chain) count once, the first by (path, chain);
    groups are (seq, n, set_name) with at least two records; rank by psnr, then path and chain;
    best marks all records with the group's lowest lpips, over all its records; the first
    `top` of each group are kept. group_size counts all.
    """
    key = F.coalesce("pred_dir", F.concat_ws("\u0001", "path", "chain"))
    r = first_wins(records.withColumn("_key", key), ["_key"], ["path", "chain"]).drop("_key")
    g = Window.partitionBy("seq", "n", "set_name")
    r = r.withColumn("group_size", F.count("*").over(g)).withColumn("best", F.coalesce(F.col("lpips") == F.min("lpips").over(g), F.lit(False)))
    rank = F.row_number().over(g.orderBy(F.desc_nulls_last("psnr"), "path", "chain"))
    return r.where(F.col("group_size") >= 2).withColumn("rank", rank).where(F.col("rank") <= top)


def cost_rollup(ledger: DataFrame, by: list[str], key: str, order: list[str], usd: str, tokens: Sequence[str]) -> DataFrame:
    """Billed sum over all rows; tokens over the first row of each key."""
    billed = ledger.groupBy(*by).agg(F.sum(usd).alias(usd), F.count("*").alias("calls"))
    firsts = first_wins(ledger.select(*by, key, *order, *tokens), [*by, key], order).groupBy(*by).agg(F.count("*").alias("distinct_calls"), *[F.sum(t).alias(t) for t in tokens])
    return billed.join(firsts, by)


def overlapping_classes(df: DataFrame, by: list[str], classes: list[tuple[str, Column]], weight: str) -> DataFrame:
    """(by, class, rows, weight_share): a row may be in several classes or none."""
    flags = F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in classes])
    total = df.groupBy(*by).agg(F.sum(weight).alias("_all"))
    e = df.select(*by, weight, F.explode(F.array_compact(flags)).alias("class")).groupBy(*by, "class").agg(F.count("*").alias("rows"), F.sum(weight).alias("_w"))
    return e.join(total, by).select(*by, "class", "rows", (F.col("_w") / F.col("_all")).alias("weight_share"))


def only_inside_window(samples: DataFrame, by: list[str], sample: str, frame: str, length: int) -> DataFrame:
    """(by, start, samples): the first window of `length` frames that holds every view of the most samples.

    A sample seen in frames lo..hi is inside the windows that start from hi - length + 1 to lo,
    which are counted by their ends (+1, -1) and a running sum over frames.
    """
    s = samples.groupBy(*by, sample).agg(F.min(frame).alias("lo"), F.max(frame).alias("hi")).where(F.col("hi") - F.col("lo") < length)
    at = F.explode(F.array(F.struct(F.greatest(F.lit(0), F.col("hi") - length + 1).alias("start"), F.lit(1).alias("d")), F.struct((F.col("lo") + 1).alias("start"), F.lit(-1).alias("d"))))
    steps = s.select(*by, at.alias("e")).groupBy(*by, F.col("e.start").alias("start")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a frame
    c = steps.withColumn("samples", F.sum("d").over(w))
    return c.groupBy(*by).agg(F.min(F.struct((-F.col("samples")).alias("m"), "start")).alias("b")).select(*by, F.col("b.start").alias("start"), (-F.col("b.m")).alias("samples"))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median, p10, p90, p95, mean and max of the values that are neither null nor NaN."""
    v = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9), F.lit(0.95)))
    g = df.groupBy(*by).agg(F.count(v).alias("n"), q.alias("q"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    return g.select(*by, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("median", "p10", "p90", "p95"))], "mean", "max")


def bootstrap_interval(df: DataFrame, by: list[str], order: str, value: str, resamples: int = 500, block: int = 60, seed: int = 0, coverage: float = 0.95) -> DataFrame:
    """(by, mean, low, high): block bootstrap of the mean.

    Blocks are reduced to (sum, count) first; each resample draws as many blocks as there are,
    with repetition, by hashed indices, so the draws are the same on every run and cluster.
    Resamples are made one after another, a part of them a task, from flat columns: a task
    holds the group's blocks, 24 bytes each, and one resample.
    """
    b = df.where(F.col(value).isNotNull()).groupBy(*by, F.floor(F.col(order) / block).alias("_b")).agg(F.sum(value).alias("_s"), F.count("*").alias("_k"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    parts = min(8, resamples)

    def resampled(g: pa.Table) -> pa.Table:
        g = g.take(pc.sort_indices(g, sort_keys=[("_b", "ascending")], null_placement="at_start"))
        sums, sizes = g["_s"].to_numpy(), g["_k"].to_numpy()
        n, mine = len(sums), np.arange(1 + g["_part"][0].as_py(), resamples + 1, parts)
        means = []
        for r in mine:
            draw = np.mod(_hashed(np.arange(1, n + 1), int(r), seed), n)
            total = np.cumsum(sizes[draw].astype(float))[-1]
            means.append(np.cumsum(sums[draw])[-1] / total)  # summed in the order of the draws
        keys = {c: pa.chunked_array([pa.concat_arrays([g[c].slice(0, 1).combine_chunks()] * len(mine))]) for c in by}
        return pa.table({**keys, "m": pa.array(means, pa.float64())})

    spread = b.select(*by, "_b", F.col("_s").cast("double"), "_k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    m = spread.groupBy(*by, "_part").applyInArrow(resampled, f"{kinds}, m double")
    ci = m.groupBy(*by).agg(F.percentile("m", F.array(F.lit((1 - coverage) / 2), F.lit((1 + coverage) / 2))).alias("q"))
    mean = b.groupBy(*by).agg((F.sum("_s") / F.sum("_k")).alias("mean"))
    return mean.join(ci, by).select(*by, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _hashed(*values: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of columns of 32-bit whole numbers, the first an array."""
    p1, p2, p3, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = np.full(len(values[0]), 42, np.uint64)
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        for v in values:
            word = np.asarray(v).astype(np.int32).view(np.uint32).astype(np.uint64)
            h = turn((h + p5 + np.uint64(4)) ^ (word * p1), 23) * p2 + p3
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def two_level_sweep(entities: DataFrame, by: list[str], cost, reach: int, coarse: int, fine: int) -> DataFrame:
    """(by, candidate, cost): the candidate of least cost per entity, of equal ones the smallest.

    Candidates are -reach, -reach + coarse, .. reach, then the best one's surroundings up to a
    coarse step in fine steps. cost takes (by, candidate) and gives (by, candidate, cost) of
    all of them at once; candidates whose cost is null or NaN are skipped.
    """
    from sensorloom.session import cut_lineage

    def least(candidates: DataFrame) -> DataFrame:
        c = cost(candidates).where(F.col("cost").isNotNull() & ~F.isnan("cost"))
        return c.groupBy(*by).agg(F.min(F.struct("cost", "candidate")).alias("_b")).select(*by, "_b.candidate", "_b.cost")

    steps = F.sequence(F.lit(-reach), F.lit(reach), F.lit(coarse))
    first = cut_lineage(least(entities.select(*by, F.explode(steps).alias("candidate"))))
    around = F.sequence(F.col("candidate") - coarse, F.col("candidate") + coarse, F.lit(fine))
    return least(first.select(*by, F.explode(around).alias("candidate")))
