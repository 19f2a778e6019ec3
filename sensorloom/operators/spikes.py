"""Implausible spikes, stuck values and impossible readings (problem 5).

Per source and channel the residual of a reading is how far it stands out from the
readings on both sides of it (of its run of up to five), over the elapsed time, divided
by the source's usual change per second. These signals have no known period, so the
season is taken locally: what a reading shares with both its sides (gait, turns, slow
drift) drops out. Residuals over a threshold follow a generalised Pareto tail whose fit
per source and channel sets the cutoff at a fixed risk. Stuck runs and physical limits
are rules beside it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.operators.regular_grid import present
from sensorloom.session import cut_lineage, write_table

CHUNK_LINES = 8192
HALO_LINES = 256
LONGEST_RUN = 5
SHORTEST_STUCK = 8
NEEDED_HALO = 8  # valid readings that a run at a chunk's edge can reach beyond it
BINS_PER_OCTAVE = 512
OVER = 3.0
RISK = 1e-6
FACTOR = 10.0
WIDER = 8
SMALL_ROWS = 131_072  # of at most about half a kilobyte
# Limits of working sensors and rigid bodies.
MAX_OMEGA = 35.0  # rad/s, a 2000 degree/s gyroscope
MAX_ACCEL = 160.0  # m/s², a 16 g accelerometer
MAX_POSITION = 5000.0  # m
MAX_SKEW = 0.01  # largest entry of R·Rᵀ - 1

IMU_CHANNELS = ("omega_x", "omega_y", "omega_z", "accel_x", "accel_y", "accel_z")
POSE_CHANNELS = ("pos_x", "pos_y", "pos_z", "turn")


def _stand_out(t: np.ndarray, apart: Callable[[np.ndarray, np.ndarray], np.ndarray], same_side: Callable | None) -> np.ndarray:
    """For each reading the largest rate by which a run of up to five with it stands out on both sides."""
    n = len(t)
    best = np.zeros(n)
    for k in range(1, LONGEST_RUN + 1):
        i = np.arange(n - k - 1)
        if not len(i):
            break
        before, after = i, i + k + 1
        enter = np.maximum(t[before + 1] - t[before], 1e-6)
        leave = np.maximum(t[after] - t[after - 1], 1e-6)
        least = np.full(len(i), np.inf)
        for j in range(1, k + 1):
            a, b = apart(i + j, before), apart(i + j, after)
            rate = np.minimum(np.abs(a) / enter, np.abs(b) / leave)
            least = np.minimum(least, np.where(same_side(i + j, before, after, a, b), rate, 0.0))
        for j in range(1, k + 1):
            np.maximum(best[j : j + len(i)], least, out=best[j : j + len(i)])
    return best


def _stuck(same_as_previous: np.ndarray) -> np.ndarray:
    """Readings of runs of at least SHORTEST_STUCK equal ones. same_as_previous has one entry less than the readings."""
    n = len(same_as_previous) + 1
    run = np.concatenate([[0], np.cumsum(~same_as_previous)])
    return np.bincount(run, minlength=n)[run] >= SHORTEST_STUCK


def _signed(x: np.ndarray):
    def apart(i, j):
        return x[i] - x[j]

    return apart, lambda i, p, q, a, b: a * b > 0  # outside of what lies between both sides


def _angles(r: np.ndarray):
    def apart(i, j):
        trace = np.einsum("nij,nij->n", r[i], r[j])
        return np.arccos(np.clip((trace - 1) / 2, -1, 1))

    return apart, lambda i, p, q, a, b: apart(p, q) < np.maximum(a, b)  # turned away and back


def _channels(track: str, x: np.ndarray) -> list:
    if track == "imu":
        return [_signed(x[:, c]) for c in range(6)]
    m = x.reshape(-1, 3, 4)
    return [*(_signed(m[:, c, 3]) for c in range(3)), _angles(np.ascontiguousarray(m[:, :, :3]))]


def _rules(track: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stuck, impossible) of each reading."""
    if track == "imu":
        stuck = np.zeros(len(x), bool)
        for c in range(6):
            stuck |= _stuck(x[1:, c] == x[:-1, c])
        return stuck, (np.linalg.norm(x[:, :3], axis=1) > MAX_OMEGA) | (np.linalg.norm(x[:, 3:], axis=1) > MAX_ACCEL)
    m = x.reshape(-1, 3, 4)
    r, p = m[:, :, :3], m[:, :, 3]
    skew = np.abs(np.einsum("nij,nkj->nik", r, r) - np.eye(3)).max(axis=(1, 2))
    bad = ~(skew <= MAX_SKEW) | (np.linalg.det(r) < 0) | ~(np.abs(p).max(axis=1) <= MAX_POSITION)
    return _stuck((x[1:] == x[:-1]).all(axis=1)), bad


def _measure(track: str, g: pa.Table, chunk_lines: int) -> pa.Table:
    """Residual rates and rule flags of one chunk of one source, its counts of changes, and how many halo readings it had."""
    line = g["line"].to_numpy()
    line, first = np.unique(line, return_index=True)
    t = g["t"].to_numpy()[first]
    width = 6 if track == "imu" else 12
    x = np.stack([g[f"v{c}"].to_numpy()[first] for c in range(width)], axis=1)
    source, chunk = g["source"][0].as_py(), g["chunk"][0].as_py()
    core = (line // chunk_lines) == chunk
    names = _channel_names(track)
    empty = pa.table({"source": pa.array([], pa.string())})
    if not core.any():
        return _as_output(empty, names)
    with np.errstate(all="ignore"):
        channels = _channels(track, x)
        stuck, bad = _rules(track, x)
        dt = np.maximum(np.diff(t), 1e-6)
        n = np.arange(len(t))
        readings = {"source": pa.array([source] * int(core.sum()), pa.string()), "chunk": np.full(int(core.sum()), chunk), "line": line[core], "stuck": stuck[core], "impossible": bad[core]}
        counts: list[tuple[int, np.ndarray, np.ndarray]] = []
        for c, (apart, same_side) in enumerate(channels):
            readings[f"r{c}"] = _stand_out(t, apart, same_side)[core]
            change = (np.abs(apart(n[1:], n[:-1])) / dt)[core[1:]]
            change = change[(change > 0) & np.isfinite(change)]
            counts.append((c, *np.unique(np.floor(np.log2(change) * BINS_PER_OCTAVE).astype(np.int64), return_counts=True)))
    before, after = int((line < chunk * chunk_lines).sum()), int((line >= (chunk + 1) * chunk_lines).sum())
    rows = sum(len(b) for _, b, _ in counts)
    tally = pa.table(
        {
            "source": pa.array([source] * (rows + 2), pa.string()),
            "chunk": np.full(rows + 2, chunk),
            "channel": np.concatenate([*(np.full(len(b), c) for c, b, _ in counts), [-1, -2]]),
            "bin": np.concatenate([*(b for _, b, _ in counts), [0, 0]]),
            "n": np.concatenate([*(k for _, _, k in counts), [before, after]]),
        }
    )
    return pa.concat_tables([_as_output(pa.table(readings), names), _as_output(tally, names)])


def _channel_names(track: str) -> tuple[str, ...]:
    return IMU_CHANNELS if track == "imu" else POSE_CHANNELS


def _as_output(t: pa.Table, channels: tuple[str, ...]) -> pa.Table:
    kinds = {"source": pa.string(), "chunk": pa.int64(), "line": pa.int64(), **{f"r{c}": pa.float32() for c in range(len(channels))}, "stuck": pa.bool_(), "impossible": pa.bool_(), "channel": pa.int32(), "bin": pa.int64(), "n": pa.int64()}
    return pa.table({k: t[k].cast(v) if k in t.column_names else pa.nulls(len(t), v) for k, v in kinds.items()})


def _small(df: DataFrame) -> DataFrame:
    """df, a few numbers a source or a chunk, to be broadcast while it has at most SMALL_ROWS rows: readings then stay where they are."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def measure_readings(readings: DataFrame, track: str, chunk_lines: int = CHUNK_LINES, halo_lines: int = HALO_LINES) -> DataFrame:
    """Rows of two kinds, written out: readings (source, chunk, line, r0.., stuck, impossible) with one residual
    rate a channel, and tallies (source, chunk, channel, bin, n) with line null: how many changes per second
    fall into each of 512 bins an octave.

    A source is worked through in chunks of chunk_lines lines, each with halo_lines more on
    both sides, so a source with a third of all rows is spread over many tasks of bounded
    size. Eight valid readings on either side make a chunk's result exact; chunks that found
    fewer, though the track goes on, are measured again with eight times the halo on that
    side until none is left; their earlier rows are passed over when read, not written again.
    """
    channels = _channel_names(track)
    rates = ", ".join(f"r{c} float" for c in range(len(channels)))
    out = f"source string, chunk bigint, line bigint, {rates}, stuck boolean, impossible boolean, channel int, bin bigint, n bigint"
    line = F.col("line")
    width = 6 if track == "imu" else 12
    flat = readings.select("source", "line", "t", *[F.col("values")[c].alias(f"v{c}") for c in range(width)])

    def measure(only: DataFrame | None) -> DataFrame:
        if only is None:
            spread = flat.withColumn("chunk", F.explode(F.sequence(F.floor((line - halo_lines) / chunk_lines), F.floor((line + halo_lines) / chunk_lines))))
        else:  # lines are held against their source's few chunks before they are copied, so that no other line moves
            per = _small(only.groupBy("source").agg(F.collect_list(F.struct("chunk", "before", "after")).alias("_only")))
            meets = F.filter("_only", lambda c: (line >= c["chunk"] * chunk_lines - c["before"]) & (line < (c["chunk"] + 1) * chunk_lines + c["after"]))
            spread = flat.join(per, "source").withColumn("chunk", F.explode(F.transform(meets, lambda c: c["chunk"]))).drop("_only")
        return write_table(spread.groupBy("source", "chunk").applyInArrow(lambda g: _measure(track, g, chunk_lines), out))

    parts = [measure(None)]
    ends = _small(parts[0].where("line is not null").groupBy("source").agg(F.min("line").alias("lo"), F.max("line").alias("hi")))
    halos = None
    while True:
        short = parts[-1].where((F.col("channel") < 0) & (F.col("n") < NEEDED_HALO)).select("source", "chunk", "channel")
        if halos is None:
            short = short.withColumn("before", F.lit(halo_lines).cast("bigint")).withColumn("after", F.lit(halo_lines).cast("bigint"))
        else:
            short = short.join(_small(halos), ["source", "chunk"])
        first, last = F.col("channel") == -1, F.col("channel") == -2
        short = short.join(ends, "source").where((first & (F.col("lo") < F.col("chunk") * chunk_lines - F.col("before"))) | (last & (F.col("hi") >= (F.col("chunk") + 1) * chunk_lines + F.col("after"))))
        # Only the side that is short gets a wider halo.
        wider = [(F.max(c) * F.max(F.when(side, WIDER).otherwise(1))).cast("bigint").alias(c) for side, c in ((first, "before"), (last, "after"))]
        halos = cut_lineage(short.groupBy("source", "chunk").agg(*wider))
        if halos.isEmpty():
            break
        only = halos.select("source", "chunk")
        parts = [p.join(_small(only), ["source", "chunk"], "left_anti").select(p.columns) for p in parts] + [measure(halos)]
    measured = parts[0]
    for p in parts[1:]:
        measured = measured.unionByName(p)
    return measured


def usual_changes(measured: DataFrame) -> DataFrame:
    """(source, channel, usual): the median change per second from one reading to the next, zero changes left out.

    Taken from the tallies: the middle of the bin that holds the median, within 0.07 % of it.
    """
    t = measured.where(F.col("line").isNull() & (F.col("channel") >= 0)).groupBy("source", "channel", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("source", "channel")  # bins of a channel, not readings
    run = t.select("*", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    median = run.where((2 * F.col("upto") >= F.col("all")) & (2 * (F.col("upto") - F.col("n")) < F.col("all")))
    return median.select("source", "channel", F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS_PER_OCTAVE).alias("usual"))


def tail_cutoffs(measured: DataFrame, usual: DataFrame, channels: tuple[str, ...], over: float = OVER, risk: float = RISK, factor: float | None = None) -> DataFrame:
    """(source, c, channel, usual, readings, peaks, shape, scale, cutoff): generalised Pareto tails of the residuals.

    Peaks are residuals over `over` usual changes. Those beyond `certain` (ten) are no normal
    readings and stay out of the fit. Shape and scale by moments; the cutoff is the residual
    that a normal reading exceeds with probability `risk`, at least `over`; with under ten
    peaks it is ten. factor: an upper bound of the cutoff, where a stated factor decides.
    """
    per = usual.groupBy("source").agg(*[F.max(F.when(F.col("channel") == c, F.col("usual"))).alias(f"u{c}") for c in range(len(channels))])
    j = measured.where("line is not null").join(_small(per), "source")
    aggs = []
    for c in range(len(channels)):
        res = F.col(f"r{c}").cast("double") / F.col(f"u{c}")
        y = F.when((res > over) & (res < FACTOR), res - over)
        aggs += [F.max(f"u{c}").alias(f"u{c}"), F.count(y).alias(f"k{c}"), F.avg(y).alias(f"m{c}"), F.var_samp(y).alias(f"v{c}")]
    g = j.groupBy("source").agg(F.count("*").alias("readings"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("channel"), F.col(f"u{c}").alias("usual"), F.col(f"k{c}").alias("peaks"), F.col(f"m{c}").alias("m"), F.col(f"v{c}").alias("v")) for c, n in enumerate(channels)])
    g = g.select("source", "readings", F.explode(rows).alias("z")).select("source", "readings", "z.*").where("usual is not null")
    ratio = F.col("m") * F.col("m") / F.col("v")
    fitted = (F.col("peaks") >= 10) & (F.col("v") > 0)
    g = g.withColumn("shape", F.when(fitted, 0.5 * (1 - ratio))).withColumn("scale", F.when(fitted, 0.5 * F.col("m") * (ratio + 1)))
    rate = F.lit(risk) * F.col("readings") / F.col("peaks")
    z = F.lit(over) + F.when(F.abs("shape") > 1e-9, F.col("scale") / F.col("shape") * (F.pow(rate, -F.col("shape")) - 1)).otherwise(-F.col("scale") * F.log(rate))
    cutoff = F.coalesce(F.greatest(z, F.lit(over)), F.lit(FACTOR))
    if factor is not None:
        cutoff = F.least(cutoff, F.lit(float(factor)))
    return g.select("source", "c", "channel", "usual", "readings", "peaks", "shape", "scale", cutoff.alias("cutoff"))


def flag_readings(
    readings: DataFrame, track: str, factor: float | None = None, risk: float = RISK, chunk_lines: int = CHUNK_LINES, halo_lines: int = HALO_LINES
) -> tuple[DataFrame, DataFrame]:
    """(flags, cutoffs): flags has (source, line, spike, severity, stuck, impossible) of the readings with any of them.

    readings has source, line, t and values with all present (imu_values, pose_values). Re-delivered
    lines count once; sources without two readings, or without any change, have no spikes; empty
    tables give none. A reading is a spike if its residual in some channel is beyond the tail
    cutoff of its source; severity is the largest residual, in cutoffs.

    factor: judge by a stated number of usual changes instead. Then the cutoff, held to at most
    `factor`, only chooses candidates, and those over `factor` are spikes: the fit decides how
    many readings are checked, the factor which are flagged.
    """
    channels = _channel_names(track)
    measured = measure_readings(readings, track, chunk_lines, halo_lines)
    cutoffs = cut_lineage(tail_cutoffs(measured, usual_changes(measured), channels, risk=risk, factor=factor))
    per = cutoffs.groupBy("source").agg(
        *[F.max(F.when(F.col("c") == c, F.col(v))).alias(f"{n}{c}") for c in range(len(channels)) for n, v in (("u", "usual"), ("q", "cutoff"))]
    )
    beyond = [F.coalesce(F.col(f"r{c}") / F.col(f"u{c}") / F.col(f"q{c}"), F.lit(0.0)) for c in range(len(channels))]
    j = measured.where("line is not null").join(_small(per), "source", "left").withColumn("severity", F.greatest(*beyond))
    candidates = j.where((F.col("severity") > 1) | F.col("stuck") | F.col("impossible"))
    spike = F.col("severity") > 1
    if factor is not None:
        spike = spike & F.coalesce(F.greatest(*[F.col(f"r{c}") / F.col(f"u{c}") for c in range(len(channels))]) > factor, F.lit(False))
    flags = candidates.select("source", "line", spike.alias("spike"), "severity", "stuck", "impossible")
    return flags.where("spike or stuck or impossible"), cutoffs


def imu_values(imu: DataFrame) -> DataFrame:
    """(source, line, t, values) of the IMU readings with all six values, seq, line and t."""
    v = [F.col(f"{k}.{a}") for k in ("omega", "accel") for a in "xyz"]
    return imu.where(F.col("seq").isNotNull() & F.col("line").isNotNull() & present(F.col("t"), *v)).select(
        F.col("seq").alias("source"), "line", "t", F.array(*v).alias("values")
    )


def pose_values(pose: DataFrame) -> DataFrame:
    """(source, line, t, values) of the pose readings with twelve values, seq, line and t."""
    m = F.slice("tmat", 1, 12)
    whole = (F.size("tmat") >= 12) & F.forall(m, lambda v: v.isNotNull() & ~F.isnan(v))
    return pose.where(F.col("seq").isNotNull() & F.col("line").isNotNull() & present(F.col("t")) & whole).select(
        F.col("seq").alias("source"), "line", "t", m.alias("values")
    )
