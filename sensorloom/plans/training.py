"""Queries and SQL of the general training-data operators (problems 2 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import regular_grid as grid
from sensorloom.operators import spikes
from sensorloom.session import table


def _tracks(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    imu, pose = table(spark, d, "imu_track"), table(spark, d, "pose_track")
    return [("imu", grid.validity_intervals(grid.imu_readings(imu))), ("pose", grid.validity_intervals(grid.pose_readings(pose)))]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (grid.filled_slots(i).select(F.lit(t).alias("track"), F.col("source").alias("seq"), "slot") for t, i in _tracks(spark, d))
    return a.unionByName(b)


def p2_series(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of every recording: how many readings, how much of it is covered, the time-weighted means, and its state."""
    imu, pose = grid.imu_readings(table(spark, d, "imu_track")), grid.pose_readings(table(spark, d, "pose_track"))
    means = F.transform("averages", lambda v: F.round(v, 6)).alias("averages")
    a, b = (grid.whole_series(r).select(F.lit(t).alias("track"), F.col("source").alias("seq"), "slot", "readings", F.round("coverage", 6).alias("coverage"), means, "state") for t, r in (("imu", imu), ("pose", pose)))
    return a.unionByName(b)


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    g = p2_series(spark, d).groupBy("track", "seq")
    return g.agg(F.count("*").alias("slots"), F.count_if(F.col("state") == "filled").alias("filled"), F.count_if(F.col("state") == "missing").alias("missing"), F.sum(F.round(F.col("coverage") * grid.SLOT_US).cast("bigint")).alias("covered_us"))


def _flags(spark: SparkSession, d: str, factor: float | None = None) -> list[tuple[str, DataFrame, DataFrame]]:
    imu, pose = spikes.imu_values(table(spark, d, "imu_track")), spikes.pose_values(table(spark, d, "pose_track"))
    return [("imu", *spikes.flag_readings(imu, "imu", factor)), ("pose", *spikes.flag_readings(pose, "pose", factor))]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Flagged readings by the stated factor of ten usual changes."""
    a, b = (f.select(F.lit(t).alias("track"), F.col("source").alias("seq"), "line") for t, f, _ in _flags(spark, d, spikes.FACTOR))
    return a.unionByName(b)


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flagged readings by the tail cutoffs at their fixed risk alone, with their severity."""
    a, b = (f.select(F.lit(t).alias("track"), F.col("source").alias("seq"), "line", "spike", F.round("severity", 5).alias("severity"), "stuck", "impossible") for t, f, _ in _flags(spark, d))
    return a.unionByName(b)


def p5_tails(spark: SparkSession, d: str) -> DataFrame:
    """The tails of the residuals per recording and channel, and their cutoffs."""
    rounded = [F.round(c, n).alias(c) for c, n in (("shape", 4), ("scale", 4), ("cutoff", 3))]
    a, b = (c.select(F.lit(t).alias("track"), F.col("source").alias("seq"), "channel", F.round("usual", 5).alias("usual"), "readings", "peaks", *rounded) for t, _, c in _flags(spark, d))
    return a.unionByName(b)


QUERIES = {f.__name__: f for f in (p2_found, p2_series, p2_coverage, p5_found, p5_flags, p5_tails)}

_GRID = """
valid AS (
  SELECT DISTINCT 'imu' AS track, seq, line, CAST(round(t * 1e6) AS BIGINT) AS us, [omega.x, omega.y, omega.z] AS vals FROM imu_track
  WHERE seq IS NOT NULL AND line IS NOT NULL AND t IS NOT NULL AND NOT isnan(t) AND NOT isnan(omega.x) AND NOT isnan(omega.y) AND NOT isnan(omega.z)
    AND omega.x IS NOT NULL AND omega.y IS NOT NULL AND omega.z IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'pose', seq, line, CAST(round(t * 1e6) AS BIGINT), [tmat[4], tmat[8], tmat[12]] FROM pose_track
  WHERE seq IS NOT NULL AND line IS NOT NULL AND t IS NOT NULL AND NOT isnan(t) AND len(list_filter(tmat[1:12], lambda v: v IS NOT NULL AND NOT isnan(v))) = 12
), intervals AS (
  SELECT track, seq, us, vals, lead(us) OVER (PARTITION BY track, seq ORDER BY us, line) AS next_us FROM valid
), held AS (
  SELECT track, seq, us, vals, CASE WHEN next_us - us <= 60000000 THEN next_us END AS until FROM intervals
), cells AS (
  SELECT track, seq, us, vals, coalesce(until, us) AS until, us // 100000 AS first, coalesce(until, us) // 100000 AS last, unnest(range(us // 100000, coalesce(until, us) // 100000 + 1)) AS slot FROM held
), gone AS (
  SELECT track, seq, unnest(range(us // 100000 + 1, next_us // 100000)) AS slot FROM intervals WHERE next_us - us > 60000000
)
"""



def _spike_sql(track: str) -> str:
    """CTEs of one track: {track}_res (seq, line, rates, stuck, impossible) and {track}_usual (seq, c, usual), by the definition of problem 5."""
    if track == "imu":
        own = "[omega.x, omega.y, omega.z, accel.x, accel.y, accel.z]"
        table_, ok, parts = "imu_track", f"len(list_filter({own}, lambda v: v IS NOT NULL AND NOT isnan(v))) = 6", 6
        channels = [f"v[{c}]" for c in range(1, 7)]
        norm = lambda cs: f"sqrt({' + '.join(f'v[{c}] * v[{c}]' for c in cs)})"
        bad = f"{norm((1, 2, 3))} > {spikes.MAX_OMEGA} OR {norm((4, 5, 6))} > {spikes.MAX_ACCEL}"
    else:
        own = "tmat[1:12]"
        table_, ok, parts = "pose_track", "len(list_filter(tmat[1:12], lambda v: v IS NOT NULL AND NOT isnan(v))) = 12", 1
        channels = ["v[4]", "v[8]", "v[12]"]
        row = lambda i, j: " + ".join(f"v[{4 * i + k}] * v[{4 * j + k}]" for k in (1, 2, 3))
        skew = ", ".join(f"abs({row(i, j)} - {int(i == j)})" for i in range(3) for j in range(3))
        det = "v[1] * (v[6] * v[11] - v[7] * v[10]) - v[2] * (v[5] * v[11] - v[7] * v[9]) + v[3] * (v[5] * v[10] - v[6] * v[9])"
        bad = f"greatest({skew}) > {spikes.MAX_SKEW} OR {det} < 0 OR greatest(abs(v[4]), abs(v[8]), abs(v[12])) > {spikes.MAX_POSITION}"

    def at(o: int, what: str = "v") -> str:
        return what if o == 0 else f"{'lag' if o < 0 else 'lead'}({what}, {abs(o)}) OVER w"

    reach = spikes.LONGEST_RUN
    around = ", ".join(f"{at(o, c)} AS {c}{'m' if o < 0 else 'p'}{abs(o)}" for o in range(-reach, reach + 1) for c in ("t", "v"))

    def name(o: int, what: str) -> str:
        return f"{what}{'m' if o < 0 else 'p'}{abs(o)}"

    def angle(a: int, b: int) -> str:
        trace = " + ".join(f"{name(a, 'v')}[{i}] * {name(b, 'v')}[{i}]" for i in (1, 2, 3, 5, 6, 7, 9, 10, 11))
        return f"acos(greatest(-1, least(1, ({trace} - 1) / 2)))"

    def rate(channel: str | None) -> str:
        runs = []
        for k in range(1, reach + 1):
            for j in range(1, k + 1):  # this reading is the j-th of a run of k
                p, q = -j, k + 1 - j
                enter, leave = f"greatest({name(p + 1, 't')} - {name(p, 't')}, 1e-6)", f"greatest({name(q, 't')} - {name(q - 1, 't')}, 1e-6)"
                each = []
                for m in range(p + 1, q):
                    if channel:
                        a, b = (f"({channel.replace('v[', name(m, 'v') + '[')} - {channel.replace('v[', name(e, 'v') + '[')})" for e in (p, q))
                        side = f"{a} * {b} > 0"
                    else:
                        a, b = angle(m, p), angle(m, q)
                        side = f"{angle(p, q)} < greatest({a}, {b})"
                    each.append(f"CASE WHEN {side} THEN least(abs({a}) / {enter}, abs({b}) / {leave}) ELSE 0 END")
                least = each[0] if k == 1 else f"least({', '.join(each)})"
                runs.append(f"CASE WHEN {name(p, 't')} IS NOT NULL AND {name(q, 't')} IS NOT NULL THEN {least} ELSE 0 END")
        return f"greatest({', '.join(runs)})::FLOAT::DOUBLE"

    if track == "imu":
        same = [f"v[{c}] = vm1[{c}]" for c in range(1, 7)]
        changes = [f"abs(v[{c}] - vm1[{c}])" for c in range(1, 7)]
    else:
        same = ["v = vm1"]
        changes = [*(f"abs({c} - {c.replace('v[', 'vm1[')})" for c in channels), angle(0, -1).replace("vp0", "v")]
    rates = [rate(c) for c in channels] + ([] if track == "imu" else [rate(None)])
    runs = ", ".join(f"sum(CASE WHEN {s} THEN 0 ELSE 1 END) OVER w AS s{i}" for i, s in enumerate(same))
    stuck = " OR ".join(f"count(*) OVER (PARTITION BY seq, s{i}) >= {spikes.SHORTEST_STUCK}" for i in range(parts))
    x = track
    return f"""{x}_r AS (SELECT DISTINCT seq, line, t, {own} AS v FROM {table_} WHERE seq IS NOT NULL AND line IS NOT NULL AND t IS NOT NULL AND NOT isnan(t) AND {ok}),
    {x}_a AS (SELECT seq, line, t, v, {around} FROM {x}_r WINDOW w AS (PARTITION BY seq ORDER BY line)),
    {x}_b AS (SELECT *, {runs} FROM {x}_a WINDOW w AS (PARTITION BY seq ORDER BY line)),
    {x}_res AS (SELECT seq, line, [{', '.join(rates)}] AS rates, {stuck} AS stuck, {bad} AS impossible FROM {x}_b),
    {x}_d AS (SELECT seq, unnest(range({len(rates)})) AS c, unnest([{', '.join(f'{c} / greatest(t - tm1, 1e-6)' for c in changes)}]) AS change FROM {x}_a WHERE tm1 IS NOT NULL),
    {x}_m AS (SELECT seq, c, list_sort(list(CAST(floor(log2(change) * {spikes.BINS_PER_OCTAVE}) AS BIGINT))) AS bins FROM {x}_d WHERE change > 0 AND NOT isinf(change) GROUP BY seq, c),
    {x}_usual AS (SELECT seq, c, pow(2.0::DOUBLE, (bins[(len(bins) + 1) // 2] + 0.5) / {spikes.BINS_PER_OCTAVE}) AS usual FROM {x}_m),
    {x}_z AS (SELECT r.seq, line, u.c, u.usual, rates[u.c + 1] / u.usual AS res FROM {x}_res r JOIN {x}_usual u ON r.seq = u.seq)"""


def _found_sql(track: str) -> str:
    return f"""SELECT '{track}' AS track, seq, line FROM {track}_res WHERE stuck OR impossible
      UNION SELECT '{track}', seq, line FROM {track}_z WHERE res > {spikes.FACTOR}"""


def _tails_sql(track: str, channels: tuple[str, ...], plain: bool = False) -> str:
    names = "[" + ", ".join(f"'{c}'" for c in channels) + "]"
    over, risk = f"{spikes.OVER}::DOUBLE", f"{spikes.RISK:.12f}::DOUBLE"
    cutoff = f"coalesce(greatest({over} + CASE WHEN abs(shape) > 1e-9 THEN scale / shape * (pow({risk} * readings / peaks, -shape) - 1) ELSE -scale * ln({risk} * readings / peaks) END, {over}), {spikes.FACTOR}::DOUBLE)"
    shown = f"""SELECT '{track}' AS track, seq, {names}[CAST(c AS INT) + 1] AS channel, round(usual, 5) AS usual, readings, peaks, round(shape, 4) AS shape, round(scale, 4) AS scale, round({cutoff}, 3) AS cutoff"""
    return f"""{f'SELECT seq, c, {cutoff} AS cutoff' if plain else shown}
    FROM (SELECT *, CASE WHEN peaks >= 10 AND v > 0 THEN 0.5::DOUBLE * (1 - m * m / v) END AS shape, CASE WHEN peaks >= 10 AND v > 0 THEN 0.5::DOUBLE * m * (m * m / v + 1) END AS scale
      FROM (SELECT seq, c, max(usual) AS usual, count(*) AS readings, count(*) FILTER (WHERE res > {over} AND res < {spikes.FACTOR}) AS peaks,
          avg(res - {over}) FILTER (WHERE res > {over} AND res < {spikes.FACTOR}) AS m, var_samp(res - {over}) FILTER (WHERE res > {over} AND res < {spikes.FACTOR}) AS v FROM {track}_z GROUP BY seq, c))"""


def _cutoff_sql(track: str) -> str:
    """(seq, c, cutoff) of the tails, unrounded."""
    return _tails_sql(track, spikes.IMU_CHANNELS if track == "imu" else spikes.POSE_CHANNELS, plain=True)


def _flags_sql(track: str) -> str:
    return f"""SELECT '{track}' AS track, r.seq, r.line, coalesce(severity > 1, false) AS spike, round(coalesce(severity, 0), 5) AS severity, stuck, impossible
      FROM {track}_res r LEFT JOIN (SELECT z.seq, z.line, max(res / cutoff) AS severity FROM {track}_z z JOIN ({_cutoff_sql(track)}) q ON q.seq = z.seq AND q.c = z.c GROUP BY ALL) s ON s.seq = r.seq AND s.line = r.line
      WHERE coalesce(severity > 1, false) OR stuck OR impossible"""


_SPIKES = f"{_spike_sql('imu')}, {_spike_sql('pose')}"
ORACLE = {
    "p2_found": f"WITH {_GRID} SELECT track, seq, slot FROM cells WHERE slot > first AND slot < last",
    "p2_coverage": f"""WITH {_GRID}, slots AS (
        SELECT track, seq, slot, count(*) FILTER (WHERE slot = first) AS readings, sum(least(until, (slot + 1) * 100000) - greatest(us, slot * 100000)) AS held FROM cells GROUP BY ALL),
        g AS (SELECT track, seq, count(*) AS missing FROM gone GROUP BY ALL)
        SELECT s.track, s.seq, count(*) + coalesce(any_value(missing), 0) AS slots, count(*) FILTER (WHERE readings = 0) AS filled, coalesce(any_value(missing), 0) AS missing, CAST(sum(least(held, 100000)) AS BIGINT) AS covered_us
        FROM slots s LEFT JOIN g ON g.track = s.track AND g.seq = s.seq GROUP BY s.track, s.seq""",
    "p2_series": f"""WITH {_GRID}, parts AS (SELECT *, least(until, (slot + 1) * 100000) - greatest(us, slot * 100000) AS held FROM cells), slots AS (
        SELECT track, seq, slot, count(*) FILTER (WHERE slot = first) AS readings, sum(held) AS held,
          [{', '.join(f'CASE WHEN sum(held) > 0 THEN sum(held * vals[{i}]) / sum(held) ELSE avg(vals[{i}]) FILTER (WHERE slot = first) END' for i in (1, 2, 3))}] AS averages FROM parts GROUP BY ALL)
        SELECT track, seq, slot, readings, round(least(1, held / 100000), 6) AS coverage, list_transform(averages, lambda v: round(v, 6)) AS averages, CASE WHEN readings = 0 THEN 'filled' WHEN held >= 100000 THEN 'measured' ELSE 'partial' END AS state FROM slots
        UNION ALL SELECT track, seq, slot, 0, 0.0, NULL, 'missing' FROM gone""",
    "p5_found": f"WITH {_SPIKES} {_found_sql('imu')} UNION ALL ({_found_sql('pose')})",
    "p5_flags": f"WITH {_SPIKES} {_flags_sql('imu')} UNION ALL {_flags_sql('pose')}",
    "p5_tails": f"WITH {_SPIKES} {_tails_sql('imu', spikes.IMU_CHANNELS)} UNION ALL {_tails_sql('pose', spikes.POSE_CHANNELS)}",
}
