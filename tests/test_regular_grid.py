import math

from pyspark.sql import functions as F

from sensorloom.operators import regular_grid as grid

IMU = "seq string, line bigint, t double, omega struct<x:double,y:double,z:double>, slot string, values string"


def imu(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], IMU)


def brute(readings, slot=100_000, gap=60_000_000):
    """(seq, slot) of empty slots between successive valid readings."""
    out = set()
    for seq in {s for s, _ in readings}:
        ts = sorted({t for s, t in readings if s == seq})
        for a, b in zip(ts, ts[1:]):
            if b - a <= gap:
                out |= {(seq, n) for n in range(a // slot + 1, b // slot)}
    return out


def test_filled_slots_match_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows, t = [], 1_700_000_000_000_000
    for i in range(400):
        t += rnd.choice([1, 9_000, 10_000, 100_000, 250_000, 60_000_000, 60_000_001, 90_000_000])
        rows.append((rnd.choice("ab"), i, t / 1e6, (1.0, 2.0, 3.0)))
    rows += rows[:50]  # re-delivered
    rnd.shuffle(rows)
    got = {tuple(r) for r in grid.filled_slots(grid.validity_intervals(grid.imu_readings(imu(spark, rows)))).collect()}
    want = brute([(s, round(t * 1e6)) for s, _, t, _ in rows])
    assert got == want and want


def test_invalid_readings_take_no_part(spark):
    nan = float("nan")
    rows = [("a", 1, 0.0, (1.0, 1.0, 1.0)), ("a", 2, 0.15, (nan, 1.0, 1.0)), ("a", 3, 0.25, (None, 1.0, 1.0)), ("a", 4, None, (1.0, 1.0, 1.0)), ("a", 5, 0.45, (1.0, 1.0, 1.0)), (None, 6, 0.5, (1.0, 1.0, 1.0)), ("a", 7, nan, (1.0, 1.0, 1.0))]
    got = grid.filled_slots(grid.validity_intervals(grid.imu_readings(imu(spark, rows))))
    assert sorted(r.slot for r in got.collect()) == [1, 2, 3]


def test_series_weights_by_time(spark):
    rows = [("a", 1, 0.0, (0.0, 0.0, 0.0)), ("a", 2, 0.05, (10.0, 0.0, 0.0)), ("a", 2, 0.05, (10.0, 0.0, 0.0)), ("a", 3, 0.35, (20.0, 0.0, 0.0))]
    s = {r.slot: r for r in grid.regular_series(grid.validity_intervals(grid.imu_readings(imu(spark, rows)))).collect()}
    assert s[0].readings == 2 and math.isclose(s[0].averages[0], 5.0) and s[0].state == "measured"
    assert s[1].state == s[2].state == "filled" and s[1].averages[0] == 10.0 and s[1].coverage == 1.0
    assert s[3].state == "partial" and math.isclose(s[3].coverage, 0.5) and s[3].averages[0] == 10.0


def test_lone_last_reading_keeps_its_value(spark):
    s = grid.regular_series(grid.validity_intervals(grid.imu_readings(imu(spark, [("a", 1, 0.02, (4.0, 0.0, 0.0))])))).collect()
    assert len(s) == 1 and s[0].averages[0] == 4.0 and s[0].coverage == 0.0


def test_empty(spark):
    assert grid.filled_slots(grid.validity_intervals(grid.imu_readings(imu(spark, [])))).count() == 0
    assert grid.regular_series(grid.validity_intervals(grid.imu_readings(imu(spark, [])))).count() == 0


def test_gap_over_a_block_edge(spark):
    rows = [("a", 1, 59.95, (1.0, 1.0, 1.0)), ("a", 2, 60.31, (1.0, 1.0, 1.0)), ("a", 3, 120.31, (1.0, 1.0, 1.0)), ("a", 4, 180.32, (1.0, 1.0, 1.0))]
    got = grid.filled_slots(grid.validity_intervals(grid.imu_readings(imu(spark, rows)))).where(F.col("slot") < 700)
    assert sorted(r.slot for r in got.collect()) == [600, 601, 602, *range(604, 700)]
