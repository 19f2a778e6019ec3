import math
import random

from sensorloom.llm.nearest_time import match_frames, nearest_in_time
from sensorloom.llm.score_cutoff import kept_items, score_cutoffs
from sensorloom.llm.split_overlap import capture_stamp_ns, cross_split_overlap, found_pairs, overlap_of_classes, overlap_report


def pose(x, y, z, deg):
    a = math.radians(deg)
    return [float(v) for v in (math.cos(a), -math.sin(a), 0, x, math.sin(a), math.cos(a), 0, y, 0, 0, 1, z)]


def test_stamps(spark):
    names = {
        "1690474652814123_rgb.png": 1690474652814123000, "./a\\b/00001690474652814123_RGB.PNG": 1690474652814123000, "1690474652814123000.jpg": 1690474652814123000,
        "cam0/rgb/1690474652814123-rgb (1).png.bak": 1690474652814123000, "42.png": 42000, "none.png": None, "": None, None: None, "9" * 25: None,
    }
    d = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.s for r in d.select("n", capture_stamp_ns(d.n).alias("s")).collect()} == names


def test_overlap_matches_all_pairs(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(260):
        # many on a few spots, so that tolerances are met and missed
        x, y, deg = rnd.choice([0, 0.015, 0.019, 0.021, 0.04]), rnd.choice([0, 0.005, -0.01]), rnd.choice([0, 0.5, 0.99, 1.01, 359.5, 90])
        m = None if rnd.random() < 0.1 else pose(x, y, 0.5, deg)
        if m and rnd.random() < 0.05:
            m[3] = rnd.choice([float("nan"), None])
        name = rnd.choice([None, f"{1690000000000000 + rnd.randrange(60)}_rgb.png", f"a/{1690000000000000 + rnd.randrange(60)}000.png"])
        rows.append((i, rnd.choice(["s", "t", None]), rnd.choice(["train", "val", "test", None]), name, m, "extra"))
    rows += rows[:40]
    d = spark.createDataFrame(rows, "rec_id bigint, seq string, split string, rgb_name string, tmat array<double>, gram string")
    o = cross_split_overlap(d)
    got = [tuple(r) for r in found_pairs(o).collect()]
    assert len(got) == len(set(got))

    def stamp(n):
        if n is None:
            return None
        v = n.split("/")[-1].split("_")[0].split(".")[0].lstrip("0")
        return int(v) * (1000 if len(v) == 16 else 1)

    def ok(m):
        return m is not None and all(v is not None and math.isfinite(v) for v in m)

    want = set()
    uniq = {r[0]: r for r in rows}.values()
    for a in uniq:
        for b in uniq:
            if a[1] and a[1] == b[1] and a[2] in ("val", "test") and b[2] == "train":
                hit = stamp(a[3]) is not None and stamp(a[3]) == stamp(b[3])
                if ok(a[4]) and ok(b[4]):
                    shift = math.dist([a[4][i] for i in (3, 7, 11)], [b[4][i] for i in (3, 7, 11)])
                    tr = sum(a[4][i] * b[4][i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10))
                    hit = hit or (shift**2 <= 0.02**2 and tr >= 1 + 2 * math.cos(math.radians(1)))
                if hit:
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert set(got) == want and want
    assert overlap_report(o).where("eval_records < 1 or links < eval_records").count() == 0
    pairs, members = overlap_of_classes(d)
    of = {}
    for r in members.collect():
        assert r.rec_id not in of
        of[r.rec_id] = r.class_id
    assert set(of) == {r[0] for r in uniq if r[1] and r[2]}
    inside = {c: [r for r, k in of.items() if k == c] for c in set(of.values())}
    assert {tuple(sorted((a, b))) for r in pairs.collect() for a in inside[r.eval_id] for b in inside[r.train_id]} == want
    assert cross_split_overlap(d.where("false")).count() == 0


def brute_cutoff(scores, q):
    v = sorted(scores)
    return next(c for c in v if sum(x <= c for x in v) >= q * len(v))


def test_cutoffs_are_exact(spark):
    rnd = random.Random(6)
    nan, inf = float("nan"), float("inf")
    make = {
        "uniform": lambda: rnd.random(), "ties": lambda: rnd.choice([0.0, 0.1, 0.1, 0.2]), "huge": lambda: 10 ** rnd.uniform(-300, 300), "one": lambda: 3.5,
        "late": lambda: 1e308 if rnd.random() < 0.5 else rnd.random() * 1e-300, "exp": lambda: rnd.expovariate(1),
    }
    rows, valid = [], {}
    for s, f in make.items():
        for i in range(400):
            x = f()
            rows.append((s, f"n{i}", x, 1.0))
            valid.setdefault(s, []).append(x)
    rows += rows[::5]  # repeated rows
    rows += [("uniform", f"bad{i}", b, 1.0) for i, b in enumerate((None, nan, inf, -inf, -0.5))] + [(None, "x", 0.1, 1.0), ("unasked", "x", 0.1, 1.0)]
    fr = {"uniform": 0.625, "ties": 0.5, "huge": 0.75, "one": 0.3, "late": 0.9, "exp": 1.0}
    scores = spark.createDataFrame(rows, "seq string, name string, rate_px_per_ms_med double, keep_fraction double")
    fractions = spark.createDataFrame([*fr.items(), *list(fr.items())[:2], ("nobody", 0.5), ("unasked", None)], "seq string, keep_fraction double")
    for snap in (4096, 64, 3):  # read off after one pass, after some, and after many
        cutoffs, items = score_cutoffs(scores, fractions, snap_rows=snap)
        got = {r.source: r for r in cutoffs.collect()}
        assert set(got) == set(fr)
        assert all(r.passes >= 1 for r in got.values())
        for s in ("uniform", "ties", "one", "exp"):
            c, q = got[s].cutoff, fr[s]
            loss = {v: sum(q * max(x - v, 0) + (1 - q) * max(v - x, 0) for x in valid[s]) for v in set(valid[s])}
            assert abs(got[s].loss - loss[c]) < 1e-6 and loss[c] <= min(loss.values()) + 1e-9
        for s, q in fr.items():
            assert got[s].cutoff == brute_cutoff(valid[s], q), s
            assert got[s].n == 400
        kept = {r.source: r["count"] for r in kept_items(cutoffs, items).groupBy("source").count().collect()}
        assert kept == {s: sum(x <= got[s].cutoff for x in valid[s]) for s in fr}
    e, _ = score_cutoffs(scores.where("false"), fractions)
    assert e.count() == 0


def test_one_source_with_a_third_of_all_rows(spark):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"s{i % 40}", f"n{i}", rnd.choice([rnd.random(), rnd.expovariate(3), 0.25, 1e-9 * rnd.random()])) for i in range(9000)]
    scores = spark.createDataFrame(rows, "seq string, name string, rate_px_per_ms_med double").repartition(4)
    names = sorted({r[0] for r in rows})
    fractions = spark.createDataFrame([(s, 0.3 + 0.01 * i) for i, s in enumerate(names)], "seq string, keep_fraction double")
    got = {r.source: r for r in score_cutoffs(scores, fractions)[0].collect()}
    for i, s in enumerate(names):
        v = sorted(x for n, _, x in rows if n == s)
        assert got[s].cutoff == next(c for k, c in enumerate(v) if k + 1 == len(v) or v[k + 1] > c and k + 1 >= (0.3 + 0.01 * i) * len(v)), s
    assert got["hot"].passes >= 2


def test_nearest_matches_brute_force(spark):
    rnd = random.Random(8)
    base = 1_700_000_000_000_000
    right = sorted(rnd.sample(range(base, base + 4_000_000), 300))
    r = [(rnd.choice("ab"), t, i) for i, t in enumerate(right)] + [(None, base, 999), ("a", None, 998)]
    left = [(rnd.choice("ab"), base + rnd.randrange(-100_000, 4_100_000), i) for i in range(400)] + [("a", None, 900), (None, base, 901), ("c", base, 902)]
    ld = spark.createDataFrame(left + left[:20], "seq string, at bigint, frame bigint")
    rd = spark.createDataFrame(r + r[:50], "seq string, at bigint, line bigint").selectExpr("*", "'x' as frame")
    for tick in (None, 1_000, 500_000):
        got = {(x.frame, x.line) for x in nearest_in_time(ld, rd, 20_000, "at", "at", "frame", "line", tick_us=tick).collect()}
        want = set()
        for s, t, i in left:
            c = [(abs(t - u), u, j) for v, u, j in r if s and v == s and t is not None and u is not None and abs(t - u) <= 20_000]
            if c:
                want.add((i, min(c)[2]))
        assert got == want and want


def test_match_frames_edges(spark):
    t = 1_700_000_000.0
    f = spark.createDataFrame(
        [(1, "a", t, t + 0.05, "p"), (1, "a", t, t + 0.05, "p"), (2, "a", t + 0.02, None, "p"), (3, None, t, t, "p"), (4, "a", None, t, "p"), (5, "a", float("nan"), None, "p"), (6, "b", t, t, "p")],
        "frame_id bigint, seq string, t double, t_depth double, line string",
    )
    p = spark.createDataFrame([("a", 1, t - 0.02), ("a", 2, t + 0.04), ("a", 2, t + 0.04), ("a", 3, None), ("b", 1, t - 0.020001)], "seq string, line bigint, t double")
    i = spark.createDataFrame([("a", 1, t + 0.008), ("a", 2, t - 0.0081)], "seq string, line bigint, t double")
    got = sorted((r.frame_id, r.clock, r.line) for r in match_frames(f, p, i).collect())
    assert got == [(1, "depth_pose", 2), (1, "rgb_imu", 1), (1, "rgb_pose", 1), (2, "depth_pose", 2), (2, "rgb_pose", 2), (4, "depth_pose", 1)]
    assert match_frames(f.where("false"), p, i).count() == 0 and match_frames(f, p.where("false"), i.where("false")).count() == 0
