"""Sequential operators against plain versions: tracks, pool and gate, instances, paths over the registered queries, transforms."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold import __main__ as cli
from terrafold import config as C
from terrafold.functions import frames
from terrafold.functions import lattice as L
from terrafold.operators import image, plan, tracks
from terrafold.plans import registry  # noqa: F401  first, as the queries' modules add themselves to it
from terrafold.plans import queries_engine, queries_image, queries_plan
from terrafold.sources import scans
from tests.test_core import relaxed

SF = "/root/testdata/sf0.001"
S = C.load("5_10_20_40")
DETECTION = "seq int, frame int, x_m double, y_m double, cls int"


# tracks ---------------------------------------------------------------------------------------------------------------

def plain_tracks(rows, cap=C.THRESHOLDS["track_capacity"]):
    """Predict, age, match greedily in 2.5 m, start new ones; ten frames without a match end a track."""
    out = []
    for seq in sorted({r[0] for r in rows}):
        live, n, last = [], 0, None
        for frame in sorted({r[1] for r in rows if r[0] == seq}):
            for _ in range(0 if last is None else frame - last):
                live = [t for t in live if t["age"] < 10]
                for t in live:
                    t.update(x=t["x"] + t["vx"] * 0.1, y=t["y"] + t["vy"] * 0.1, age=t["age"] + 1)
            last = frame
            for _, _, x, y, cls in sorted(r for r in rows if r[:2] == (seq, frame)):
                near = min(live, key=lambda t: math.hypot(t["x"] - x, t["y"] - y), default=None)
                if near and math.hypot(near["x"] - x, near["y"] - y) <= 2.5:
                    near.update(vx=(x - near["x"]) / 0.1, vy=(y - near["y"]) / 0.1, x=x, y=y, age=0)
                else:
                    if len(live) == cap:
                        live.remove(max(live, key=lambda t: t["age"]))
                    n += 1
                    live.append({"id": n, "x": x, "y": y, "vx": 0.0, "vy": 0.0, "cls": cls, "age": 0})
            out += [(seq, frame, t["id"], t["x"], t["y"], t["vx"], t["vy"], t["cls"], t["age"]) for t in live]
    return out


def close(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert len(a) == len(b) and all(x == y or isinstance(x, float) and x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b)), (a, b)


def test_tracks_keep_their_identity_and_end(spark):
    rows = [(0, f, 1.0 * f, 0.0, 5) for f in range(5)] + [(0, f, 50.0, 2.0, 1) for f in range(2)] + [(0, 30, 500.0, 0.0, 0)]
    t = tracks.track(spark.createDataFrame(rows, DETECTION)).toPandas()
    last = t[t.frame == 4].set_index("track_id")
    # seen at 0, 1, 2, ... m: at rest, then each step is measured from where the speed before foretold it
    assert last.loc[1, "x_m"] == 4 and last.loc[1, "cls"] == 5
    assert set(last.index) == {1, 2} and last.loc[2, "age"] == 3 and set(t[t.frame == 30].track_id) == {3}


def test_tracks_like_the_plain_version(spark, monkeypatch):
    r = random.Random(1)
    rows = list({(s, f, round(r.uniform(0, 30), 3), round(r.uniform(0, 30), 3), r.randrange(5)) for s in range(5) for f in r.sample(range(40), 25) for _ in range(r.randrange(12))})
    close(tracks.track(spark.createDataFrame(rows, DETECTION)).collect(), plain_tracks(rows))
    full = tracks.track(spark.createDataFrame([(0, f, 10.0 * k, 0.0, 1) for f in range(2) for k in range(300)], DETECTION))
    assert full.filter("frame = 1").count() == C.THRESHOLDS["track_capacity"]


def test_track_query_like_the_plain_version(spark):
    from terrafold.operators.scatter import cluster, moving
    from terrafold.plans.registry import points

    c = cluster(queries_image.sequenced(points(spark, SF).filter(moving(F.col("raw_label")))), key=("seq", "frame")).collect()
    rows = [(x.seq, x.frame, x.sx / x.n / 1000, x.sy / x.n / 1000, x.cls) for x in c]
    assert len(rows) > 100
    close(queries_image.st12_tracks(spark, SF).collect(), plain_tracks(rows))


# pool and gate --------------------------------------------------------------------------------------------------------

def test_migrated_is_migrate_ring(spark):
    r = random.Random(3)
    rows = [(r.uniform(-120, 120), r.uniform(-120, 120), r.randrange(-1, 4), r.choice([0.0, 4.0, 15.0, 30.0])) for _ in range(3000)]
    rows += [(sx * h * k, 0.0, c, 0.0) for h in (10.0, 25.0, 50.0, 100.0) for k in (1.0, 1.05, 1.1) for sx in (-1, 1) for c in range(4)]
    for s in (S, C.load("5_10_50")):
        own = [x for x in rows if x[2] < len(s.rings)]
        got = spark.createDataFrame(own, "x double, y double, c int, v double").select("*", L.migrate_ring(F.col("x"), F.col("y"), F.col("c"), s, F.col("v")).alias("r")).collect()
        assert all(L.migrated(g.x, g.y, g.c, s, g.v) == g.r for g in got)


def test_levels_that_fit():
    assert [tracks.levels_available(S, r) for r in range(4)] == [0, 1, 2, 2]
    assert [tracks.levels_available(C.load("5_10_50"), r) for r in range(3)] == [0, 1, 0]  # 5 x 5 children don't fit


def plain_pool(fired, rides, s, blocks):
    """Frame rows and block rows: release what the schedule has overtaken, then serve cells in the order ring, iy, ix."""
    counts, held = [], []
    for seq in sorted({k[0] for k in rides}):
        pool = [None] * blocks  # [cell, score]
        for frame in sorted(f for q, f in rides if q == seq):
            ex, ey, v = rides[seq, frame]
            n = dict.fromkeys(("released", "fired", "acquired", "refused", "unfit"), 0)

            def at(ring, ix, iy):
                size = s.rings[ring].cell_m
                return (ix + 0.5) * size - ex / 1000, (iy + 0.5) * size - ey / 1000

            for b, x in enumerate(pool):
                if x and L.migrated(*at(*x[0]), x[0][0], s, v) <= x[0][0] - 1:
                    pool[b] = None
                    n["released"] += 1
            for _, _, ring, ix, iy, dynamic in sorted((c for c in fired if c[:2] == (seq, frame)), key=lambda c: (c[2], c[4], c[3])):
                n["fired"] += 1
                if ring < 1:
                    continue
                if round(s.rings[ring].cell_m / s.rings[ring - 1].cell_m) ** 2 > C.THRESHOLDS["block_cells"]:
                    n["unfit"] += 1
                    continue
                x, y = at(ring, ix, iy)
                ttc = x / v if v > 1e-6 and x > 0 else math.inf
                score = 1 / (1 + math.hypot(x, y) / 10) * (4 if dynamic else 1) * max(1 / (1 + ttc / 3), 0.05)
                b = next((b for b, p in enumerate(pool) if p and p[0] == (ring, ix, iy)), None)
                if b is None:
                    b = next((b for b, p in enumerate(pool) if p is None), None)
                if b is None:
                    b = min(range(blocks), key=lambda b: (pool[b][1], b))
                    if pool[b][1] >= score:
                        n["refused"] += 1
                        continue
                pool[b] = [(ring, ix, iy), score]
                n["acquired"] += 1
            counts.append((seq, frame, *n.values()))
        held += [(seq, b, *p[0], 1, p[1]) for b, p in enumerate(pool) if p]
    return counts, held


def refined(spark, fired, rides, s, blocks):
    f = spark.createDataFrame(fired, "seq int, frame int, ring int, ix bigint, iy bigint, dynamic boolean")
    e = spark.createDataFrame([(*k, int(x), int(y), v) for k, (x, y, v) in rides.items()], "seq int, frame int, ego_x_mm bigint, ego_y_mm bigint, speed_ms double")
    r = tracks.refine(f, e, s, blocks)
    return r.filter("block IS NULL").select("seq", "frame", "released", "fired", "acquired", "refused", "unfit").collect(), r.filter("block IS NOT NULL").select("seq", "block", "ring", "ix", "iy", "levels", "score").collect()


@pytest.mark.parametrize("schedule, blocks", [("5_10_20_40", 8), ("5_10_50", 4), ("5_10_20_40", 512)])
def test_pool_like_the_plain_version(spark, schedule, blocks):
    r, s = random.Random(blocks), C.load(schedule)
    rides = {(q, f): (f * 3000.0, 0.0, 30.0) for q in range(3) for f in range(8)}
    fired = list({(q, f, ring, r.randrange(4, 30), r.randrange(-3, 3), r.random() < 0.2) for q in range(3) for f in range(8) if f != 4 for ring in range(len(s.rings)) for _ in range(6)})
    fired = list({x[:5]: x for x in fired}.values())
    counts, held = refined(spark, fired, rides, s, blocks)
    want = plain_pool(fired, rides, s, blocks)
    close(counts, want[0])
    close(held, want[1])
    assert sum(c[2] for c in want[0]) > 0 and (sum(c[5] for c in want[0]) > 0) == (blocks < 512) and (sum(c[6] for c in want[0]) > 0) == (schedule == "5_10_50")


def test_pool_evicts_the_least_only_for_more(spark):
    still = {(0, f): (0.0, 0.0, 0.0) for f in range(4)}
    near, mid, far = (1, 120, 0), (2, 140, 0), (3, 150, 0)  # of 12, 28 and 60 m
    fired = [(0, 0, *mid, False), (0, 0, *far, False), (0, 1, *near, False), (0, 2, *far, False), (0, 3, *mid, True)]
    counts, held = refined(spark, fired, still, S, 2)
    assert sorted((h.block, h.ring) for h in held) == [(0, 2), (1, 1)]  # far went for near and isn't let in again
    assert [c.refused for c in sorted(counts)] == [0, 0, 1, 0]
    assert next(h.score for h in held if h.ring == 2) == pytest.approx(4 / (1 + 28.1 / 10) * 0.05, rel=1e-3)


def test_pool_queries_like_the_plain_version(spark):
    fired = [(x.seq, x.frame, x.ring, x.ix, x.iy, x.dynamic) for x in queries_image.fired(spark, SF).collect()]
    rides = {(x.seq, x.frame): (x.ego_x_mm, x.ego_y_mm, x.speed_ms) for x in queries_image.rides(spark).collect()}
    want = plain_pool(fired, rides, S, C.THRESHOLDS["pool_blocks"])
    close(queries_image.st15_gate(spark, SF).collect(), want[0])
    close(queries_image.st14_pool(spark, SF).collect(), want[1])
    kids = collections.Counter((x.seq, x.block) for x in queries_image.st15_fill(spark, SF).collect())
    assert kids == {(h[0], h[1]): 4 for h in want[1]}


# instances ------------------------------------------------------------------------------------------------------------

def plain_instances(pixels, tolerance=0.75, least=4):
    """Groups of pixels by merging sets: (n, first pixel, centre, mean range, box), largest first."""
    group = {p: {p} for p in pixels}
    for v, u in pixels:
        for q in ((v + 1, u), (v, (u + 1) % 512)):
            if q in pixels and group[v, u] is not group[q] and abs(pixels[v, u][0] - pixels[q][0]) <= tolerance:
                group[v, u] |= group[q]
                for p in group[q]:
                    group[p] = group[v, u]
    found = sorted({id(g): sorted(g) for g in group.values() if len(g) >= least}.values(), key=lambda g: (-len(g), g[0]))
    return [(k, len(g), *np.mean([pixels[p][1:] for p in g], 0).tolist(), float(np.mean([pixels[p][0] for p in g])), *np.min([pixels[p][1:] for p in g], 0).tolist(), *np.max([pixels[p][1:] for p in g], 0).tolist()) for k, g in enumerate(found, 1)]


def as_rows(frame, pixels):
    return [(frame, v, u, *map(float, x)) for (v, u), x in pixels.items()]


PIXEL = "frame int, v int, u int, r double, x double, y double, z double"


def test_instances_like_the_plain_version(spark):
    r = random.Random(5)
    images = {f: {(r.randrange(10), r.choice([*range(14), *range(500, 512)])): (10 + r.choice([0, 0.5, 1.0, 3.0]), r.random(), r.random(), r.random()) for _ in range(120)} for f in range(4)}
    images[9] = {(3, u % 512): (20.0, 1.0, 2.0, 3.0) for u in range(509, 515)}  # over the seam
    images[10] = {(3, u): (20.0, 1.0, 2.0, 3.0) for u in range(3)}  # too few
    got = tracks.instances(spark.createDataFrame([x for f, p in images.items() for x in as_rows(f, p)], PIXEL)).collect()
    close(got, [(f, *x) for f, p in images.items() for x in plain_instances(p)])
    assert [x.n for x in got if x.frame == 9] == [6] and not [x for x in got if x.frame == 10]


def test_instance_query_like_the_plain_version(spark):
    from terrafold.operators.scatter import moving

    rows = queries_image.projected(spark, SF).filter(moving(F.col("raw_label"))).collect()
    images = collections.defaultdict(dict)
    for x in rows:
        images[x.frame][x.v, x.u] = (x.r, x.x, x.y, x.z)
    close(queries_image.agg13_instances(spark, SF).collect(), [(f, *x) for f, p in images.items() for x in plain_instances(p)])
    images = collections.defaultdict(dict)
    for x in queries_image.scene_pixels(spark).collect():
        images[x.frame][x.v, x.u] = (x.r, x.x, x.y, x.z)
    got = queries_image.agg13_scene(spark, SF).collect()
    close(got, [(f, *x) for f, p in images.items() for x in plain_instances(p)])
    assert len(got) > 20


# paths ----------------------------------------------------------------------------------------------------------------

def grids(spark, step_blocks=True):
    out = collections.defaultdict(lambda: np.full((48, 48), np.inf))
    for x in queries_plan.costs(spark, SF, step_blocks).collect():
        out[x.tile][x.ix, x.iy] = math.inf if x.cost is None else x.cost
    return out


def test_path_queries_like_the_plain_version(spark):
    true, flat = grids(spark), grids(spark, False)
    a, b = queries_plan.START, queries_plan.GOAL
    got = {x.tile: x for x in queries_plan.qry10_plan(spark, SF).collect()}
    best = {t: relaxed(c, a) for t, c in true.items()}
    assert got.keys() == true.keys()
    for t, x in got.items():
        assert x.found == math.isfinite(best[t][b]) and (not x.found or x.cost == pytest.approx(best[t][b], abs=1e-6))
    near = collections.defaultdict(dict)
    for x in queries_plan.qry12_corridor(spark, SF).collect():
        near[x.tile][x.ix, x.iy] = x.slack
    for t, c in list(true.items())[:2]:
        cells = list(zip(*(v.tolist() for v in np.nonzero(np.isfinite(c)))))
        for p in [b, a, *random.Random(t).sample(cells, 12)]:
            slack = best[t][p] + relaxed(c, p)[b] - best[t][b]
            if abs(slack - C.THRESHOLDS["corridor_tau"]) > 1e-9 and math.isfinite(best[t][b]):
                assert (p in near[t]) == (slack < C.THRESHOLDS["corridor_tau"]) and (p not in near[t] or near[t][p] == pytest.approx(slack, abs=1e-5))
    regret = {x.tile: x for x in queries_plan.qry13_regret(spark, SF).collect()}
    paths = {x.tile: [(q["ix"], q["iy"]) for q in x.path] for x in plan.plan(queries_plan.costs(spark, SF, False), a, b).collect()}
    for t, c in true.items():
        p = paths[t]
        paid = sum(c[q] * math.dist(o, q) * 0.25 for o, q in zip(p, p[1:]))
        want = None if math.isinf(paid) or not p or not math.isfinite(best[t][b]) else (paid - best[t][b]) / best[t][b]
        got_t = regret[t].regret
        assert (got_t is None) == (want is None) and (want is None or got_t == pytest.approx(want, abs=1e-5))
        assert math.isfinite(relaxed(flat[t], a)[b]) == regret[t].found_mine


def plain_regrets(mine, truth, queries):
    """(found, best, paid, regret) of each query; of equal ways back to the smaller cell."""
    out = []
    for s, g in queries:
        d, best = relaxed(mine, s), relaxed(truth, s)[g]
        path = [g] if math.isfinite(d[g]) else []
        while path and path[-1] != s:
            x, y = path[-1]
            near = [((x - i, y - j), size) for i, j, size in plan.STEPS if 0 <= x - i < mine.shape[0] and 0 <= y - j < mine.shape[1]]
            path.append(min(near, key=lambda q: (d[q[0]] + mine[x, y] * q[1] * 0.25, q[0]))[0])
        paid = sum(truth[p] * math.dist(p, q) * 0.25 for p, q in zip(path, path[1:]))
        known = bool(path) and math.isfinite(best) and math.isfinite(paid) and best > 0
        out.append((bool(path), best, paid if known else None, (paid - best) / best if known else None))
    return out


def test_seeded_queries():
    r = np.random.default_rng(3)
    want = [((1, 44 // 2 - 6), (42, 44 // 2 - 6))]
    for _ in range(4):
        a, b = int(r.integers(1, 43)), int(r.integers(1, 43))
        want.append(((1, a), (42, b)))
    assert plan.plan_queries(5, 44, 3) == want
    assert all(s[1] == 1 and g[1] == 42 for s, g in plan.plan_queries(9, 44, family="lateral")) and len(plan.plan_queries(9, 44, family="lateral")) == 9
    with pytest.raises(ValueError):
        plan.plan_queries(1, 44, family="diagonal")


def test_average_regret_like_the_plain_version(spark):
    true, flat = grids(spark), grids(spark, False)
    queries = [(q[2:4], q[4:6]) for q in queries_engine._queries]
    assert len(queries) == 64
    rows = {x.tile: x for x in queries_engine.agg28_regret_average(spark, SF).collect()}
    assert rows.keys() == true.keys()
    for t in list(true)[:2]:
        r = plain_regrets(flat[t], true[t], queries)
        values = [x[3] for x in r if x[3] is not None]
        assert (rows[t].queries, rows[t].found, rows[t].blocked, rows[t].finite) == (64, sum(x[0] for x in r), sum(not x[0] for x in r), len(values))
        if len(values) > 1:
            assert rows[t].mean_regret == pytest.approx(np.mean(values), abs=1e-5) and rows[t].sd == pytest.approx(np.std(values, ddof=1), abs=1e-5)


def test_window_regret_like_the_plain_version(spark):
    def window(df):
        c, unknown = np.full((64, 64), np.inf), np.ones((64, 64), bool)
        for x in queries_engine.lattice_costs(df).collect():
            c[x.ix, x.iy], unknown[x.ix, x.iy] = math.inf if x.cost is None else x.cost, x.unknown
        return c, unknown

    (mine, a), (truth, b) = (window(q(spark, SF)) for q in (queries_engine.qry07_gridmap, queries_engine.qry08_reference_lattice))
    for c in (mine, truth):
        c[a | b] = np.inf
    queries = plan.plan_queries(8, 64) + plan.plan_queries(8, 64, family="lateral")
    got = sorted(queries_engine.qry13_window_regret(spark, SF).collect(), key=lambda x: x.query)
    for x, (found, best, paid, regret) in zip(got, plain_regrets(mine, truth, queries), strict=True):
        assert x.found == found and (x.best is None) == math.isinf(best) and (x.regret is None) == (regret is None)
        assert regret is None or (x.paid, x.regret) == (pytest.approx(paid, abs=1e-5), pytest.approx(regret, abs=1e-5))


def test_regrets_on_open_ground(spark):
    r = np.random.default_rng(4)
    mine, truth = (r.choice([1.0, 3.0, 6.0, np.inf], (20, 20), p=[0.5, 0.3, 0.15, 0.05]) for _ in range(2))
    df = [spark.createDataFrame([(0, i, j, None if math.isinf(c[i, j]) else float(c[i, j])) for i in range(20) for j in range(20)], "tile int, ix int, iy int, cost double") for c in (mine, truth)]
    queries = plan.plan_queries(12, 20) + plan.plan_queries(12, 20, family="lateral")
    got = sorted(plan.regrets(*df, queries).collect(), key=lambda x: x.query)
    want = plain_regrets(mine, truth, queries)
    assert sum(x[3] is not None for x in want) > 3
    for x, (found, best, paid, regret) in zip(got, want, strict=True):
        assert x.found == found and (regret is None) == (x.regret is None) and (regret is None or x.regret == pytest.approx(regret))


def plain_frechet(a, b):
    seen = {}

    def reach(i, j):
        if (i, j) not in seen:
            d = math.dist(a[i], b[j])
            before = [reach(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            seen[i, j] = max(d, min(before)) if before else d
        return seen[i, j]

    for i in range(len(a)):
        for j in range(len(b)):
            reach(i, j)
    return seen[len(a) - 1, len(b) - 1]


def test_frechet_query_like_the_plain_version(spark):
    a, b = (plan.plan(queries_plan.costs(spark, SF, x), queries_plan.START, queries_plan.GOAL).collect() for x in (True, False))
    other = {x.tile: x.path for x in b}
    for x in a:
        if x.found and other[x.tile]:
            want = plain_frechet(*([(0.25 * q["ix"], 0.25 * q["iy"]) for q in p] for p in (x.path, other[x.tile])))
            assert queries_plan.qry15_frechet(spark, SF).filter(F.col("tile") == x.tile).first().frechet_m == pytest.approx(want, abs=1e-5)
            return


# transforms -----------------------------------------------------------------------------------------------------------

def four(m):
    return np.vstack([np.reshape(m, (3, 4)), [0, 0, 0, 1]])


def turned(r):
    a, _ = np.linalg.qr(np.random.default_rng(r).normal(size=(3, 3)))
    return np.hstack([a * np.sign(np.linalg.det(a)), np.random.default_rng(r + 1).normal(size=(3, 1)) * 5])


def test_transforms_like_matrices(spark):
    pose, tr, other = turned(1), turned(3), turned(5)
    down = four(frames.shifted(-1.73))
    want = four(frames.FLIP) @ four(pose) @ four(tr) @ down
    df = spark.createDataFrame([(pose.reshape(-1).tolist(), other.reshape(-1).tolist())], "m array<double>, o array<double>")
    w = frames.vehicle_to_world(F.col("m"), tr.reshape(-1).tolist())
    got = df.select(w.alias("w"), frames.inverse(w).alias("i"), frames.relative(F.col("m"), F.col("o")).alias("r"), F.array(*frames.apply(w, F.lit(1.0), F.lit(-2.0), F.lit(0.5))).alias("p")).first()
    assert np.allclose(four(got.w), want) and np.allclose(four(got.i) @ want, np.eye(4)) and np.allclose(four(got.r), np.linalg.inv(four(other)) @ four(pose))
    assert np.allclose(got.p, (want @ [1, -2, 0.5, 1])[:3])
    # camera right, down and forward are the vehicle's -y, -z and x
    axes = np.reshape(frames.FLIP, (3, 4))[:, :3]
    assert (axes @ [0, 0, 1] == [1, 0, 0]).all() and (axes @ [1, 0, 0] == [0, -1, 0]).all() and (axes @ [0, 1, 0] == [0, 0, -1]).all()
    with pytest.raises(ValueError):
        frames.constant([1.0])


def sequence(tmp_path, seq="04", n=3):
    """A sequence with a calibration and poses that aren't the identity: the vehicle drives 2 m a frame and turns."""
    r, tr = np.random.default_rng(2), np.array([[0, -1, 0, 0.1], [0, 0, -1, -0.2], [1, 0, 0, -0.3]], float)
    poses = [np.array([[math.cos(0.1 * f), 0, math.sin(0.1 * f), 0.3 * f], [0, 1, 0, -0.02 * f], [-math.sin(0.1 * f), 0, math.cos(0.1 * f), 2.0 * f]]) for f in range(n)]
    scan = [(np.column_stack([r.uniform(-30, 30, (400, 2)), r.uniform(-1.9, 0.5, 400), r.uniform(0, 1, 400)]).astype("f4"), r.choice([40, 48, 50, 70, 252, 10 + (7 << 16)], 400)) for _ in range(n)]
    scans.write_sequence(str(tmp_path), seq, scan, np.array(poses), tr)
    return scan, poses, tr


def test_points_of_a_sequence_are_in_the_world(spark, tmp_path):
    scan, poses, tr = sequence(tmp_path)
    got = {(x.frame, x.point_id): x for x in scans.points(spark, str(tmp_path), "04").collect()}
    assert len(got) == 1200
    world = [four(frames.FLIP) @ four(p) @ four(tr) for p in poses]  # from the sensor
    datum = (world[0] @ [0, 0, -1.73, 1])[2]
    for (f, i), x in got.items():
        p = scan[f][0][i].astype(float)
        w = world[f] @ [*p[:3], 1]
        assert (abs(x.xw_mm / 1000 - w[0]), abs(x.yw_mm / 1000 - w[1])) < (0.0006, 0.0006) and abs(x.z_cm / 100 - (w[2] - datum)) < 0.0051
        assert abs(x.xv_mm / 1000 - p[0]) < 0.0006 and x.raw_label == int(scan[f][1][i]) & 65535
    assert {x.cls for x in got.values()} == {8, 10, 12, 14, 0} and {x.frame for x in scans.points(spark, str(tmp_path), "04", start=1, most=1).collect()} == {1}


def test_sources_of_poses(spark, tmp_path, monkeypatch):
    import os

    sequence(tmp_path, "08")
    root = str(tmp_path)
    assert scans.sequence_exists(spark, root, "08") and not scans.sequence_exists(spark, root, "05") and scans.frame_count(spark, root, "08") == 3
    assert scans.pose_path(root, "08", spark=spark).endswith("sequences/08/poses.txt")
    os.remove(f"{root}/sequences/08/poses.txt")
    with pytest.warns(RuntimeWarning):
        assert scans.pose_path(root, "08", spark=spark).endswith("poses/08.txt")
    monkeypatch.setenv(scans.SOURCE_VARIABLE, "gt")
    assert scans.pose_path(root, "08").endswith("poses/08.txt")
    monkeypatch.setenv(scans.SOURCE_VARIABLE, "gps")
    with pytest.raises(ValueError):
        scans.pose_source("08")


def test_a_scan_without_a_pose_is_an_error(spark, tmp_path):
    scan, poses, tr = sequence(tmp_path)
    scans.write_sequence(str(tmp_path), "04", scan, np.array(poses[:2]), tr)
    with pytest.raises(Exception, match="no pose for frame 2"):
        scans.points(spark, str(tmp_path), "04").collect()


def test_command_line_maps_a_sequence(spark, tmp_path, capsys):
    sequence(tmp_path)
    cli.main([str(tmp_path), "04", "--out", str(tmp_path / "out")])
    said = capsys.readouterr().out.split("\n")
    assert said[0].split()[:2] == ["ring", "cells"] and len(said) > 2
    state = spark.read.parquet(str(tmp_path / "out/state"))
    assert state.count() > 100 and state.agg(F.max(F.abs("mu"))).first()[0] < 600
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path), "99"])


def test_pixel_values_go_to_all_points_of_a_pixel(spark):
    p = spark.createDataFrame([(0, i, 10.0 + i, 0.001, 0.0, 7 * i) for i in range(4)] + [(0, 9, 0.0, 0.0, 0.0, 1)], "frame int, point_id bigint, x double, y double, z double, refl int")
    px = image.project(p, ["refl"])
    got = {x.point_id: x.refl0 for x in image.to_points(p, px.withColumnRenamed("refl", "refl0"), ["refl0"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: None}
