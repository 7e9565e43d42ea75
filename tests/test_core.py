"""Operators on hand-made inputs: known numbers, twin implementations, theorems, order independence, negative controls."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold import config as C
from terrafold.functions import lattice as L
from terrafold.functions import sensor
from terrafold.operators import fold, image, plan, pyramid, query, scatter, stencil, tracks

S = C.load("5_10_20_40")


# lattice and configuration ------------------------------------------------------------------------------------------

def test_schedules():
    assert (S.total_cells, S.slots) == (745_000, 910_000) and (C.load("5/10/50").total_cells, C.load("5_10_50").slots) == (520_000, 570_000)
    assert C.uniform(0.1, 100).total_cells == 4_000_000
    for rings in [(C.Ring(0, 10, 0.2), C.Ring(1, 20, 0.5)), (C.Ring(0, 10, 0.07),), (C.Ring(0, 10, 0.05), C.Ring(1, 10, 0.1))]:
        with pytest.raises(C.ScheduleError):
            C.Schedule("bad", rings).validate()
    with pytest.warns(UserWarning):
        C.Schedule("coarse", (C.Ring(0, 10, 0.2, 3.5),)).validate()
    assert [C.stencil_k(c, 0.5) for c in (0.05, 0.1, 0.2, 0.4)] == [5, 2, 1, 1] and [C.rim_r(c) for c in (0.05, 0.1, 0.2, 0.4)] == [15, 8, 4, 2]
    assert C.class_ids(["road", "person"]) == [8, 5] and C.digest() == C.digest(dict(reversed(C.THRESHOLDS.items())))
    with pytest.raises(ValueError):
        C.class_ids(["unicorn"])


def test_floor_division_is_not_the_floor_of_the_quotient(spark):
    x = [i / 20 for i in range(-400, 400)] + [random.Random(1).uniform(-100, 100) for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(L.floor_div(F.col("x"), 0.05)).collect()]
    assert got == [int(v // 0.05) for v in x] and any(v // 0.05 != math.floor(v / 0.05) for v in x)


def test_every_point_inside_has_one_cell_and_rings_nest(spark):
    p = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(240_000)) - 120_000).alias("x"), (F.pmod(F.xxhash64(F.col("id") + 7), F.lit(240_000)) - 120_000).alias("y"))
    r = p.withColumn("ring", L.ring_of_mm(F.col("x"), F.col("y"), S))
    m = F.greatest(F.abs("x"), F.abs("y"))
    assert r.filter((m < 100_000) != F.col("ring").isNotNull()).count() == 0
    fine, coarse = L.index(F.col("x"), F.lit(0), S), L.index(F.col("x"), F.lit(3), S)
    assert r.filter(F.floor(fine / 8) != coarse).count() == 0


def test_annulus_is_a_bijection(spark):
    c = spark.range(400 * 400).select((F.col("id") % 400).alias("ix"), F.floor(F.col("id") / 400).alias("iy"))
    a = c.select(L.annulus_index(F.col("ix"), F.col("iy"), F.lit(400), F.lit(100)).alias("p")).filter("p >= 0")
    assert tuple(a.agg(F.count("*"), F.count_distinct("p"), F.max("p")).first()) == (150_000, 150_000, 149_999)


def test_migration_has_hysteresis(spark):
    x = [(9.0, 0), (10.5, 0), (11.5, 0), (10.5, 1), (9.9, 1), (200.0, 3), (5.0, -1)]
    got = [r[0] for r in spark.createDataFrame(x, "x double, c int").select(L.migrate_ring(F.col("x"), F.lit(0.0), F.col("c"), S)).collect()]
    assert got == [0, 0, 1, 1, 0, -1, 0]


# scatter and fold ----------------------------------------------------------------------------------------------------

def points(spark, rows):
    return spark.createDataFrame(rows, "frame int, point_id bigint, xv_mm bigint, yv_mm bigint, xw_mm bigint, yw_mm bigint, z_cm bigint, cls int, g int, refl bigint, raw_label int")


def test_scatter_by_hand(spark):
    rows = [(0, 5, 1010, 10, 1010, 10, 10, 9, 1, 7, 40), (0, 3, 1020, 20, 1020, 20, 13, 8, 1, 9, 40), (0, 4, 1030, 30, 1030, 30, 90, 12, 0, 50, 50), (0, 9, 150_000, 0, 150_000, 0, 1, 8, 1, 1, 40)]
    c = scatter.scatter(scatter.bin_points(points(spark, rows), S)).collect()
    assert len(c) == 1
    c = c[0]
    assert (c.ring, c.ix, c.iy, c.n, c.refl_sum, c.ceiling_cm, c.cls) == (0, 20, 0, 3, 66, 90, 8)
    w = [max(1, round(1024 / ((((1.73 / r) ** 2) * 0.0004 + r * r * math.radians(0.1) ** 2) * 1e4))) for r in (math.sqrt(1010**2 + 100 + 100 * 100) / 1000, math.sqrt(1020**2 + 400 + 169 * 100) / 1000)]
    assert c.w_sum == sum(w) and c.wz_sum == 10 * w[0] + 13 * w[1]


def test_mean_height_rounds_halves_away(spark):
    cases = [(5, 10), (-5, 10), (15, 10), (-15, 10), (0, 3), (7, 0), (-14, 10)]
    got = [r[0] for r in spark.createDataFrame(cases, "a bigint, b bigint").select(scatter.mean_height_cm(F.col("a"), F.col("b"))).collect()]
    assert got == [1, -1, 2, -2, 0, 0, -1]


def cell_rows(spark, rows):
    return spark.createDataFrame(rows, "ring int, ix bigint, iy bigint, frame int, wz_sum bigint, w_sum bigint, n bigint, refl_sum bigint, ceiling_cm bigint, cls int")


def test_majority_vote_survives_a_minority(spark):
    rows = [(0, 1, 1, f, 0, 0, 1, 10, 32767, 8 if f < 9 else 0) for f in range(17)]
    s = fold.fold(cell_rows(spark, rows)).first()
    assert (s.cand, s.cnt) == (0, 1) or (s.cand, s.cnt) == (8, 1)
    cand = cnt = 0
    for r in rows:
        cand, cnt = (r[9], 1) if cnt == 0 else (cand, min(7, cnt + 1)) if cand == r[9] else (cand, cnt - 1)
    assert (s.cand, s.cnt) == (cand, cnt)


def code_of(v):
    return max(0, min(255, math.floor(255 * math.log(C.VAR_MAX_CM2 / max(v, 1e-12)) / C.LOG_RANGE)))


def test_height_filter_equals_its_equations(spark):
    r = random.Random(4)
    rows = [(0, 1, 1, f, r.randrange(-500, 3000), 0 if f % 5 == 3 else r.randrange(1, 400), r.randrange(1, 9), r.randrange(900), r.choice([32767, 150]), 8) for f in range(25)]
    s = fold.fold(cell_rows(spark, rows).repartition(3)).first()
    mu, code, n = 0, 0, 0
    for row in rows:
        wz, w = row[4], row[5]
        prior = C.VARIANCE[code] + 0.1
        z = int(math.copysign((2 * abs(wz) + w) // (2 * w), wz)) if w else 0
        meas = 1024 / max(w, 1)
        gain = prior / (prior + meas)
        if w and n == 0:
            mu, var = z, meas
        elif w:
            mu, var = round(mu + gain * (z - mu)), (1 - gain) * prior
        else:
            var = prior
        code, n = code_of(var), min(255, n + row[6])
    assert (s.mu, s.code, s.n, s.ceil, s.odds) == (mu, code, n, 150, 63)


def test_codec_keeps_codes(spark):
    got = spark.range(256).select(sensor.quantise_variance(sensor.variance_cm2(F.col("id").cast("int"))).alias("c"), "id").collect()
    assert all(r.c == r.id for r in got)


def test_map_is_independent_of_order(spark):
    from terrafold.plans.registry import QUERIES
    from terrafold.sources.points import points as view

    sf = "/root/testdata/sf0.001"
    one = {tuple(r) for r in QUERIES["agg22_map_hash"](spark, sf).collect()}
    p = view(spark, sf).orderBy(F.xxhash64("point_id")).repartition(7)
    s = fold.fold(scatter.scatter(scatter.bin_points(p, S)))
    text = F.concat_ws(",", *(F.col(c).cast("string") for c in ("ring", "ix", "iy", "last_frame", *fold.FIELDS)))
    word = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
    two = {tuple(r) for r in s.groupBy("ring").agg(F.count("*"), F.sum("mu"), F.sum("n"), F.bit_xor(word)).collect()}
    assert one == two


def test_occupancy_has_three_states(spark):
    rows = [(0, 10, 0), (3, 10, 0), (3, 0, 0), (3, -4, 0), (3, 10, 4)]
    got = [r[0] for r in spark.createDataFrame(rows, "n int, o int, f int").select(fold.occupancy(F.col("n"), F.col("o"), F.col("f"))).collect()]
    assert got == [0, 2, 1, 1, 0]


# image ---------------------------------------------------------------------------------------------------------------

def test_nearest_return_wins_and_ties_go_to_the_first(spark):
    rows = [(0, 7, 5.0, 0.0, 0.0), (0, 3, 5.0, 0.0, 0.0), (0, 1, 9.0, 0.0, 0.0), (0, 2, 0.0, 0.0, 0.0), (0, 8, 1.0, 0.0, 5.0)]
    p = spark.createDataFrame(rows, "frame int, point_id bigint, x double, y double, z double")
    got = {(r.u, r.v): (r.point_id, r.r) for r in image.project(p, ["x"]).collect()}
    assert got[(256, 4)] == (3, 5.0) and len(got) == 2
    s = image.projection_stats(p).first()
    assert (s.n_input, s.n_zero_range, s.n_clamped_above, s.n_filled) == (5, 1, 1, 2)


def test_cells_seen_through_are_cleared_but_touched_ones_are_kept(spark):
    img = spark.createDataFrame([(0, 4, 256, 20.0)], "frame int, v int, u int, r double")
    c = spark.createDataFrame([(0, 0, 1, 1, 10.0, 0.0, 1.73), (0, 0, 2, 1, 19.95, 0.0, 1.73), (0, 0, 3, 1, 10.0, 0.01, 1.73), (0, 0, 4, 1, 0.5, 0.0, 90.0)], "frame int, ring int, ix bigint, iy bigint, x double, y double, z double")
    touched = spark.createDataFrame([(0, 0, 3, 1)], "frame int, ring int, ix bigint, iy bigint")
    got = {r.ix: (r.through, r.protected, r.in_view) for r in image.see_through(c, img, touched).collect()}
    assert got == {1: (True, False, True), 2: (False, False, True), 3: (False, True, True), 4: (False, False, False)}
    assert image.see_through(c, img).filter("through").count() == 2  # without the guard a pole is eaten


# stencils, pyramid, split and merge -----------------------------------------------------------------------------------

def lattice(spark, z, n=5, cls=8, code=255, ceiling=32767):
    rows = [(0, i, j, int(z[i, j]), ceiling, code, n, cls, 3, 0) for i in range(z.shape[0]) for j in range(z.shape[1])]
    return spark.createDataFrame(rows, "tile bigint, ix bigint, iy bigint, ground_cm bigint, ceiling_cm bigint, code bigint, n bigint, cand int, cnt bigint, flags int")


def test_kerb_is_found_along_its_line_only(spark):
    z = np.zeros((20, 20))
    z[:, 10:] = 12
    got = {(r.ix, r.iy) for r in stencil.kerbs(lattice(spark, z), 20, 0.2).collect()}
    assert {j for _, j in got} == {9, 10} and len(got) >= 30
    z[:, 10:] = 60
    assert stencil.kerbs(lattice(spark, z), 20, 0.2).count() == 0
    lone = np.zeros((20, 20))
    lone[10, 10] = 12
    assert stencil.kerbs(lattice(spark, lone), 20, 0.2).count() == 0


def test_pothole_needs_an_even_rim(spark):
    z = np.zeros((20, 20))
    z[10, 10] = -30
    assert [(r.ix, r.iy, r.depth_cm, r.rim_pairs) for r in stencil.potholes(lattice(spark, z), 20, 0.2).collect()] == [(10, 10, 30.0, 4)]
    z[:, 11:] = 12
    assert stencil.potholes(lattice(spark, z), 20, 0.2).count() == 0
    ramp = np.add.outer(np.arange(20) * 6, np.zeros(20))
    assert stencil.potholes(lattice(spark, ramp), 20, 0.2).count() == 0


def test_bits(spark):
    flat = {(r.ix, r.iy): r.trav for r in stencil.bits(lattice(spark, np.zeros((8, 8))), 8, 0.2).collect()}
    assert flat[3, 3] == 0 and flat[0, 3] == 32 and len(flat) == 64
    z = np.zeros((8, 8))
    z[4:, :] = 40
    step = {(r.ix, r.iy): r.trav for r in stencil.bits(lattice(spark, z), 8, 0.2).collect()}
    assert step[3, 3] == 6 and step[4, 4] == 6 and step[1, 3] == 0
    assert stencil.bits(lattice(spark, np.zeros((8, 8)), n=1, cls=12, code=100, ceiling=120), 8, 0.2).filter("trav <> 57").count() == 0


def test_pyramid_never_calls_a_blocked_block_safe(spark):
    r = np.random.default_rng(3)
    cells = stencil.bits(lattice(spark, r.integers(0, 8, (17, 17))), 17, 0.2).withColumn("n", (F.col("ix") * F.col("iy") % 7))
    p = pyramid.build(cells, 5).withColumn("safe", pyramid.theorem_safe()).withColumn("lod", pyramid.classify()).cache()
    under = cells.crossJoin(spark.range(1, 6).withColumnRenamed("id", "level")).withColumn("bx", F.expr("shiftright(ix, int(level))")).withColumn("by", F.expr("shiftright(iy, int(level))"))
    j = under.join(p, ["tile", "level", "bx", "by"])
    assert j.filter("lod = 0 AND trav <> 0").count() == j.filter("lod = 1 AND trav = 0").count() == j.filter("safe AND n < 3").count() == 0
    assert p.filter("level = 5").count() == 1


def test_split_and_merge_round_trip(spark):
    c = lattice(spark, np.arange(16).reshape(4, 4))
    kids = pyramid.split(c, 0.20, 0.10, F.lit(0.0))
    back = {(r.ix, r.iy): r for r in pyramid.merge(kids, ["ix", "iy"]).collect()}
    assert kids.count() == 64 and all(abs(back[i, j].mu_m - (4 * i + j) / 100) < 1e-12 and back[i, j].n == 5 and back[i, j].flags == 1 for i in range(4) for j in range(4))
    two = spark.createDataFrame([(0, 1.0, 0.0, 1, 1), (0, 3.0, 0.0, 3, 9)], "k int, mu_m double, sigma2_m2 double, n bigint, flags int")
    m = pyramid.merge(two, ["k"]).first()
    assert (m.mu_m, round(m.sigma2_m2, 12), m.n, m.flags) == (2.5, 0.75, 1, 9)
    with pytest.raises(ValueError):
        pyramid.split(c, 0.10, 0.20, F.lit(0.0))


# sequential state, planning, query ------------------------------------------------------------------------------------

def relaxed(c, s, cell=0.25):
    """Least costs by Dijkstra's method."""
    import heapq

    d, todo = np.full(c.shape, np.inf), [(0.0, s)]
    while todo and math.isfinite(c[s]):
        at, p = heapq.heappop(todo)
        if at < d[p]:
            d[p] = at
            for dx, dy, size in plan.STEPS:
                q = (p[0] + dx, p[1] + dy)
                if 0 <= q[0] < c.shape[0] and 0 <= q[1] < c.shape[1] and math.isfinite(c[q]) and at + c[q] * size * cell < d[q]:
                    heapq.heappush(todo, (at + c[q] * size * cell, q))
    return d


def test_paths_are_the_cheapest(spark):
    r = np.random.default_rng(8)
    for _ in range(5):
        c = r.choice([1.0, 3.0, 8.0, np.inf], (9, 9), p=[0.5, 0.2, 0.1, 0.2])
        c[0, 0] = c[8, 8] = 1.0
        want = relaxed(c, (0, 0))
        assert np.allclose(plan.distances(c, (0, 0), 0.25), want)
        back = plan.distances(c, (8, 8), 0.25, into=True)
        assert back[0, 0] == pytest.approx(want[8, 8])
        for p in ((3, 4), (7, 1)):
            assert back[p] == pytest.approx(relaxed(c, p)[8, 8]) if math.isfinite(c[p]) else math.isinf(back[p])
        df = spark.createDataFrame([(0, i, j, None if math.isinf(c[i, j]) else float(c[i, j])) for i in range(9) for j in range(9)], "tile int, ix int, iy int, cost double")
        p = plan.plan(df, (0, 0), (8, 8))
        row = p.first()
        assert row.found == math.isfinite(want[8, 8])
        if row.found:
            assert plan.path_cost(p.select("tile", "path"), df).first().path_cost == pytest.approx(want[8, 8]) and plan.regret(df, df, (0, 0), (8, 8)).first().regret == pytest.approx(0)
            assert plan.corridor(df, (0, 0), (8, 8), 1e-6).count() >= row.steps + 1


def test_frechet():
    a = np.array([[0, 0], [1, 0], [2, 0]], float)
    assert plan.frechet(a, a) == 0 and plan.frechet(a, a + [0, 3]) == 3 and math.isnan(plan.frechet(a, a[:0]))


def test_query_outside_transient_and_refined(spark):
    key = "ring int, ix bigint, iy bigint"
    state = spark.createDataFrame([(1, 100, 0, 7, 200, 32767, 4, 8, 3, 0, 2)], key + ", mu int, code int, ceil int, odds int, cand int, cnt int, refl int, n int")
    probes = spark.createDataFrame([(1, 10_050, 10, 0, 0), (2, 500_000, 0, 0, 0), (3, 50, 50, 0, 0)], "query_id bigint, x_mm bigint, y_mm bigint, ego_x_mm bigint, ego_y_mm bigint")
    got = {r.query_id: r for r in query.lookup(probes, state, S).collect()}
    assert (got[1].ground_cm, got[1].ceiling_cm, got[1].occupancy, got[1].confidence) == (7, None, 2, 2)
    assert got[2].ring is None and got[2].occupancy == got[3].occupancy == 0 and got[3].ground_cm is None
    t = spark.createDataFrame([(1, 100, 0, 99)], key + ", top_cm bigint")
    assert query.lookup(probes, state, S, t).filter("dynamic").first().ground_cm == 99
    fine = spark.createDataFrame([(1, 100, 0, 1, 55)], key + ", child int, mu int")
    assert query.lookup(probes, state, S, None, fine).filter("query_id = 1").first().ground_cm == 55
