"""Checks, saved references, the stepped fold and the frame loop."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold import config as C
from terrafold.functions import sensor
from terrafold.operators import evalmap, fold, image, scatter
from terrafold.sources import scans
from terrafold.sources.points import points

SF = "/root/testdata/sf0.001"
S = C.load("5_10_20_40")


def test_codes_like_the_column(spark):
    r = random.Random(2)
    v = [0.0, 1e-13, 1 / 12, 640000.0, 1e7, *C.VARIANCE, *(x * (1 + 1e-12) for x in C.VARIANCE), *(10 ** r.uniform(-3, 7) for _ in range(2000))]
    got = spark.createDataFrame([(x,) for x in v], "v double").select("v", sensor.quantise_variance(F.col("v")).alias("c")).collect()
    assert all(fold.code_of(x.v) == x.c for x in got)


def test_stepped_is_the_fold(spark):
    cells = scatter.scatter(scatter.bin_points(points(spark, SF), S))
    rows = cells.select("ring", "ix", "iy", fold.observation().alias("x")).select("ring", "ix", "iy", "x.*").collect()
    state = {}
    for r in sorted(rows, key=lambda r: r.frame):
        k = (r.ring, r.ix, r.iy)
        state[k] = fold.stepped(state.get(k, fold.EMPTY_STATE), r.z, r.w_sum, r["count"], r.refl_sum, r.ceiling_cm, r.cls)
    assert {(r.ring, r.ix, r.iy): tuple(r[f] for f in fold.FIELDS) for r in fold.fold(cells).collect()} == state


def test_a_filter_on_the_state_doesnt_fold_again(spark):
    s = fold.fold(scatter.scatter(scatter.bin_points(points(spark, SF), S))).filter("n > 0 AND code > 0 AND odds > 0")
    assert s._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_classes_that_cant_be_stored(spark):
    p = spark.createDataFrame([(0, 5), (1, 31)], "point_id int, cls int")
    assert scatter.validated(p).collect() == p.collect()
    for bad in (32, -1, None):
        with pytest.raises(Exception, match="can't be stored"):
            scatter.validated(spark.createDataFrame([(0, bad)], "point_id int, cls int")).collect()
    assert C.class_ids(["road"]) == [8] and C.unstorable(["road", "car"]) == [] and C.unstorable(["road"], most=5) == ["road"]


def test_axes_are_checked_at_two_frames(spark):
    rows = [(f, 3.0 * f, 1, 1000 if f == 4 else 0) for f in range(8) for _ in range(5)]
    df = spark.createDataFrame(rows, "frame int, x_m double, g int, z_cm int")
    got = evalmap.guard(df)
    assert sorted((r.frame, r.ground_cm, r.upright) for r in got.collect()) == [(0, 0.0, True), (4, 1000.0, False)]
    with pytest.raises(ValueError, match="frame 4"):
        evalmap.assert_upright(got)
    evalmap.assert_upright(evalmap.guard(df.filter("frame < 4")))


def test_reference_map_is_saved_by_tile(spark, tmp_path):
    ref = evalmap.reference(points(spark, SF))
    evalmap.save_reference(ref, str(tmp_path / "ref"), tile=512)
    whole, part = evalmap.load_reference(spark, str(tmp_path / "ref")), evalmap.load_reference(spark, str(tmp_path / "ref"), -100, 700, tile=512)
    assert whole.select(*ref.columns).exceptAll(ref).count() == 0 and whole.count() == ref.count()
    assert part.select(*ref.columns).exceptAll(ref.filter("i >= -100 AND i < 700")).count() == 0 and part.count() == ref.filter("i >= -100 AND i < 700").count()


def test_frames_out_of_view_are_warned_of(spark):
    stats = spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.9)], "frame int, out_of_fov double")
    with pytest.warns(UserWarning, match="2 frames"):
        assert image.warn_out_of_view(stats) == [1, 2]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert image.warn_out_of_view(stats.filter("frame = 0")) == []


def test_what_a_root_holds(spark, tmp_path):
    frames = [(np.zeros((3, 4), "f4"), np.zeros(3, int))] * 2
    pose = np.tile(np.eye(3, 4), (2, 1, 1))
    pose[1, 0, 3], pose[1, 2, 3] = 0.5, 7.0
    scans.write_sequence(str(tmp_path), "04", frames, pose, np.eye(3, 4))
    scans.write_sequence(str(tmp_path), "05", frames[:1], pose, np.eye(3, 4))
    got = {r.seq: (r.scans, r.labels, r.poses) for r in scans.status(spark, str(tmp_path)).collect()}
    assert got == {"04": (2, 2, 2), "05": (1, 1, 2)}
    assert scans.final_xy(spark, str(tmp_path), "04") == pytest.approx((7.0 - 1.73, -0.5)) and scans.final_xy(spark, str(tmp_path), "04", most=1) == pytest.approx((-1.73, 0.0))


def test_readers_of_the_configuration():
    assert C.available() == ["5_10_20_40", "5_10_50"]
    assert C.legend(S).split("\n")[0] == "| ring | half width m | cell cm | cells |" and "| 3 | 100 | 40 | 187500 |" in C.legend(S)
    w = C.class_weights(["person", "pole"], 4.0)
    assert w[5] == w[17] == 4.0 and w[19] == 0.0 and w[0] == 1.0 and len(w) == 20
    with pytest.raises(ValueError):
        C.class_weights(["unicorn"], 2.0)


def test_frame_loop_like_the_plain_version(spark, tmp_path):
    """Fold, then look through the cells that are occupied, frame by frame; the plain version keeps a dictionary."""
    from terrafold.streaming import drive

    p = points(spark, SF).filter("frame < 4").withColumns({"x": F.col("xv_mm") / 1000.0, "y": F.col("yv_mm") / 1000.0, "z": F.col("z_cm") / 1000.0 - 1.73})
    rides = {f: (400 * f, 0) for f in range(4)}
    state, counters = drive.drive(spark, p, S, rides, str(tmp_path / "map"))
    got = {(r.ring, r.ix, r.iy): tuple(r[f] for f in fold.FIELDS) for r in state.collect()}

    b = scatter.bin_points(p, S)
    seen = scatter.scatter(b).select("frame", "ring", "ix", "iy", fold.observation().alias("x")).select("ring", "ix", "iy", "x.*").collect()
    px = {(r.frame, r.v, r.u): r.r for r in image.project(p, ["x"]).collect()}
    want, cleared = {}, {}
    for f in range(4):
        touched = set()
        for r in (r for r in seen if r.frame == f):
            k = (r.ring, r.ix, r.iy)
            touched.add(k)
            want[k] = fold.stepped(want.get(k, fold.EMPTY_STATE), r.z, r.w_sum, r["count"], r.refl_sum, r.ceiling_cm, r.cls)
        cells = [(k, s) for k, s in want.items() if s[7] >= 1 and s[3] > 0]
        at = [((k[1] + 0.5) * 0.05 * 2 ** k[0] - 0.4 * f, (k[2] + 0.5) * 0.05 * 2 ** k[0], (s[2] if s[2] < 32767 else s[0]) / 100.0) for k, s in cells]
        df = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(at)], "i int, x double, y double, z double").withColumn("zs", F.col("z") - 1.73)
        u, v, r = sensor.pixel(F.col("x"), F.col("y"), F.col("zs"))
        n = 0
        for c in df.select("i", u.alias("u"), v.alias("v"), r.alias("r"), sensor.clear_tolerance_m(r).alias("tol")).collect():
            k, s = cells[c.i]
            far = c.v is not None and 0 <= c.v < 64 and px.get((f, c.v, c.u), -1) > c.r + c.tol
            if far and k not in touched:
                want[k] = (*s[:3], max(s[3] - 2, -64), *s[4:])
                n += 1
        cleared[f] = (len(cells), n)
    assert got == want
    assert {c["frame"]: (c["occupied"], c["cleared"]) for c in counters} == cleared and sum(n for _, n in cleared.values()) > 0


def test_compared_schedules(spark):
    from terrafold.plans.registry import QUERIES

    p = points(spark, SF)
    e = evalmap.compare(p, [S, C.uniform(0.2)]).collect()
    want = {r.ring: r for r in QUERIES["agg15_scores"](spark, SF).collect()}
    mine = {r.ring: r for r in e if r.schedule == S.name}
    assert mine.keys() == want.keys() and all(mine[r].cells == want[r].cells and mine[r].rmse_cm == pytest.approx(want[r].rmse_cm, abs=1e-4) for r in want)
    # a uniform map by hand: cells of 20 cm over all frames, against the mean of the 5 cm cells in them
    one = [r for r in e if r.schedule != S.name]
    state = {(r.ix, r.iy): r for r in fold.fold(scatter.scatter(scatter.bin_points(p, C.uniform(0.2)))).collect()}
    fine = {}
    for r in evalmap.reference(p).collect():
        fine.setdefault((r.i // 4, r.j // 4), []).append(r.sz / r.n)
    err = [s.mu - np.mean(fine[k]) for k, s in state.items() if s.n > 0 and s.code > 0 and -200 < s.mu < 600]
    assert len(one) == 1 and one[0].cells == len(err) and one[0].rmse_cm == pytest.approx(np.sqrt(np.mean(np.square(err))))
    rows = {r.schedule: r for r in QUERIES["qry17_compare"](spark, SF).collect()}
    assert rows[S.name].mb == 8.94 and rows[S.name].worst_rmse_cm == pytest.approx(max(r.rmse_cm for r in want.values()), abs=1e-4) and len(rows) == 3
