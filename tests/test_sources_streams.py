"""Scan files round trip, and streams give the state that the batch fold gives."""

import numpy as np
from pyspark.sql import functions as F

from terrafold import config as C
from terrafold.operators import fold, scatter
from terrafold.sources import scans
from terrafold.sources.points import points
from terrafold.streaming import replay

S = C.load("5_10_20_40")
SF = "/root/testdata/sf0.001"


def test_sequence_round_trip(spark, tmp_path):
    r = np.random.default_rng(1)
    frames = [(r.normal(size=(n, 4)).astype("f4"), r.integers(0, 1 << 20, n)) for n in (5, 1, 7)]
    pose = np.tile(np.eye(3, 4), (3, 1, 1))
    pose[:, 0, 3] = [0, 1.5, 3]
    scans.write_sequence(str(tmp_path), "04", frames, pose, np.eye(3, 4))
    base = f"{tmp_path}/sequences/04"
    p = scans.scans(spark, f"{base}/velodyne").orderBy("frame", "point_id").toPandas()
    assert len(p) == 13 and np.array_equal(p[p.frame == 2][["x", "y", "z", "intensity"]].to_numpy(), frames[2][0])
    lab = scans.labelled(scans.scans(spark, f"{base}/velodyne"), scans.labels(spark, f"{base}/labels", start=2)).orderBy("frame", "point_id").toPandas()
    assert lab[lab.frame == 0].raw_label.eq(0).all() and lab[lab.frame == 2].raw_label.tolist() == frames[2][1].tolist()
    assert scans.scans(spark, f"{base}/velodyne", start=1, most=1).count() == 1 and scans.scans(spark, f"{base}/velodyne", most=1).count() == 5
    got = scans.poses(spark, scans.pose_path(str(tmp_path), "04")).orderBy("frame").collect()
    assert [(x.frame, x.m[3]) for x in got] == [(0, 0), (1, 1.5), (2, 3)] and scans.pose_path("r", "08").endswith("sequences/08/poses.txt")
    assert scans.calibration(spark, f"{base}/calib.txt") == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]


def test_replay_equals_batch(spark, tmp_path):
    cells = scatter.scatter(scatter.bin_points(points(spark, SF), S)).cache()
    for f in range(7):
        cells.filter(F.col("frame") == f).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = replay.replay(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    cols = ["ring", "ix", "iy", "last_frame", *fold.FIELDS]
    got, want = spark.read.parquet(last).select(*cols), fold.fold(cells).select(*cols)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_state_store_equals_batch(spark, tmp_path):
    cells = scatter.scatter(scatter.bin_points(points(spark, SF), S)).filter("ring = 3").cache()
    for f in range(3):
        cells.filter(F.col("frame") == f).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = replay.stateful(stream).writeStream.outputMode("update").format("memory").queryName("votes").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("votes").groupBy("ring", "ix", "iy").agg(F.max_by(F.struct(*fold.FIELDS), "frame").alias("s")).select("ring", "ix", "iy", "s.*")
    want = fold.fold(cells.filter("frame < 3")).select("ring", "ix", "iy", *fold.FIELDS)
    assert last.exceptAll(want).count() == want.exceptAll(last).count() == 0


def test_sweep_hits_the_ground_along_its_beams(spark):
    from terrafold.sources import synthetic

    p = synthetic.sweep(spark, 0, beams=16, azimuths=90).toPandas()
    horizontal = np.hypot(p.x, p.y)
    phi = np.degrees(np.arctan2(p.z - C.THRESHOLDS["sensor_height_m"], horizontal))
    step = 26.8 / 15
    off = np.abs((phi + 24.8) / step - np.rint((phi + 24.8) / step))
    assert len(p) > 500 and horizontal.max() <= 100 and off.max() < 1e-3
    assert set(p.raw_label) == {40, 44, 48} and (p[abs(p.y) <= 3].raw_label == 40).all()


def test_session_and_exports(spark, tmp_path):
    from terrafold import api

    s = api.MapSession.build(points(spark, SF), ego_mm=(2400, 0))
    cell = s.state.filter("ring = 3").first()
    x, y = (cell.ix + 0.5) * 0.4, (cell.iy + 0.5) * 0.4
    got = s.query(x, y)
    assert got.ring == 3 and got.confidence == cell.n or got.ring != 3
    assert s.query(1000.0, 0.0).occupancy == 0 and s.occupied().count() == s.state.filter("odds > 0").count()
    s.save(str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "state")).filter("ring = 0").count() == s.state.filter("ring = 0").count()
    api.csv(s.state.limit(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3 and api.text_table([{"a": 1, "b": 2.0}]).split() == ["a", "b", "1", "2.000"]


def test_scene_on_disk_is_mapped(spark, tmp_path, capsys):
    """A sequence of the scene, written and mapped by the command line: the road comes out where the scene has it."""
    from terrafold import __main__ as cli
    from terrafold.sources import synthetic

    synthetic.write_scene(spark, str(tmp_path), "04", 2, beams=24, azimuths=180, crowd=5)
    p = scans.points(spark, str(tmp_path), "04").toPandas()
    ground = p[p.raw_label.isin([40, 44, 48])]
    want = spark.createDataFrame(ground[["xw_mm", "yw_mm"]]).select(synthetic.height(F.col("xw_mm") / 1000, F.col("yw_mm") / 1000).alias("z")).toPandas().z
    off = np.abs(ground.z_cm.to_numpy() / 100 - want.to_numpy())
    assert np.quantile(off, 0.97) < 0.02 and set(p.raw_label) >= {40, 44, 50, 70, 80, 81, 252, 254}
    cli.main([str(tmp_path), "04"])
    assert len(capsys.readouterr().out.split("\n")) > 3
