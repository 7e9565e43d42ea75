"""Scan sequences on disk: binary points and labels, poses, calibration, points in the world (SRC1-7, SRC11, SRC14, TX3)."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.config import CLASS_OF, THRESHOLDS
from terrafold.functions import frames

POINTS = "frame int, point_id int, x float, y float, z float, intensity float"
LABELS = "frame int, point_id int, raw_label bigint"
#: Sequences whose poses come from the estimate rather than the ground truth; the environment variable that decides for all.
ESTIMATED, SOURCE_VARIABLE = {"00", "08"}, "TERRAFOLD_POSES"
#: Raw classes that count as ground where no segmentation tells.
GROUND = (40, 44, 48, 49, 60, 72)


def _frame() -> Column:
    return F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("int").alias("frame")


def _files(spark: SparkSession, folder: str, glob: str, start: int, most: int | None) -> DataFrame:
    """Frames from a start on; the file listing is filtered before any content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    files = files.select(_frame(), "content").filter(F.col("frame") >= start)
    if most is not None:
        names = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(_frame()).filter(F.col("frame") >= start)
        files = files.join(F.broadcast(names.orderBy("frame").limit(most)), "frame", "left_semi")
    return files


def scans(spark: SparkSession, folder: str, start: int = 0, most: int | None = None) -> DataFrame:
    """Points of float32 records x, y, z, intensity; the ordinal is the point's id. A file without bytes is no frame."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frame, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(raw.as_buffer(), "<f4").reshape(-1, 4)
                cols = [pa.array(np.full(len(v), frame, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), *(pa.array(np.ascontiguousarray(v[:, i])) for i in range(4))]
                yield pa.RecordBatch.from_arrays(cols, ["frame", "point_id", "x", "y", "z", "intensity"])

    return _files(spark, folder, "*.bin", start, most).mapInArrow(decode, POINTS)


def labels(spark: SparkSession, folder: str, start: int = 0, most: int | None = None) -> DataFrame:
    """Labels of uint32 records; the low 16 bits are the class, the high ones the instance."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frame, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), frame, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["frame", "point_id", "raw_label"])

    return _files(spark, folder, "*.label", start, most).mapInArrow(decode, LABELS)


def poses(spark: SparkSession, path: str) -> DataFrame:
    """Twelve numbers a line, row-major; the line's place in the file is the frame."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("frame", "line"))
    m = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    return lines.filter(F.trim("line") != "").select("frame", m.alias("m"))


def calibration(spark: SparkSession, path: str) -> list[float]:
    """The twelve numbers of the line ``Tr:``; an error if there is none."""
    found = spark.read.text(path).filter(F.col("value").startswith("Tr:")).select(F.split(F.trim(F.substring("value", 4, 1 << 20)), r"\s+")).first()
    if found is None:
        raise ValueError(f"{path} has no Tr: line")
    return [float(x) for x in found[0]]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def pose_source(seq: str) -> str:
    """"slam" or "gt": what the environment says, else the source of the sequence (SRC4)."""
    forced = os.environ.get(SOURCE_VARIABLE)
    if forced and forced not in ("gt", "slam"):
        raise ValueError(f"{SOURCE_VARIABLE} must be gt or slam, not {forced!r}")
    return forced or ("slam" if seq in ESTIMATED else "gt")


def pose_path(root: str, seq: str, source: str | None = None, spark: SparkSession | None = None) -> str:
    """Where a sequence's poses are (SRC4): with a session, the ground truth stands in for an estimate that isn't there."""
    estimate, truth = f"{root}/sequences/{seq}/poses.txt", f"{root}/poses/{seq}.txt"
    if (source or pose_source(seq)) == "gt":
        return truth
    if spark is not None and not _exists(spark, estimate):
        warnings.warn(f"{estimate} is missing; the poses of {truth} stand in", RuntimeWarning, stacklevel=2)
        return truth
    return estimate


def frame_count(spark: SparkSession, root: str, seq: str, source: str | None = None) -> int:
    """Frames of a sequence by its poses (SRC7)."""
    return poses(spark, pose_path(root, seq, source, spark)).count()


def sequence_exists(spark: SparkSession, root: str, seq: str) -> bool:
    """Whether a sequence has ground-truth poses and scans (SRC7)."""
    return _exists(spark, f"{root}/poses/{seq}.txt") and _exists(spark, f"{root}/sequences/{seq}/velodyne")


def labelled(points: DataFrame, label: DataFrame) -> DataFrame:
    """Points with their labels, 0 where there is none (SRC6)."""
    return points.join(label, ["frame", "point_id"], "left").withColumn("raw_label", F.coalesce("raw_label", F.lit(0).cast("bigint")))


def world_poses(spark: SparkSession, root: str, seq: str, source: str | None = None) -> DataFrame:
    """frame and t_vw, the twelve numbers from the vehicle to the world (TX3); one row a frame."""
    tr = calibration(spark, f"{root}/sequences/{seq}/calib.txt")
    return poses(spark, pose_path(root, seq, source, spark)).select("frame", frames.vehicle_to_world(F.col("m"), tr).alias("t_vw"))


def final_xy(spark: SparkSession, root: str, seq: str, most: int | None = None) -> tuple[float, float]:
    """Where the vehicle is in the world in the last frame, or in the last of the first ``most`` (EXT17)."""
    p = world_poses(spark, root, seq)
    p = p if most is None else p.filter(F.col("frame") < most)
    t = p.agg(F.max_by("t_vw", "frame")).first()[0]
    return t[3], t[7]


def status(spark: SparkSession, root: str) -> DataFrame:
    """Scans, labels and poses that each sequence below a root has (EXT21), from the file listing alone but for the poses."""
    listed = lambda of, glob, kind: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(of).select(F.regexp_extract("path", kind, 1).alias("seq"))
    count = lambda df, name: df.groupBy("seq").agg(F.count("*").alias(name))
    lines = spark.read.text(f"{root}/poses").filter(F.trim("value") != "").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("seq"))
    out = count(listed(f"{root}/sequences/*/velodyne", "*.bin", r"sequences/([^/]+)/velodyne"), "scans")
    out = out.join(count(listed(f"{root}/sequences/*/labels", "*.label", r"sequences/([^/]+)/labels"), "labels"), "seq", "full").join(count(lines, "poses"), "seq", "full")
    return out.na.fill(0)


def points(spark: SparkSession, root: str, seq: str, start: int = 0, most: int | None = None, source: str | None = None) -> DataFrame:
    """Points of a sequence as the operators take them (SRC11): vehicle and world in whole millimetres, height in centimetres.

    Heights are those of the world over the datum, the ground below the vehicle in the first frame that is read. A scan
    without a pose is an error. The poses, a row a frame, are joined to the scans by broadcast.
    """
    base = f"{root}/sequences/{seq}"
    raw = labelled(scans(spark, f"{base}/velodyne", start, most), labels(spark, f"{base}/labels", start))
    pose = world_poses(spark, root, seq, source)
    datum = pose.filter(F.col("frame") >= start).agg(F.min_by(F.get("t_vw", 11), "frame")).first()[0] or 0.0
    p = raw.join(F.broadcast(pose), "frame", "left")
    t = F.when(F.col("t_vw").isNotNull(), F.col("t_vw")).otherwise(F.raise_error(F.concat(F.lit("no pose for frame "), F.col("frame"))).cast("array<double>"))
    x, y, z = F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double") + THRESHOLDS["sensor_height_m"]
    p = p.withColumn("t_vw", t)
    xw, yw, zw = frames.apply(F.col("t_vw"), x, y, z)
    mm = lambda c: F.rint(c * 1000).cast("bigint")
    cls, classes = F.col("raw_label").bitwiseAND(65535).cast("int"), F.create_map(*(F.lit(v) for k, c in CLASS_OF.items() for v in (k, c if c >= 0 else THRESHOLDS["unlabelled"])))
    return p.select(
        "frame", F.col("point_id").cast("bigint").alias("point_id"), mm(x).alias("xv_mm"), mm(y).alias("yv_mm"), mm(xw).alias("xw_mm"), mm(yw).alias("yw_mm"),
        F.rint((zw - datum) * 100).cast("bigint").alias("z_cm"), F.coalesce(F.try_element_at(classes, cls), F.lit(THRESHOLDS["unlabelled"])).alias("cls"),
        cls.isin(*GROUND).cast("int").alias("g"), F.rint(F.col("intensity") * 255).cast("bigint").alias("refl"), cls.alias("raw_label"),
    )


def write_sequence(root: str, seq: str, frames: list[tuple[np.ndarray, np.ndarray]], pose: np.ndarray, tr: np.ndarray) -> None:
    """Test fixtures in the same layout, written by the driver (SRC14): frames of (N x 4 points, N labels), poses F x 12."""
    import os

    base = f"{root}/sequences/{seq}"
    for d in ("velodyne", "labels"):
        os.makedirs(f"{base}/{d}", exist_ok=True)
    os.makedirs(f"{root}/poses", exist_ok=True)
    for i, (p, lab) in enumerate(frames):
        p.astype("<f4").tofile(f"{base}/velodyne/{i:06d}.bin")
        lab.astype("<u4").tofile(f"{base}/labels/{i:06d}.label")
    for path in (f"{root}/poses/{seq}.txt", f"{base}/poses.txt"):
        np.savetxt(path, pose.reshape(len(pose), 12))
    with open(f"{base}/calib.txt", "w") as f:
        f.write("Tr: " + " ".join(map(repr, map(float, tr.reshape(-1)))) + "\n")
