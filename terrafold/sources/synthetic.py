"""An analytic scene, sweeps over it and solids in it, as expressions (SRC12, SRC13, EXT12)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.config import THRESHOLDS as T

# Fixed values of the scene: kerb line and height, ramp, pothole, verge grain; raw labels of road, sidewalk, parking.
KERB_Y, KERB_H, RAMP_X, RAMP, HOLE_X, HOLE_R, HOLE_D, GRAIN = 3.0, 0.12, 30.0, 0.06, 18.0, 0.30, 0.40, 0.02
ROAD, SIDEWALK, PARKING = 40, 48, 44
# Fixed values of the solids: raw label, returns, ranges of x, y and z in metres, whether y is on either side.
SOLIDS = [
    (50, 6000, (6.0, 45.0), (7.0, 7.0), (0.0, 3.0), True),
    (80, 900, (12.5, 13.5), (4.4, 4.6), (0.2, 2.5), False),
    (81, 400, (12.4, 13.6), (4.2, 4.8), (2.2, 2.9), False),
    (70, 1200, (20.0, 44.0), (5.0, 6.0), (1.5, 3.4), True),
]
# Fixed values of a crowd and of a car that pulls away: raw label, returns each, ranges or half sizes.
PERSON, PER_PERSON, CROWD_X, CROWD_Y, PERSON_HALF, PERSON_TOP = 254, 24, (4.0, 34.0), (-8.0, 8.0), 0.25, 1.8
CAR, CAR_RETURNS, CAR_X, CAR_STEP, CAR_HALF, CAR_TOP = 252, 400, 12.0, 0.5, (2.0, 1.0), 1.5
#: Multipliers of the streams of evenly spread numbers.
STREAMS = [2654435761, 2246822519, 3266489917, 668265263, 374761393, 1640531527, 97531]


def height(x: Column, y: Column, seed: int = 0) -> Column:
    """Height of the ground in metres: a crowned road between kerbs, a ramp ahead, a pothole, a rough verge."""
    w = F.abs(y)
    m = F.least(w, F.lit(KERB_Y))
    grain = F.sin(12.7 * x + seed) * F.cos(11.3 * y - seed)
    hole = F.sqrt((x - HOLE_X) * (x - HOLE_X) + y * y) < HOLE_R
    return (
        F.lit(0.0) - 0.02 * m * m / KERB_Y + F.when(w > KERB_Y, KERB_H).otherwise(0.0) + F.when(x > RAMP_X, RAMP * (x - RAMP_X)).otherwise(0.0)
        + F.when(w > KERB_Y + 1, GRAIN * grain).otherwise(0.0) - F.when(hole, HOLE_D).otherwise(0.0)
    )


def raw_class(y: Column) -> Column:
    return F.when(F.abs(y) <= KERB_Y, ROAD).when(F.abs(y) <= KERB_Y + 1, SIDEWALK).otherwise(PARKING)


def sweep(spark: SparkSession, frame: int, beams: int = 64, azimuths: int = 720, most_m: float = 100.0, halvings: int = 48) -> DataFrame:
    """Where each beam meets the ground, by halving its length; beams that miss are left out. The vehicle moves 2 m a frame."""
    step = math.radians(T["phi_max_deg"] - T["phi_min_deg"]) / (beams - 1)
    b = spark.range(beams * azimuths).select(F.lit(frame).alias("frame"), F.col("id").cast("int").alias("point_id"), (F.radians(F.lit(T["phi_min_deg"])) + F.floor(F.col("id") / azimuths) * step).alias("phi"), ((F.col("id") % azimuths) * (2 * math.pi / azimuths)).alias("theta"))
    ego = 2.0 * frame
    above = lambda r, phi, th: T["sensor_height_m"] + r * F.tan(phi) - height(r * F.cos(th) + ego, r * F.sin(th))

    def halve(s: Column, _: Column) -> Column:
        mid = 0.5 * (s["lo"] + s["hi"])
        up = above(mid, F.col("phi"), F.col("theta")) > 0
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    b = b.filter(above(F.lit(most_m), F.col("phi"), F.col("theta")) <= 0)
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(most_m).alias("hi"))
    b = b.withColumn("r", F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve, lambda s: 0.5 * (s["lo"] + s["hi"])))
    x, y = F.col("r") * F.cos("theta"), F.col("r") * F.sin("theta")
    out = b.select("frame", "point_id", x.alias("x"), y.alias("y"), height(x + ego, y).alias("z"), raw_class(y).alias("raw_label"), (T["sensor_height_m"] + F.col("r") * F.tan("phi")).alias("beam"))
    # a beam that ends on the riser of a step isn't on the ground, which has one height at each place
    return out.filter(F.abs(F.col("beam") - F.col("z")) < 1e-6).drop("beam")


def spread(i: Column, stream: int, seed: int) -> Column:
    """Numbers from 0 to 1, evenly spread over successive i and the same on every engine."""
    return F.pmod(i * STREAMS[stream] + (stream + 1) * 40503 * (seed + 1), F.lit(1 << 32)) / F.lit(float(1 << 32))


def in_view(x: Column, y: Column, z: Column) -> Column:
    """Between the lowest and the highest beam, and outside of the sensor's housing."""
    flat = F.sqrt(x * x + y * y)
    phi = F.degrees(F.atan2(z - T["sensor_height_m"], flat))
    return (phi >= T["phi_min_deg"]) & (phi <= T["phi_max_deg"]) & (flat > 1.0)


def solids(spark: SparkSession, frame: int, seed: int = 0, crowd: int = 0, car: bool = False) -> DataFrame:
    """Returns of what stands on the ground, in the vehicle frame: facades, a pole, a sign, trees; people; a moving car."""
    between = lambda i, k, r: r[0] + (r[1] - r[0]) * spread(i, k, seed)
    i, parts = F.col("id"), []
    for raw, n, x, y, z, mirrored in SOLIDS:
        side = F.when(spread(i, 3, seed) < 0.5, -1.0).otherwise(1.0) if mirrored else F.lit(1.0)
        parts.append(spark.range(n).select(F.lit(raw).alias("raw_label"), "id", between(i, 0, x).alias("x"), (side * between(i, 1, y)).alias("y"), between(i, 2, z).alias("z")))
    who = F.expr(f"id DIV {PER_PERSON}")
    around = lambda k: (2 * spread(i, k, seed) - 1) * PERSON_HALF
    parts.append(spark.range(crowd * PER_PERSON).select(F.lit(PERSON), "id", between(who, 4, CROWD_X) + around(0), between(who, 5, CROWD_Y) + around(1), PERSON_TOP * spread(i, 2, seed)))
    out = reduce(DataFrame.union, parts).filter(in_view(F.col("x"), F.col("y"), F.col("z")))
    if car:
        away = lambda k, half: (2 * spread(i, k, seed) - 1) * half
        out = out.union(spark.range(CAR_RETURNS).select(F.lit(CAR), "id", CAR_X + CAR_STEP * seed + away(0, CAR_HALF[0]), away(1, CAR_HALF[1]), CAR_TOP * spread(i, 2, seed)))
    return out.select(F.lit(frame).alias("frame"), "raw_label", F.col("id").alias("solid_id"), "x", "y", "z")


def write_scene(spark: SparkSession, root: str, seq: str, frames: int, beams: int = 64, azimuths: int = 720, crowd: int = 0) -> None:
    """A sequence of the scene on disk, as scans write_sequence lays it out; one frame at a time comes to the driver (EXT12)."""
    from terrafold.sources.scans import write_sequence

    tr = np.array([[0, -1, 0, 0], [0, 0, -1, 0], [1, 0, 0, 0]], float)  # from the sensor's axes to the camera's
    scan, poses = [], np.tile(np.eye(3, 4), (frames, 1, 1))
    for f in range(frames):
        p = sweep(spark, f, beams, azimuths).select("x", "y", "z", "raw_label").union(solids(spark, f, f, crowd, car=True).select("x", "y", "z", "raw_label"))
        a = np.array([tuple(r) for r in p.collect()], float)
        scan.append((np.column_stack([a[:, :2], a[:, 2] - T["sensor_height_m"], np.full(len(a), 0.5)]), a[:, 3].astype(int)))
        poses[f, 2, 3] = 2.0 * f
    write_sequence(root, seq, scan, poses, tr)
