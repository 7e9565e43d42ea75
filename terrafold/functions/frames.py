"""Rigid transforms as arrays of twelve numbers, row-major [R | t] (TX1-4).

A transform is a column, so a frame's pose is composed once a frame and joined to its points, which then take three linear
expressions each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.config import THRESHOLDS as T
from terrafold.functions.sensor import let

#: Camera axes (right, down, forward) to the vehicle's (forward, left, up): a fixed value.
FLIP = [0.0, 0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0]
IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def constant(m: list[float]) -> Column:
    if len(m) != 12:
        raise ValueError(f"a transform has 12 numbers, not {len(m)}")
    return F.array(*(F.lit(float(v)) for v in m))


def shifted(z: float) -> list[float]:
    """A move along the vertical."""
    return [*IDENTITY[:11], z]


def compose(a: Column, b: Column) -> Column:
    """The transform that does b and then a."""
    at = lambda a, b, i, j: F.get(a, 4 * i) * F.get(b, j) + F.get(a, 4 * i + 1) * F.get(b, 4 + j) + F.get(a, 4 * i + 2) * F.get(b, 8 + j)
    of = lambda a, b: F.array(*(at(a, b, i, j) + F.get(a, 4 * i + 3) if j == 3 else at(a, b, i, j) for i in range(3) for j in range(4)))
    return let(a, lambda a: let(b, lambda b: of(a, b)))


def inverse(m: Column) -> Column:
    """The way back of a rigid transform: the transposed rotation, and the move turned by it."""
    back = lambda m, i: -(F.get(m, i) * F.get(m, 3) + F.get(m, 4 + i) * F.get(m, 7) + F.get(m, 8 + i) * F.get(m, 11))
    return let(m, lambda m: F.array(*(back(m, i) if j == 3 else F.get(m, 4 * j + i) for i in range(3) for j in range(4))))


def vehicle_to_world(pose: Column, tr: list[float]) -> Column:
    """Vehicle to world, z up, from a pose (camera to camera world) and the sensor-to-camera calibration (TX3).

    A vehicle's point goes down to the sensor's origin, into the camera, along the pose, and out of the camera's axes.
    """
    return compose(constant(FLIP), compose(pose, compose(constant(tr), constant(shifted(-T["sensor_height_m"])))))


def relative(before: Column, now: Column) -> Column:
    """From the vehicle of the frame before to that of this frame, both given by their transforms to the world (TX4)."""
    return compose(inverse(now), before)


def apply(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point by a transform (TX1)."""
    row = lambda i: F.get(m, 4 * i) * x + F.get(m, 4 * i + 1) * y + F.get(m, 4 * i + 2) * z + F.get(m, 4 * i + 3)
    return row(0), row(1), row(2)
