"""Sensor model, height and variance codecs as column expressions (TX12-20)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.config import LOG_RANGE, MAX_CODE, THRESHOLDS as T
from terrafold.config import VAR_MAX_CM2, VARIANCE

SIGMA_PHI = math.radians(T["sigma_phi_deg"])


def measurement_variance_cm2(r_m: Column, cos: Column | float = 1.0) -> Column:
    r = F.greatest(r_m, F.lit(1e-3))
    c = F.greatest(F.lit(cos) if not isinstance(cos, Column) else cos, F.lit(0.1))
    h = F.lit(T["sensor_height_m"]) / r
    return (h * h * F.lit(T["sigma_r_m"] ** 2) + r * r * F.lit(SIGMA_PHI**2)) / (c * c) * 1e4


def quantise_weight(variance_cm2: Column) -> Column:
    w = F.rint(F.lit(float(T["weight_scale"])) / F.greatest(variance_cm2, F.lit(1e-9)))
    return F.least(F.greatest(w, F.lit(1.0)), F.lit(float(T["weight_max"]))).cast("bigint")


def quantise_height_cm(z_m: Column, datum_m: Column | float = 0.0) -> Column:
    d = datum_m if isinstance(datum_m, Column) else F.lit(float(datum_m))
    z = F.rint(z_m * 100.0 - d * 100.0)
    return F.greatest(F.lit(float(T["z_min_cm"])), F.least(F.lit(float(T["z_max_cm"])), z)).cast("int")


def variance_cm2(code: Column) -> Column:
    """Variance of a code, from the table of all codes."""
    return F.get(F.array(*map(F.lit, VARIANCE)), code)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever the number of uses in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quantise_variance(v: Column) -> Column:
    """The largest code whose variance is v at least; the logarithm's guess is settled by the table, so engines agree."""

    def settled(v: Column, g: Column) -> Column:
        up = F.least(g + 1, F.lit(MAX_CODE))
        return F.when(v <= variance_cm2(up), up).when((v > variance_cm2(g)) & (g > 0), g - 1).otherwise(g)

    guess = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(float(MAX_CODE)), F.floor(MAX_CODE * F.log(VAR_MAX_CM2 / v) / LOG_RANGE))).cast("int")
    return let(F.greatest(v, F.lit(1e-12)), lambda v: let(guess(v), lambda g: settled(v, g)))


def clear_tolerance_m(r_m: Column) -> Column:
    return F.greatest(3.0 * F.sqrt(measurement_variance_cm2(r_m)) / 100.0, F.lit(T["clear_floor_m"]))


def priority(r_m: Column, dynamic: Column, ttc_s: Column) -> Column:
    """Score of a refinement block: near, moving and soon to be met first (TX19)."""
    urgency = F.when(ttc_s >= 0, F.greatest(1 / (1 + ttc_s / 3.0), F.lit(0.05))).otherwise(1.0)
    return 1 / (1 + F.greatest(r_m, F.lit(0.0)) / 10.0) * F.when(dynamic, 4.0).otherwise(1.0) * urgency


def time_to_collision(x_m: Column, speed: Column) -> Column:
    return F.when((speed > 1e-6) & (x_m > 0), x_m / speed).otherwise(F.lit(float("inf")))


def pack_class(cand: Column, cnt: Column) -> Column:
    return F.shiftleft(cand.cast("int"), 3).bitwiseOR(cnt.cast("int"))


def pixel(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(u, v before clamping, r) of a point in the range image (TX6); v is null at zero range."""
    w, h = T["columns"], T["rows"]
    up, down = math.radians(T["phi_max_deg"]), math.radians(T["phi_min_deg"])
    r = F.sqrt(x * x + y * y + z * z)
    u = F.pmod(F.floor((F.atan2(y, x) + math.pi) / (2 * math.pi / w)), F.lit(w)).cast("int")
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / F.when(r > 1e-6, r)))
    return u, F.floor((up - F.asin(ratio)) / ((up - down) / h)).cast("int"), r


def inflate(variance_m2: Column, grad: Column, parent_m: float, child_m: float) -> Column:
    """Variance of a child cell on sloping ground (TX21)."""
    if child_m >= parent_m:
        raise ValueError("a split must go finer")
    return variance_m2 + T["kappa"] * grad * grad * (parent_m**2 - child_m**2) + T["alpha_m2"]
