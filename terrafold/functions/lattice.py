"""Column expressions that key points to the nested lattice (LAT*)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.config import Schedule

#: How far behind the vehicle the rear floor holds.
REAR_FLOOR_M = 50.0


def mm(metres: float) -> int:
    return round(metres * 1000)


def floor_div(x: Column, c: float | Column) -> Column:
    """Float floor division by a positive c as binary floating point gives it (1.0 // 0.05 is 19), not floor of the quotient (LAT1)."""
    c = F.lit(c) if not isinstance(c, Column) else c
    r = x % c
    m = F.when(r < 0, r + c).otherwise(r)
    q = (x - m) / c
    f = F.floor(q)
    return (f + F.when(q - f > 0.5, 1).otherwise(0)).cast("bigint")


def int_floor_div(i: Column, k: int | Column) -> Column:
    """Floor division of integers, exact for negatives; k must be positive (LAT2)."""
    k = F.lit(k) if not isinstance(k, Column) else k
    return ((i - F.pmod(i, k)) / k).cast("bigint")


def stretch(speed_ms: float, s: Schedule) -> tuple[float, float, float]:
    """Stretch of the rings ahead, to the sides and behind (LAT3)."""
    v = speed_ms / s.v_ref_ms
    return min(2.0, max(1.0, 1 + s.kappa_forward * v)), 1 / (1 + s.kappa_side * v), s.rear_stretch


def stretch_columns(speed: Column, s: Schedule) -> tuple[Column, Column, Column]:
    v = speed / s.v_ref_ms
    return F.least(F.lit(2.0), F.greatest(F.lit(1.0), 1 + s.kappa_forward * v)), 1 / (1 + s.kappa_side * v), F.lit(s.rear_stretch)


def d_aniso(x: Column, y: Column, speed: Column, s: Schedule) -> Column:
    """Distance under the speed's stretch: that of the tightest direction (LAT4)."""
    ahead, side, rear = stretch_columns(speed, s)
    return F.greatest(F.greatest(x, F.lit(0.0)) / ahead, F.greatest(-x, F.lit(0.0)) / rear, F.abs(y) / side)


def aniso(x: float, y: float, speed: float, s: Schedule) -> float:
    """d_aniso for single numbers."""
    ahead, side, rear = stretch(speed, s)
    return max(max(x, 0.0) / ahead, max(-x, 0.0) / rear, abs(y) / side)


def rear_floor_ring(s: Schedule) -> int | None:
    """The coarsest ring whose cells stay within the rear floor; None if that limits nothing (LAT6)."""
    fit = [r.ring for r in s.rings if r.cell_m <= s.rear_floor_cell_m + 1e-12]
    return None if not fit or len(fit) == len(s.rings) else max(fit)


def rings_below(d: Column, s: Schedule) -> Column:
    """Number of half-widths at or below d: the ring by distance, boundaries going outward (JN3)."""
    return reduce(lambda a, b: a + b, [F.when(d >= r.half_width_m, 1).otherwise(0) for r in s.rings])


def ring_of(x: Column, y: Column, s: Schedule, speed: Column | float = 0.0) -> Column:
    """Ring of a point in the vehicle frame, in metres; -1 outside (LAT5)."""
    speed = F.lit(float(speed)) if not isinstance(speed, Column) else speed
    cheb, last = F.greatest(F.abs(x), F.abs(y)), len(s.rings) - 1
    by_size = rings_below(cheb, s)
    ring = F.greatest(rings_below(d_aniso(x, y, speed, s), s), by_size)
    floor = rear_floor_ring(s)
    if floor is not None:
        rear = (x < 0) & (F.abs(x) < REAR_FLOOR_M) & (by_size <= floor)
        ring = F.when(rear, F.least(ring, F.lit(floor))).otherwise(ring)
    return F.when(by_size > last, -1).otherwise(F.least(ring, F.lit(last))).cast("int")


def ring_of_mm(xv_mm: Column, yv_mm: Column, s: Schedule) -> Column:
    """Ring at standstill from whole millimetres; null outside."""
    cheb = F.greatest(F.abs(xv_mm), F.abs(yv_mm))
    out = F.when(cheb < mm(s.rings[0].half_width_m), 0)
    for r in s.rings[1:]:
        out = out.when(cheb < mm(r.half_width_m), r.ring)
    return out


def migrate_ring(x: Column, y: Column, current: Column, s: Schedule, speed: Column | float = 0.0) -> Column:
    """Ring under hysteresis: outward only beyond (1 + eps) of the boundary, inward as soon as inside it (LAT7)."""
    speed = F.lit(float(speed)) if not isinstance(speed, Column) else speed
    d, now = d_aniso(x, y, speed, s), ring_of(x, y, s, speed)
    bound = lambda c: F.get(F.array(*(F.lit(float(r.half_width_m)) for r in s.rings)), c)
    last = len(s.rings) - 1
    out = F.when(current == -1, now)
    out = out.when(d > bound(current) * (1 + s.hysteresis), F.when(now == -1, -1).otherwise(F.greatest(now, current + 1)))
    return out.when((current > 0) & (d < bound(F.greatest(current - 1, F.lit(0)))), now).otherwise(current).cast("int")


def migrated(x: float, y: float, current: int, s: Schedule, speed: float = 0.0) -> int:
    """migrate_ring for single numbers, for state that is kept outside of Spark's expressions."""
    half, last = [r.half_width_m for r in s.rings], len(s.rings) - 1
    below = lambda v: sum(v >= h for h in half)
    d, by_size, floor = aniso(x, y, speed, s), below(max(abs(x), abs(y))), rear_floor_ring(s)
    now = max(below(d), by_size)
    if floor is not None and x < 0 and abs(x) < REAR_FLOOR_M and by_size <= floor:
        now = min(now, floor)
    now = -1 if by_size > last else min(now, last)
    if current == -1:
        return now
    if d > half[current] * (1 + s.hysteresis):
        return -1 if now == -1 else max(now, current + 1)
    return now if current > 0 and d < half[current - 1] else current


def cell_mm(ring: Column, s: Schedule) -> Column:
    return F.get(F.array(*(F.lit(mm(r.cell_m)) for r in s.rings)), ring)


def index(x_mm: Column, ring: Column, s: Schedule) -> Column:
    """Cell index of whole millimetres at a ring's resolution; floor, exact for negatives."""
    return F.floor(x_mm / cell_mm(ring, s).cast("double")).cast("bigint")


def in_view(ix: Column, iy: Column, x0: Column, y0: Column, side: Column) -> Column:
    return (ix >= x0) & (ix < x0 + side) & (iy >= y0) & (iy < y0 + side)


def slot(ix: Column, iy: Column, side: Column) -> Column:
    """Place of a cell in a ring buffer that wraps (LAT9)."""
    return F.pmod(iy, side) * side + F.pmod(ix, side)


def strips(shifts: DataFrame) -> DataFrame:
    """Cells that come into a window, with their slots (LAT18): rows of a window (x0, y0, side, offset) and its place before
    (px, py); the columns that are new, and of the others the rows that are new, so that no cell comes twice."""
    side = F.col("side")
    cut = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    new = lambda at, old: F.concat(cut(at, F.least(at + side, old)), cut(F.greatest(at, old + side), at + side))
    old = lambda at, old: cut(F.greatest(at, old), F.least(at, old) + side)
    x0, y0, px, py = map(F.col, ("x0", "y0", "px", "py"))
    columns = shifts.select("*", F.explode(new(x0, px)).alias("ix")).select("*", F.explode(cut(y0, y0 + side)).alias("iy"))
    rows = shifts.select("*", F.explode(new(y0, py)).alias("iy")).select("*", F.explode(old(x0, px)).alias("ix"))
    return columns.unionByName(rows).withColumn("slot", F.col("offset") + slot(F.col("ix"), F.col("iy"), side))


def centre(i: Column, cell_m: Column, origin_m: Column) -> Column:
    """Centre of a cell relative to an origin, in metres (LAT10)."""
    return (i + F.lit(0.5)) * cell_m - origin_m


def rings(spark: SparkSession, s: Schedule) -> DataFrame:
    """One row per ring: extents, counts and slot offsets (LAT11, LAT12)."""
    rows, offset = [], 0
    for r in s.rings:
        rows.append((s.name, r.ring, float(r.half_width_m), r.cell_m, s.k(r.ring), s.side(r.ring), s.hole(r.ring), s.cells(r.ring), offset))
        offset += s.side(r.ring) ** 2
    return spark.createDataFrame(rows, "schedule string, ring int, half_width_m double, cell_m double, k int, side int, hole int, cells int, offset int")


def annulus_index(ix: Column, iy: Column, side: Column, hole: Column) -> Column:
    """Places 0.. of the cells of a ring without its centred hole: rows before it, rows after, then left and right of it;
    -1 in the hole and outside (LAT13)."""
    lo = ((side - hole) / 2).cast("int")
    hi = lo + hole
    inside = ix.between(0, side - 1) & iy.between(0, side - 1)
    after, left = lo * side, 2 * lo * side
    out = F.when(~inside, -1).when(iy < lo, iy * side + ix).when(iy >= hi, after + (iy - hi) * side + ix)
    out = out.when(ix < lo, left + (iy - lo) * lo + ix).when(ix >= hi, left + hole * lo + (iy - lo) * (side - hi) + ix - hi)
    return out.otherwise(-1).cast("int")


def blind(x: Column, y: Column, radius_m: float) -> Column:
    return F.hypot(x, y) < radius_m


def azimuth_spacing_m(r_m: float, columns: int = 1800) -> float:
    return r_m * 2 * math.pi / columns
