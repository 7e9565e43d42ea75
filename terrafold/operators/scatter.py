"""Exact integer aggregation of returns per cell (AGG1-5, FLT1, FLT2, FLT5).

Sums are BIGINT, so they don't depend on order, and every aggregate has a partial form before the one shuffle, which a hot
cell can't skew: a task sends at most one row for each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import MOVING, THRESHOLDS as T
from terrafold.config import Schedule
from terrafold.functions import lattice as L
from terrafold.functions.sensor import measurement_variance_cm2, quantise_weight

KEY = ["frame", "ring", "ix", "iy"]


def bin_points(points: DataFrame, s: Schedule) -> DataFrame:
    """points with (ring, ix, iy): the ring from the vehicle frame, the cell from the world frame; points outside and points
    without a coordinate go (LAT8).

    The keys can't be null, so joins on them push no check down into the scan, where it would compute them once more.
    """
    p = points.drop("ring").filter(F.col("xw_mm").isNotNull() & F.col("yw_mm").isNotNull())
    # out of a generator, so that what uses the ring doesn't hold its whole expression each time
    ring = F.coalesce(L.ring_of_mm(F.col("xv_mm"), F.col("yv_mm"), s), F.lit(-1))
    p = p.select("*", F.explode(F.array(ring)).alias("ring")).filter("ring >= 0")
    key = lambda c: F.coalesce(L.index(F.col(c), F.col("ring"), s), F.lit(0).cast("bigint"))
    return p.withColumns({"ix": key("xw_mm"), "iy": key("yw_mm")})


def in_windows(binned: DataFrame, windows: DataFrame) -> DataFrame:
    """binned points inside their ring's window in their frame (frame, ring, x0, y0, side, offset), with the slot of their cell
    (LAT8, LAT9); the windows are a few rows a frame."""
    b = binned.join(F.broadcast(windows), ["frame", "ring"]).filter(L.in_view(F.col("ix"), F.col("iy"), F.col("x0"), F.col("y0"), F.col("side")))
    return b.withColumn("slot", F.col("offset") + L.slot(F.col("ix"), F.col("iy"), F.col("side"))).drop("x0", "y0", "side", "offset")


def validated(points: DataFrame) -> DataFrame:
    """points, with an error for a class that the map can't store (EXT19, EXT20)."""
    bad = F.col("cls").isNull() | ~F.col("cls").between(0, T["unlabelled"])
    return points.withColumn("cls", F.when(bad, F.raise_error(F.concat(F.lit("class can't be stored: "), F.coalesce(F.col("cls").cast("string"), F.lit("null")))).cast("int")).otherwise(F.col("cls")))


def weight(points: DataFrame) -> Column:
    """Weight of a return by its range (TX12, TX13)."""
    r = F.sqrt((F.col("xv_mm") * F.col("xv_mm") + F.col("yv_mm") * F.col("yv_mm") + F.col("z_cm") * F.col("z_cm") * 100).cast("double")) / 1000
    return quantise_weight(measurement_variance_cm2(r))


def scatter(binned: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Per cell: sums of weighted ground heights and weights, count, reflectivity, lowest overhang, class of the first point."""
    b = binned.withColumn("w", weight(binned)).withColumn("gw", F.col("w") * F.col("g"))
    return b.groupBy(*key).agg(
        F.sum(F.col("gw") * F.col("z_cm")).alias("wz_sum"), F.sum("gw").alias("w_sum"), F.count("*").alias("n"), F.sum("refl").alias("refl_sum"),
        F.min(F.when(F.col("g") == 0, F.col("z_cm")).otherwise(T["no_ceiling"])).alias("ceiling_cm"), F.min_by("cls", "point_id").alias("cls"),
    )


def mean_height_cm(wz: Column, w: Column) -> Column:
    """Weighted mean rounded to whole centimetres, halves away from zero; 0 without weight (AGG3)."""
    return F.when(w > 0, F.signum(wz).cast("bigint") * int_div(2 * F.abs(wz) + w, 2 * w)).otherwise(F.lit(0).cast("bigint"))


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient of a >= 0 and b > 0 without passing through floating point; null for b = 0."""
    return ((a - a % F.when(b != 0, b)) / F.when(b != 0, b)).cast("bigint")


def moving(raw: Column) -> Column:
    return raw.bitwiseAND(65535).between(*MOVING)


def transient(binned: DataFrame) -> DataFrame:
    """Highest moving return per frame and cell; a frame's own layer, with no state (AGG4, ST11)."""
    z = F.greatest(F.lit(T["z_min_cm"]), F.least(F.lit(T["z_max_cm"]), F.col("z_cm")))
    m = binned.filter(moving(F.col("raw_label"))).groupBy(*KEY).agg(F.max(z).alias("top"))
    return m.select(*KEY, F.greatest(F.col("top"), F.lit(0).cast("bigint")).alias("top_cm"))


def cluster(points: DataFrame, cell_mm: int = 1000, key: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Moving points of a frame (the key) gathered in square metres: centre, top and first class of each (AGG5)."""
    c = points.withColumn("i", F.floor(F.col("xw_mm") / cell_mm)).withColumn("j", F.floor(F.col("yw_mm") / cell_mm))
    return c.groupBy(*key, "i", "j").agg(F.sum("xw_mm").alias("sx"), F.sum("yw_mm").alias("sy"), F.count("*").alias("n"), F.max("z_cm").alias("top_cm"), F.min_by("cls", "point_id").alias("cls"))
