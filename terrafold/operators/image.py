"""Range image and what is computed on it (AGG6, AGG7, STN6, STN7, STN10, STN11, ST7-9, JN5-8).

The image is sparse: a row for each filled pixel, keyed (frame, v, u). Joins are equi-joins on that key; normals
come from whole images, which are of bounded size.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terrafold.config import THRESHOLDS as T
from terrafold.functions.sensor import clear_tolerance_m, pixel


def with_pixel(points: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    u, v, r = pixel(F.col(x), F.col(y), F.col(z))
    return points.withColumns({"u": u, "v_raw": v, "r": r}).withColumn("v", F.greatest(F.lit(0), F.least(F.lit(T["rows"] - 1), F.col("v_raw"))))


def project(points: DataFrame, payload: list[str]) -> DataFrame:
    """Nearest return of each pixel, the first point on ties; points at zero range go (AGG6, WF1)."""
    p = with_pixel(points).filter("r > 1e-6")
    best = F.min(F.struct("r", "point_id", *payload)).alias("best")
    return p.groupBy("frame", "v", "u").agg(best).select("frame", "v", "u", "best.*")


def projection_stats(points: DataFrame) -> DataFrame:
    """Counts and fractions of a projection per frame (AGG7)."""
    p, ok = with_pixel(points), F.col("r") > 1e-6
    filled = F.count_distinct(F.when(ok, F.col("v") * T["columns"] + F.col("u")))
    g = p.groupBy("frame").agg(
        F.count("*").alias("n_input"), F.count_if(~ok).alias("n_zero_range"), F.count_if(ok & (F.col("v_raw") < 0)).alias("n_clamped_above"),
        F.count_if(ok & (F.col("v_raw") >= T["rows"])).alias("n_clamped_below"), filled.alias("n_filled"),
    )
    out = F.try_divide((F.col("n_clamped_above") + F.col("n_clamped_below")).cast("double"), F.col("n_input") - F.col("n_zero_range"))
    return g.withColumns({"fill_fraction": F.col("n_filled") / F.lit(float(T["rows"] * T["columns"])), "out_of_fov": out})


def warn_out_of_view(stats: DataFrame, most: float = 0.15) -> list[int]:
    """The frames, a row each, of which more than a share lay outside the image; a warning names them (AGG7)."""
    frames = [r.frame for r in stats.filter(F.col("out_of_fov") > most).select("frame").orderBy("frame").collect()]
    if frames:
        warnings.warn(f"more than {most:.0%} of the returns of {len(frames)} frames lie outside the image: {frames[:5]}", stacklevel=2)
    return frames


def incidence(image: DataFrame) -> DataFrame:
    """|cos| between beam and surface normal, from the neighbours left, right, above and below (STN6); azimuth wraps.

    An image is one group of at most rows x columns pixels, laid out densely; its neighbours are shifts of the array.
    """
    names, kinds = image.columns, [*image.schema.fields, StructField("cos_inc", DoubleType())]

    def run(t: pa.Table) -> pa.Table:
        v, u = t["v"].to_numpy(), t["u"].to_numpy()
        xyz = np.full((3, T["rows"] + 2, T["columns"]), np.nan)
        for k, c in enumerate("xyz"):
            xyz[k, v + 1, u] = t[c].to_numpy()
        p, r = xyz[:, v + 1, u], t["r"].to_numpy()
        a = xyz[:, v + 1, (u + 1) % T["columns"]] - xyz[:, v + 1, (u - 1) % T["columns"]]
        b = xyz[:, v + 2, u] - xyz[:, v, u]
        n = np.stack([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])
        size = np.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
        with np.errstate(invalid="ignore", divide="ignore"):
            cos = np.abs((n[0] * p[0] + n[1] * p[1] + n[2] * p[2]) / (size * r))
            seen = (size > 1e-6) & (r > 1e-6)
        return t.append_column("cos_inc", pa.array(cos, mask=~seen))

    return image.groupBy("frame").applyInArrow(run, StructType(kinds)).select(*names, "cos_inc")


def to_points(points: DataFrame, pixels: DataFrame, cols: list[str]) -> DataFrame:
    """points with what their own pixel (frame, v, u) has, null where the pixel is empty (JN7, STN7, STN10)."""
    own = pixels.select("frame", "v", "u", *cols)
    return with_pixel(points).join(own, ["frame", "v", "u"], "left").drop("v_raw", "r")


def reflectivity(image: DataFrame, intensity: Column, range_compensated: bool = True, incidence_compensated: bool = True, full_scale: float | None = None) -> DataFrame:
    """Reflectivity byte and flags (1 grazing, 2 no normal) of each pixel (STN7); the image needs cos_inc."""
    cos = F.col("cos_inc")
    rho = intensity if range_compensated else intensity * F.col("r") * F.col("r")
    rho = rho if incidence_compensated else rho / F.greatest(cos, F.lit(0.1))
    scale = full_scale or (1.0 if range_compensated and incidence_compensated else 6400.0)
    byte = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(rho / scale * 255.0))), F.lit(0.0)).cast("int")
    return image.withColumn("rho8", byte).withColumn("rho_flags", F.when(cos.isNull(), 2).when(cos < 0.1, 1).otherwise(0))


def residual_motion(image: DataFrame, warped: DataFrame, threshold_m: float = 0.75, min_range_m: float = 2.0) -> DataFrame:
    """Pixels whose range differs from that predicted by the frame before (STN10, JN8)."""
    pred = warped.select((F.col("frame") + 1).alias("frame"), "v", "u", F.col("r").alias("pred_r"))
    both = image.join(pred, ["frame", "v", "u"]).filter(F.col("r") >= min_range_m)
    return both.withColumn("residual", F.abs(F.col("r") - F.col("pred_r"))).withColumn("moving", F.col("residual") > threshold_m)


def see_through(candidates: DataFrame, image: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Candidate cells (frame, x, y, z in the vehicle frame) against the frame's image (ST8, JN5, JN6).

    A cell is seen through if the pixel it falls in saw farther than the cell by more than the tolerance; cells with a
    return in the present frame (``touched``: frame, ring, ix, iy) are protected.
    """
    c = candidates.withColumn("zs", F.col("z") - T["sensor_height_m"])
    u, v, r = pixel(F.col("x"), F.col("y"), F.col("zs"))
    c = c.withColumns({"u": u, "v": v, "r": r}).withColumn("in_view", F.coalesce(F.col("v").between(0, T["rows"] - 1), F.lit(False)))
    c = c.join(image.select("frame", "v", "u", F.col("r").alias("observed")), ["frame", "v", "u"], "left")
    c = c.withColumn("through", F.coalesce(F.col("in_view") & (F.col("observed") > F.col("r") + clear_tolerance_m(F.col("r"))), F.lit(False)))
    if touched is not None:
        c = c.join(touched.select("frame", "ring", "ix", "iy").distinct().withColumn("touched", F.lit(True)), ["frame", "ring", "ix", "iy"], "left")
        c = c.withColumn("protected", F.col("through") & F.coalesce("touched", F.lit(False))).withColumn("through", F.col("through") & F.col("touched").isNull()).drop("touched")
    return c.drop("zs")


def fill_gaps(image: DataFrame) -> DataFrame:
    """The image with isolated one-pixel gaps of a row filled by the mean of both neighbours (STN11)."""
    left = image.select("frame", "v", (F.col("u") + 1).alias("u"), F.col("r").alias("a"))
    right = image.select("frame", "v", (F.col("u") - 1).alias("u"), F.col("r").alias("b"))
    gaps = left.join(right, ["frame", "v", "u"]).join(image.select("frame", "v", "u"), ["frame", "v", "u"], "left_anti")
    return image.select("frame", "v", "u", "r", F.lit(False).alias("filled")).union(gaps.select("frame", "v", "u", ((F.col("a") + F.col("b")) / 2).alias("r"), F.lit(True)))


def azimuth_degrees(u: Column) -> Column:
    return (u + F.lit(0.5)) * (360.0 / T["columns"]) - 180.0
