"""Point, region and layer queries on map state (QRY1-6, JN10-12, FLT6, EXT4, VIZ)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.config import OCCUPIED, Schedule
from terrafold.functions import lattice as L
from terrafold.operators.fold import occupancy


def lookup(points: DataFrame, state: DataFrame, s: Schedule, transient: DataFrame | None = None, refined: DataFrame | None = None) -> DataFrame:
    """Cell values at query points (query_id, x_mm, y_mm in the world, ego_x_mm, ego_y_mm) (QRY1, QRY2).

    A region is just many points. Points outside the map, or in a cell never seen, get the unknown answer: null heights and
    no evidence. A transient cell wins over the map; a refined child wins over its parent.
    """
    q = points.withColumn("ring", L.ring_of_mm(F.col("x_mm") - F.col("ego_x_mm"), F.col("y_mm") - F.col("ego_y_mm"), s))
    q = q.withColumn("ix", L.index(F.col("x_mm"), F.col("ring"), s)).withColumn("iy", L.index(F.col("y_mm"), F.col("ring"), s))
    key = ["ring", "ix", "iy"]
    out = q.join(state, key, "left")
    ground = F.col("mu")
    if refined is not None:
        child = F.greatest(F.col("ring") - 1, F.lit(0))
        m = (L.cell_mm(F.col("ring"), s) / L.cell_mm(child, s)).cast("int")
        inner = F.pmod(L.index(F.col("y_mm"), child, s), m) * m + F.pmod(L.index(F.col("x_mm"), child, s), m)
        out = out.withColumn("child", inner.cast("int")).join(refined.select(*key, "child", F.col("mu").alias("fine_mu")), [*key, "child"], "left")
        ground = F.coalesce("fine_mu", ground)
    occ = occupancy(F.coalesce("n", F.lit(0)), F.coalesce("odds", F.lit(0)))
    dynamic = F.lit(False)
    if transient is not None:
        out = out.join(transient.select(*key, F.col("top_cm").alias("moving_cm")), key, "left")
        dynamic = F.col("moving_cm").isNotNull()
        ground, occ = F.coalesce("moving_cm", ground), F.when(dynamic, OCCUPIED).otherwise(occ)
    ceiling = F.when(F.col("ceil") < 32767, F.col("ceil"))
    return out.select(
        "query_id", "ring", ground.cast("int").alias("ground_cm"), ceiling.alias("ceiling_cm"), F.col("cand").alias("cls"),
        F.coalesce("n", F.lit(0)).alias("confidence"), occ.alias("occupancy"), dynamic.alias("dynamic"),
    )


def layers(state: DataFrame, s: Schedule) -> DataFrame:
    """Cells by occupancy with their centres in millimetres, the layers that a viewer draws (QRY6, EXT4, VIZ1)."""
    size = L.cell_mm(F.col("ring"), s)
    return state.select("ring", "ix", "iy", (F.col("ix") * size + size / 2).cast("bigint").alias("x_mm"), (F.col("iy") * size + size / 2).cast("bigint").alias("y_mm"), occupancy(F.col("n"), F.col("odds")).alias("occupancy"))


def evict(state: DataFrame, windows: DataFrame) -> DataFrame:
    """Cells still inside their ring's window (ring, x0, y0, side); the windows are a few rows (LAT17)."""
    w = F.broadcast(windows.select("ring", "x0", "y0", "side"))
    out = state.join(w, "ring").filter(L.in_view(F.col("ix"), F.col("iy"), F.col("x0"), F.col("y0"), F.col("side")))
    return out.drop("x0", "y0", "side")
