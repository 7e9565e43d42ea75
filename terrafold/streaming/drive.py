"""The frame loop with state: fold, look through, count, frame by frame (ST7-9, AGG30).

Frames follow each other by nature; each frame's step is one distributed job that reads the map of the frame before and
writes its own, so a run that breaks off goes on from the last map that was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.config import THRESHOLDS as T
from terrafold.config import OCCUPIED, Schedule
from terrafold.functions import lattice as L
from terrafold.operators import fold, image, scatter
from terrafold.streaming.replay import advance

KEY = ["ring", "ix", "iy"]


def candidates(state: DataFrame, s: Schedule, frame: int, ego_mm: tuple[int, int], datum_cm: int = 0) -> DataFrame:
    """Occupied cells as seen from the vehicle: the ceiling's height where one was seen, else the ground's (ST9)."""
    size = L.cell_mm(F.col("ring"), s)
    x, y = (((F.col(i) + 0.5) * size - e) / 1000.0 for i, e in zip(("ix", "iy"), ego_mm, strict=True))
    z = (F.when(F.col("ceil") < T["no_ceiling"], F.col("ceil")).otherwise(F.col("mu")) + datum_cm) / 100.0
    occupied = state.filter(fold.occupancy(F.col("n"), F.col("odds")) == OCCUPIED)
    return occupied.select(F.lit(frame).alias("frame"), *KEY, x.alias("x"), y.alias("y"), z.alias("z"))


def looked_through(state: DataFrame, pixels: DataFrame, touched: DataFrame, s: Schedule, frame: int, ego_mm: tuple[int, int], datum_cm: int = 0) -> DataFrame:
    """state after the misses of a frame, with what became of each cell (tested, in_view, protected, through)."""
    c = image.see_through(candidates(state, s, frame, ego_mm, datum_cm), pixels, touched).select(*KEY, "in_view", "protected", "through")
    out = state.join(c, KEY, "left").withColumn("tested", F.col("in_view").isNotNull())
    return out.withColumn("odds", F.when(F.coalesce("through", F.lit(False)), fold.miss(F.col("odds"))).otherwise(F.col("odds")).cast("int"))


def drive(spark: SparkSession, points: DataFrame, s: Schedule, ego_mm: dict[int, tuple[int, int]], folder: str, datum_cm: dict[int, int] | None = None) -> tuple[DataFrame, list[dict]]:
    """The map after all frames, and the counters of each; one folder for each frame's map.

    points: binned by their own columns, with x, y, z from the sensor in metres; ego_mm: the vehicle in the world in each
    frame; datum_cm: the map's datum over the vehicle's ground, by frame.
    """
    empty = "ring int, ix bigint, iy bigint, last_frame int, " + ", ".join(f"{f} int" for f in fold.FIELDS)
    state, counters = spark.createDataFrame([], empty), []
    for frame in sorted(ego_mm):
        p = points.filter(F.col("frame") == frame)
        binned = scatter.bin_points(p, s)
        now = advance(state, scatter.scatter(binned))
        done = looked_through(now, image.project(p, ["x"]), binned, s, frame, ego_mm[frame], (datum_cm or {}).get(frame, 0))
        path = f"{folder}/frame={frame:06d}"
        done.write.mode("overwrite").parquet(path)
        written = spark.read.schema(done.schema).parquet(path)
        count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
        n = written.agg(F.count("*").alias("cells"), count("tested"), F.count_if(~F.col("in_view")).alias("out_of_view"), count("protected"), F.count_if(F.coalesce("through", F.lit(False))).alias("cleared")).first()
        of = binned.agg(F.count("*").alias("binned"), F.count_distinct(*KEY).alias("touched")).first()
        counters.append({"frame": frame, "points": p.count(), **of.asDict(), **n.asDict(), "occupied": n.tested})
        state = written.select(*KEY, "last_frame", *fold.FIELDS)
    return state, counters
