"""A map session: the same calls on one map, set at a time (QRY1-6, SNK1, SNK3, SNK5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.config import Schedule, load
from terrafold.functions import lattice as L
from terrafold.operators import fold, pyramid, query, scatter


@dataclass
class MapSession:
    """State of a map, with the overlays that queries look through."""

    spark: SparkSession
    state: DataFrame
    schedule: Schedule
    ego_mm: tuple[int, int] = (0, 0)
    transient: DataFrame | None = None
    refined: DataFrame | None = None
    tracks: DataFrame | None = None

    @classmethod
    def build(cls, points: DataFrame, schedule: str = "5_10_20_40", ego_mm: tuple[int, int] = (0, 0)) -> MapSession:
        """Points to state: moving returns go to the transient layer of the last frame, the others are folded."""
        s = load(schedule)
        binned = scatter.bin_points(points, s)
        fixed = binned.filter(~scatter.moving(F.col("raw_label")))
        last = points.agg(F.max("frame")).first()[0]
        return cls(points.sparkSession, fold.fold(scatter.scatter(fixed)), s, ego_mm, scatter.transient(binned.filter(F.col("frame") == last)).drop("frame"))

    def query_region(self, points: DataFrame) -> DataFrame:
        """Values at points (query_id, x_mm, y_mm)."""
        p = points.withColumns({"ego_x_mm": F.lit(self.ego_mm[0]).cast("bigint"), "ego_y_mm": F.lit(self.ego_mm[1]).cast("bigint")})
        return query.lookup(p, self.state, self.schedule, self.transient, self.refined)

    def query(self, x_m: float, y_m: float):
        """The value at one point."""
        one = self.spark.createDataFrame([(0, round(x_m * 1000), round(y_m * 1000))], "query_id bigint, x_mm bigint, y_mm bigint")
        return self.query_region(one).first()

    def query_conservative(self, blocks: DataFrame, level: int, box: tuple[int, int, int, int]) -> DataFrame:
        """Safe, blocked or mixed for a box of cells, from a pyramid."""
        return pyramid.query_box(blocks, level, *box)

    def dynamic_objects(self) -> DataFrame | None:
        """Tracks that are still alive in the last frame (QRY5)."""
        if self.tracks is None:
            return None
        last = self.tracks.groupBy("seq").agg(F.max("frame").alias("frame"))
        return self.tracks.join(F.broadcast(last), ["seq", "frame"])

    def occupied(self) -> DataFrame:
        return query.layers(self.state, self.schedule).filter("occupancy = 2")

    def export_grid(self, cell_mm: int, half_mm: int) -> DataFrame:
        """Heights on a uniform grid around the vehicle, each cell from the finest ring that covers it (SNK3)."""
        return export_grid(self.state, self.schedule, cell_mm, half_mm)

    def save(self, path: str) -> None:
        """State as Parquet, by ring, so that a lookup in one ring reads only its files."""
        self.state.write.mode("overwrite").partitionBy("ring").parquet(path)


def export_grid(state: DataFrame, s: Schedule, cell_mm: int, half_mm: int) -> DataFrame:
    """Uniform cells (gx, gy) with the height of the finest ring whose cell holds their centre."""
    size = L.cell_mm(F.col("ring"), s)
    n = F.greatest(F.ceil(size / cell_mm), F.lit(1)).cast("int")
    first = lambda c: F.floor(F.col(c) * size / cell_mm)
    c = state.withColumn("gx0", first("ix")).withColumn("gy0", first("iy")).withColumn("dx", F.explode(F.sequence(F.lit(0), n - 1)))
    c = c.withColumn("dy", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("gx", F.col("gx0") + F.col("dx")).withColumn("gy", F.col("gy0") + F.col("dy"))
    c = c.filter((F.abs(F.col("gx") * cell_mm) < half_mm) & (F.abs(F.col("gy") * cell_mm) < half_mm))
    return c.groupBy("gx", "gy").agg(F.min_by("mu", F.struct("ring", "ix", "iy")).alias("ground_cm"), F.min("ring").alias("ring"))


def csv(df: DataFrame, path: str) -> None:
    """Rows with a header (SNK1)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def text_table(rows: list[dict]) -> str:
    """A few result rows as aligned text (SNK5)."""
    if not rows:
        return ""
    names = list(rows[0])
    cells = [names, *([f"{r[n]:.3f}" if isinstance(r[n], float) else str(r[n]) for n in names] for r in rows)]
    width = [max(len(r[i]) for r in cells) for i in range(len(names))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, width, strict=True)) for r in cells)
