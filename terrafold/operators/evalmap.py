"""Reference map and scores against it (AGG8-10, AGG15-20, FLT12, JN13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.config import THRESHOLDS as T
from terrafold.config import Schedule
from terrafold.functions import lattice as L
from terrafold.operators.fold import fold, occupancy
from terrafold.operators.scatter import bin_points, scatter


def reference(points: DataFrame, cell_mm: int = 50) -> DataFrame:
    """Fine cells (i, j) of all points: height sum, count, class of the last point in the first frame that has one (AGG8)."""
    p = points.withColumn("i", F.floor(F.col("xw_mm") / cell_mm)).withColumn("j", F.floor(F.col("yw_mm") / cell_mm))
    per = p.groupBy("i", "j", "frame").agg(F.sum("z_cm").alias("sz"), F.count("*").alias("n"), F.max_by("cls", "point_id").alias("cls"))
    first = F.min_by(F.when(F.col("cls") != 0, F.col("cls")), F.when(F.col("cls") != 0, F.col("frame")))
    return per.groupBy("i", "j").agg(F.sum("sz").alias("sz"), F.sum("n").alias("n"), F.coalesce(first, F.lit(0)).alias("cls"))


def blocks(ref: DataFrame, s: Schedule, fine_mm: int = 50) -> DataFrame:
    """For each ring's cell: fine cells seen, their mean and variance, most common class, lowest on ties (AGG9, AGG10).

    Cells of all rings are aligned to the fine lattice, so a block is an equi-key, floor(i / k), not a range.
    """
    ks = F.array(*(F.struct(F.lit(r.ring).alias("ring"), F.lit(L.mm(r.cell_m) // fine_mm).alias("k")) for r in s.rings))
    b = ref.withColumn("mean_cm", F.col("sz") / F.col("n")).withColumn("r", F.explode(ks))
    b = b.select(F.col("r.ring").alias("ring"), F.floor(F.col("i") / F.col("r.k")).alias("ix"), F.floor(F.col("j") / F.col("r.k")).alias("iy"), "mean_cm", "cls")
    by_class = b.groupBy("ring", "ix", "iy", "cls").agg(F.count("*").alias("n"), F.sum("mean_cm").alias("s1"), F.sum(F.col("mean_cm") * F.col("mean_cm")).alias("s2"))
    g = by_class.groupBy("ring", "ix", "iy").agg(F.sum("n").alias("n_ref"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.max(F.col("n") * 64 + (63 - F.col("cls"))).alias("top"))
    g = g.withColumn("cls_ref", (63 - F.pmod("top", F.lit(64))).cast("int"))  # a number, so that the aggregate hashes and needn't sort
    mean = F.col("s1") / F.col("n_ref")
    return g.select("ring", "ix", "iy", "n_ref", mean.alias("mean_ref"), F.greatest(F.lit(0.0), F.col("s2") / F.col("n_ref") - mean * mean).alias("var_ref"), "cls_ref")


def compared(state: DataFrame, block: DataFrame) -> DataFrame:
    """Cells that can be scored: seen, with a height measured inside the band, over a seen block (FLT12)."""
    ok = (F.col("n") > 0) & (F.col("code") > 0) & (F.col("mu") > T["z_min_cm"]) & (F.col("mu") < T["z_max_cm"])
    return state.filter(ok).join(block, ["ring", "ix", "iy"]).withColumn("err", F.col("mu") - F.col("mean_ref"))


def scores(scored: DataFrame, s: Schedule, fine_mm: int = 50) -> DataFrame:
    """Per ring: RMSE, loss and its ratio to the spread of the terrain, bias, coverage (AGG15, AGG16, AGG19)."""
    usable = F.when(F.col("n_ref") > 1, 1)
    e2 = F.col("err") * F.col("err")
    rms = lambda c: F.sqrt(F.avg(c))
    k = F.get(F.array(*(F.lit(L.mm(r.cell_m) // fine_mm) for r in s.rings)), F.col("ring"))
    g = scored.groupBy("ring").agg(
        F.count("*").alias("cells"), rms(e2).alias("rmse_cm"), rms(usable * (e2 + F.col("var_ref"))).alias("il_cm"), rms(usable * F.col("var_ref")).alias("spread_cm"),
        F.avg(usable * F.col("err")).alias("bias_cm"), F.avg(usable * (F.col("err") > 0).cast("int")).alias("above"), F.count(usable).alias("usable"),
        F.median(F.col("n_ref") / (k * k)).alias("coverage"),
    )
    return g.withColumn("rho", F.when(F.col("spread_cm") > 1e-9, F.col("il_cm") / F.col("spread_cm")))


def evaluate(points: DataFrame, s: Schedule, ref: DataFrame | None = None) -> DataFrame:
    """Scores per ring of the map that a schedule makes of points (QRY17)."""
    state = fold(scatter(bin_points(points, s)))
    return scores(compared(state, blocks(reference(points) if ref is None else ref, s)), s).withColumn("schedule", F.lit(s.name))


def compare(points: DataFrame, schedules: list[Schedule]) -> DataFrame:
    """The scores of several schedules over the same points and reference, one under the other (QRY17)."""
    ref = reference(points)
    return reduce(DataFrame.unionByName, (evaluate(points, s, ref) for s in schedules))


def summary(compared_scores: DataFrame, mb: dict[str, float]) -> DataFrame:
    """One row a schedule: memory, worst ring, mean coarsening ratio of the rings that have one (AGG31)."""
    of = F.create_map(*(F.lit(v) for k, m in mb.items() for v in (k, float(m))))
    g = compared_scores.groupBy("schedule").agg(F.max("rmse_cm").alias("worst_rmse_cm"), F.avg("rho").alias("mean_rho"))
    return g.withColumn("mb", F.try_element_at(of, F.col("schedule")))


def overlap(state: DataFrame, block: DataFrame) -> DataFrame:
    """Occupied cells against seen blocks per ring: both, either, their ratio, share of blocks seen (AGG17, AGG18)."""
    j = state.select("ring", "ix", "iy", "n", occupancy(F.col("n"), F.col("odds")).alias("occ")).join(block.select("ring", "ix", "iy", "n_ref"), ["ring", "ix", "iy"], "full")
    mine, truth = F.coalesce(F.col("occ") == 2, F.lit(False)), F.col("n_ref").isNotNull()
    g = j.groupBy("ring").agg(F.count_if(mine & truth).alias("both"), F.count_if(mine | truth).alias("either"), F.count_if(truth & (F.coalesce("n", F.lit(0)) > 0)).alias("filled"), F.count_if(truth).alias("blocks"), F.count_if(F.col("n") == 255).alias("saturated"))
    return g.withColumn("iou", F.when(F.col("either") > 0, F.col("both") / F.col("either"))).withColumn("fill", F.when(F.col("blocks") > 0, F.col("filled") / F.col("blocks")))


def removal(cells: DataFrame) -> DataFrame:
    """Dynamic cells removed, static ones kept, and their harmonic mean (AGG20); columns dynamic, removed."""
    share = lambda part, whole: F.try_divide(F.count_if(F.expr(part)).cast("double"), F.count_if(F.expr(whole)))
    g = cells.agg(share("dynamic AND removed", "dynamic").alias("dr"), share("NOT dynamic AND NOT removed", "NOT dynamic").alias("sp"))
    return g.withColumn("f", F.when(F.col("dr") + F.col("sp") > 0, 2 * F.col("dr") * F.col("sp") / (F.col("dr") + F.col("sp"))).otherwise(0.0))


def guard(points: DataFrame, far_m: float = 10.0, most_cm: float = 200.0) -> DataFrame:
    """The frames at which the axes are checked (FLT13): the first, and the first whose vehicle (x_m) is far_m on; whether the
    median height of the ground there is near zero, as it is if up is up. Medians are of whole centimetres of a bounded band."""
    g = points.groupBy("frame").agg(F.min("x_m").alias("x_m"), F.median(F.when(F.col("g") == 1, F.col("z_cm"))).alias("ground_cm"))
    first = g.agg(F.min_by("x_m", "frame").alias("x0"), F.min("frame").alias("f0"))
    at = g.crossJoin(F.broadcast(first))  # one row
    far = at.filter(F.abs(F.col("x_m") - F.col("x0")) >= far_m).agg(F.min("frame").alias("f1"))
    at = at.crossJoin(F.broadcast(far)).filter((F.col("frame") == F.col("f0")) | (F.col("frame") == F.col("f1")))
    return at.select("frame", "ground_cm", (F.abs("ground_cm") <= most_cm).alias("upright"))


def assert_upright(checked: DataFrame) -> None:
    """An error that names the frames, two at most, whose ground isn't near zero (FLT13)."""
    bad = checked.filter(~F.coalesce("upright", F.lit(True))).collect()
    if bad:
        raise ValueError("the world isn't z-up: " + ", ".join(f"ground at {r.ground_cm} cm in frame {r.frame}" for r in bad))


def in_footprint(x_mm: Column, y_mm: Column, half_mm: int = 100_000) -> Column:
    """Inside the square of the baselines (FLT16)."""
    return (x_mm >= -half_mm) & (x_mm < half_mm) & (y_mm >= -half_mm) & (y_mm < half_mm)


def in_layers(z_cm: Column) -> Column:
    """Inside the height layers of the dense baseline (FLT16)."""
    return (z_cm >= T["z_min_cm"]) & (z_cm < T["z_max_cm"])


def save_reference(ref: DataFrame, path: str, tile: int = 2048) -> None:
    """The reference map as Parquet by tile of i, so that a window reads only its files (SRC15)."""
    ref.withColumn("tile", F.floor(F.col("i") / tile)).write.mode("overwrite").partitionBy("tile").parquet(path)


def load_reference(spark, path: str, low: int | None = None, high: int | None = None, tile: int = 2048) -> DataFrame:
    """A saved reference map, or its cells with low <= i < high (SRC15)."""
    ref = spark.read.parquet(path)
    if low is not None:
        ref = ref.filter((F.col("tile") >= low // tile) & (F.col("i") >= low))
    if high is not None:
        ref = ref.filter((F.col("tile") <= (high - 1) // tile) & (F.col("i") < high))
    return ref.drop("tile")


def monotonicity(rows: DataFrame, size: str, value: str, name: str) -> DataFrame:
    """rows, a handful of schedules, with ``worse``: a smaller one that has a larger value than the next larger (AGG29)."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(size), name)
    return rows.withColumn("worse", F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(False)))
