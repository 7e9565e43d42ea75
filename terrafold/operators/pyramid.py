"""Conservative block pyramid, levels of detail, split and merge (AGG11, AGG12, FLT10, ST16, QRY4, GATE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import THRESHOLDS as T
from terrafold.functions.sensor import inflate, variance_cm2

SAFE, BLOCKED, MIXED = 0, 1, 2


def build(cells: DataFrame, levels: int) -> DataFrame:
    """Bounds of 2x2 blocks of every level (AGG12); level 0 is the cells themselves (EXT3).

    Each cell gives a row to each of its ancestors; partial aggregation brings those of a task together before the one
    shuffle, so all levels come from one pass and no level waits for the one below.
    """
    up = cells.select("tile", "ix", "iy", "ground_cm", "ceiling_cm", "n", "trav", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    return up.groupBy("tile", "level", F.expr("shiftright(ix, level)").alias("bx"), F.expr("shiftright(iy, level)").alias("by")).agg(
        F.max("ground_cm").alias("h_max"), F.min("ground_cm").alias("h_min"), F.min("ceiling_cm").alias("c_min"), F.min("n").alias("n_min"),
        F.bit_and("trav").alias("and_mask"), F.bit_or("trav").alias("or_mask"),
    )


def theorem_safe(n: DataFrame | None = None) -> Column:
    """A block is certainly safe if its bounds rule out steps, low ceilings and thin evidence (FLT10)."""
    return (F.col("h_max") - F.col("h_min") < T["s_max_cm"]) & (F.col("c_min") - F.col("h_max") > T["h_vehicle_cm"]) & (F.col("n_min") >= T["n_min"])


def classify() -> Column:
    """Safe if no bit is set anywhere, blocked if one is set everywhere, else mixed."""
    return F.when(F.col("or_mask") == 0, SAFE).when(F.col("and_mask") != 0, BLOCKED).otherwise(MIXED)


def query_box(pyramid: DataFrame, level: int, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The answer for a box of cells at a level: blocked, mixed or safe, from the blocks that touch it (QRY4)."""
    hit = pyramid.filter((F.col("level") == level) & F.col("bx").between(x0 >> level, x1 >> level) & F.col("by").between(y0 >> level, y1 >> level))
    c = classify()
    return hit.groupBy("tile").agg(F.when(F.min(c) == F.max(c), F.min(c)).otherwise(MIXED).alias("lod"), F.count("*").alias("blocks"))


def split(cells: DataFrame, parent_m: float, child_m: float, grad: Column) -> DataFrame:
    """m x m children of each cell (ST16): equal height, inflated variance, flagged derived and not refined."""
    m = round(parent_m / child_m)
    var = inflate(variance_cm2(F.col("code").cast("int")) * 1e-4, grad, parent_m, child_m)
    c = cells.withColumn("child", F.explode(F.sequence(F.lit(0), F.lit(m * m - 1))))
    return c.select("tile", "ix", "iy", "child", (F.col("ground_cm") / 100.0).alias("mu_m"), var.alias("sigma2_m2"), "n", F.col("flags").bitwiseOR(1).bitwiseAND(~2).alias("flags"))


def merge(children: DataFrame, key: list[str]) -> DataFrame:
    """Parents of children (mu_m, sigma2_m2, n, flags) by the law of total variance (AGG11).

    Weights are counts, equal where all are zero; the least count is kept; derived and blind need all, dynamic one.
    """
    w = F.when(F.sum("n").over(_by(key)) > 0, F.col("n")).otherwise(1)
    c = children.withColumn("w", w)
    mean = c.groupBy(*key).agg(
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("mu_m")).alias("s1"), F.sum(F.col("w") * F.col("sigma2_m2")).alias("sv"),
        F.sum(F.col("w") * F.col("mu_m") * F.col("mu_m")).alias("s2"), F.min("n").alias("n"), F.bit_and(F.col("flags").bitwiseAND(5)).alias("fa"), F.bit_or(F.col("flags").bitwiseAND(8)).alias("fo"),
    )
    mu = F.col("s1") / F.col("sw")
    return mean.select(*key, mu.alias("mu_m"), (F.col("sv") / F.col("sw") + F.greatest(F.lit(0.0), F.col("s2") / F.col("sw") - mu * mu)).alias("sigma2_m2"), "n", F.col("fa").bitwiseOR(F.col("fo")).alias("flags"))


def _by(key: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*key)


def gate(dynamic: Column) -> Column:
    """Whether a cell asks for refinement: its class, something moving in it, or an uncertain edge (FLT8)."""
    edge = F.col("trav").bitwiseAND(6) != 0
    return F.col("cand").isin(T["refine"]) | dynamic | (edge & (variance_cm2(F.col("code").cast("int")) * 1e-4 > T["sigma2_max_m2"]))
