"""Queries on cost maps and paths, and on schedules as data."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold import config as C
from terrafold.operators import evalmap, plan
from terrafold.plans import oracle as O
from terrafold.plans.queries_map import _bits, bits
from terrafold.plans.registry import SQL, points, register
from terrafold.sources.points import SIDE

START, GOAL = (2, 2), (SIDE // 2 - 3, SIDE // 2 - 3)
COSTS = f"""{_bits()}, pc AS (
  SELECT tile, ix >> 1 AS i, iy >> 1 AS j, CAST(sum(n) AS BIGINT) AS n, sum(n * ground_cm) / CAST(sum(n) AS DOUBLE) AS z_cm, sum(n * ground_cm * ground_cm) / CAST(sum(n) AS DOUBLE) AS sq,
         arg_max(cand, n * 10000 - ix * 100 - iy) AS cls, bit_or(trav & 24) AS soft
  FROM bits WHERE n >= 1 GROUP BY tile, ix >> 1, iy >> 1),
pm AS (SELECT *, sq - z_cm * z_cm AS var_cm2 FROM pc)"""


@register(f"WITH {COSTS} SELECT tile, i, j, n, round(z_cm, 6) AS z_cm, round(var_cm2, 4) AS var_cm2, cls, soft FROM pm")
def qry07_costmap(spark, sf_dir):
    """Planning cells gathered from map cells (QRY7, JN14)."""
    c = plan.costmap(bits(spark, sf_dir), 2)
    return c.withColumn("z_cm", F.round("z_cm", 6)).withColumn("var_cm2", F.round("var_cm2", 4))


def _weight(trav: str, unknown: str) -> str:
    return f"CASE WHEN ({trav} & 7) = 0 THEN 1e0 + CASE WHEN ({trav} & 8) <> 0 THEN 2e0 ELSE 0e0 END + CASE WHEN ({trav} & 16) <> 0 THEN 3e0 ELSE 0e0 END + CASE WHEN {unknown} OR ({trav} & 32) <> 0 THEN 4e0 ELSE 0e0 END END"


@register(f"WITH {_bits()} SELECT tile, ix, iy, {_weight('trav', 'n < 1')} AS cost, n < 1 AS unknown FROM bits")
def qry09_weights(spark, sf_dir):
    """Weights of cells, null where blocked (QRY9, FLT11)."""
    return bits(spark, sf_dir).select("tile", "ix", "iy", plan.cost(F.col("trav"), F.col("n") < 1).alias("cost"), (F.col("n") < 1).alias("unknown"))


def costs(spark, sf_dir, step_blocks=True):
    b = bits(spark, sf_dir)
    trav = F.col("trav") if step_blocks else F.col("trav").bitwiseAND(~7)
    return b.select("tile", F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), plan.cost(trav.bitwiseAND(~1), F.col("n") < 1).alias("cost"), (F.col("n") < 1).alias("unknown"))




@register()
def qry10_plan(spark, sf_dir):
    """Cheapest paths on each tile (QRY10)."""
    return plan.plan(costs(spark, sf_dir), START, GOAL).withColumn("cost", F.round("cost", 6)).drop("path")


@register()
def qry12_corridor(spark, sf_dir):
    """Cells within tau of the best path (QRY11, QRY12)."""
    return plan.corridor(costs(spark, sf_dir), START, GOAL).withColumn("slack", F.round("slack", 6))


@register()
def qry13_regret(spark, sf_dir):
    """What it costs to plan on a map without steps and slopes (QRY13, WF9)."""
    r = plan.regret(costs(spark, sf_dir, False), costs(spark, sf_dir), START, GOAL)
    return r.withColumn("regret", F.round("regret", 6)).withColumn("best", F.round("best", 6)).withColumn("path_cost", F.round("path_cost", 6))


@register()
def qry15_frechet(spark, sf_dir):
    """Distance between paths planned on two maps (QRY15, JN18)."""
    a, b = plan.plan(costs(spark, sf_dir), START, GOAL), plan.plan(costs(spark, sf_dir, False), START, GOAL)
    return plan.frechet_of(a, b).withColumn("frechet_m", F.round("frechet_m", 6))


@register(f"WITH {_bits()} SELECT a.tile AS tile, a.ix AS ix, a.iy AS iy FROM bits a JOIN bits b USING (tile, ix, iy) WHERE a.n >= 1 AND b.n >= 2 AND (b.trav & 32) = 0")
def qry14_common_support(spark, sf_dir):
    """Cells that every map knows (QRY14, JN16, SET2)."""
    b = bits(spark, sf_dir)
    one = b.select("tile", "ix", "iy", (F.col("n") < 1).alias("unknown"))
    two = b.select("tile", "ix", "iy", ((F.col("n") < 2) | (F.col("trav").bitwiseAND(32) != 0)).alias("unknown"))
    return plan.common_support([one, two])


SCHEDULES = [("5_10_20_40", 0, 10000, 50), ("5_10_20_40", 1, 25000, 100), ("5_10_20_40", 2, 50000, 200), ("5_10_20_40", 3, 100000, 400), ("5_10_50", 0, 10000, 50), ("5_10_50", 1, 25000, 100), ("5_10_50", 2, 100000, 500), ("u20", 0, 100000, 200), ("u80", 0, 100000, 800)]


@register(f"""WITH {O.PTS}, r(schedule, ring, half, cell) AS (VALUES {', '.join(map(str, SCHEDULES))}),
a AS (SELECT schedule, frame, point_id, z_cm, xw_mm, yw_mm, arg_min(cell, ring) AS cell, min(ring) AS ring FROM pts, r WHERE greatest(abs(xv_mm), abs(yv_mm)) < half GROUP BY ALL),
c AS (SELECT schedule, ring, CAST(floor(xw_mm / CAST(cell AS DOUBLE)) AS BIGINT) AS ix, CAST(floor(yw_mm / CAST(cell AS DOUBLE)) AS BIGINT) AS iy, count(*) AS n, sum(z_cm) AS s, sum(z_cm * z_cm) AS q FROM a GROUP BY 1, 2, 3, 4)
SELECT schedule, count(*) AS cells, CAST(sum(n) AS BIGINT) AS returns, round(sqrt(CAST(sum(q) - sum(s * s / CAST(n AS DOUBLE)) AS DOUBLE) / sum(n)), 4) AS within_cm, CAST(max(n) AS BIGINT) AS fullest FROM c GROUP BY schedule""")
def qry17_ablation(spark, sf_dir):
    """All schedules in one job, the schedule as a column (QRY17, EXT15): cells, spread of heights inside them."""
    p = points(spark, sf_dir).select("point_id", "z_cm", "xw_mm", "yw_mm", F.greatest(F.abs("xv_mm"), F.abs("yv_mm")).alias("m"))
    names = list(dict.fromkeys(s for s, *_ in SCHEDULES))
    cell = lambda n: F.coalesce(*(F.when(F.col("m") < half, F.struct(F.lit(n).alias("schedule"), F.lit(ring).alias("ring"), F.lit(c).alias("cell"))) for s, ring, half, c in SCHEDULES if s == n))
    a = p.withColumn("r", F.explode(F.array(*map(cell, names)))).filter("r IS NOT NULL").select("z_cm", "xw_mm", "yw_mm", "r.*")
    g = a.groupBy("schedule", "ring", F.floor(F.col("xw_mm") / F.col("cell")).alias("ix"), F.floor(F.col("yw_mm") / F.col("cell")).alias("iy")).agg(F.count("*").alias("n"), F.sum("z_cm").alias("s"), F.sum(F.col("z_cm") * F.col("z_cm")).alias("q"))
    within = F.sqrt((F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))) / F.sum("n"))
    return g.groupBy("schedule").agg(F.count("*").alias("cells"), F.sum("n").alias("returns"), F.round(within, 4).alias("within_cm"), F.max("n").alias("fullest"))


@register(f"""WITH q AS ({SQL['qry17_ablation']}), r AS (SELECT schedule, round(cells * 12 / 1e6, 6) AS mb, within_cm FROM q)
SELECT *, coalesce(within_cm > lag(within_cm) OVER (ORDER BY mb DESC, schedule), false) AS worse FROM r""")
def agg29_monotonicity(spark, sf_dir):
    """Schedules by the memory of their cells, with those that do worse than the next larger one (AGG29)."""
    r = qry17_ablation(spark, sf_dir).select("schedule", F.round(F.col("cells") * 12 / 1e6, 6).alias("mb"), "within_cm")
    return evalmap.monotonicity(r, "mb", "within_cm", "schedule")


def thresholds_digest() -> str:
    return C.digest()


