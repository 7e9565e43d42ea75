"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold import config as C
from terrafold.functions import lattice as L
from terrafold.operators import evalmap, fold, query, scatter
from terrafold.plans import oracle as O
from terrafold.sources.points import field, points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
S = C.load("5_10_20_40")


def register(sql: str | None = None):
    """Adds a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def binned(spark, sf_dir):
    return scatter.bin_points(points(spark, sf_dir), S)


def cells(spark, sf_dir):
    return scatter.scatter(binned(spark, sf_dir))


def state(spark, sf_dir):
    return fold.fold(cells(spark, sf_dir))


def probes(spark, sf_dir):
    """Query points: some anywhere around the last vehicle position, the others on all points of the last frame."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    at = lambda m: F.pmod(F.col("c_custkey") * m, F.lit(200000)) - 100000
    a = c.select(F.col("c_custkey").cast("bigint").alias("query_id"), (at(7919) + 2400).cast("bigint").alias("x_mm"), at(104729).cast("bigint").alias("y_mm"))
    p = points(spark, sf_dir).filter(F.col("frame") == 6)
    b = p.select((F.col("point_id") + 1000000000).alias("query_id"), F.col("xw_mm").alias("x_mm"), F.col("yw_mm").alias("y_mm"))
    return a.union(b).withColumns({"ego_x_mm": F.lit(2400).cast("bigint"), "ego_y_mm": F.lit(0).cast("bigint")})


def transient(spark, sf_dir, frame=6):
    return scatter.transient(binned(spark, sf_dir)).filter(F.col("frame") == frame).drop("frame")


def flagship(spark, sf_dir):
    """Points to cells to folded state to point lookups."""
    return query.lookup(probes(spark, sf_dir), state(spark, sf_dir), S, transient(spark, sf_dir))


@register(f"WITH {O.PTS} SELECT * FROM pts")
def src11_points(spark, sf_dir):
    """Points of all frames with their labels and ground flag."""
    return points(spark, sf_dir)


@register(f"WITH {O.BINNED} SELECT frame, point_id, ring, ix, iy FROM binned")
def lat08_bin_points(spark, sf_dir):
    return binned(spark, sf_dir).select("frame", "point_id", "ring", "ix", "iy")


@register(f"WITH {O.SCATTER} SELECT * FROM cells")
def agg01_scatter(spark, sf_dir):
    return cells(spark, sf_dir)


@register(f"WITH {O.SCATTER} SELECT frame, ring, ix, iy, {O.MEAN} AS mean_cm FROM cells WHERE w_sum > 0")
def agg03_mean_height(spark, sf_dir):
    """Only cells with ground evidence (FLT5)."""
    c = cells(spark, sf_dir).filter("w_sum > 0")
    return c.select("frame", "ring", "ix", "iy", scatter.mean_height_cm(F.col("wz_sum"), F.col("w_sum")).alias("mean_cm"))


@register(f"WITH {O.BINNED}{O.TRANSIENT} SELECT * FROM transient")
def agg04_transient(spark, sf_dir):
    return scatter.transient(binned(spark, sf_dir))


@register(f"""WITH {O.PTS} SELECT frame, i, j, round(sum(xw_mm) / count(*) / 1e3, 6) AS x_m, round(sum(yw_mm) / count(*) / 1e3, 6) AS y_m, max(z_cm) AS top_cm, arg_min(cls, point_id) AS cls
FROM (SELECT *, CAST(floor(xw_mm / 1e3) AS BIGINT) AS i, CAST(floor(yw_mm / 1e3) AS BIGINT) AS j FROM pts WHERE (raw_label & 65535) BETWEEN 250 AND 259) GROUP BY frame, i, j""")
def agg05_cluster(spark, sf_dir):
    c = scatter.cluster(points(spark, sf_dir).filter(scatter.moving(F.col("raw_label"))))
    return c.select("frame", "i", "j", F.round(F.col("sx") / F.col("n") / 1e3, 6).alias("x_m"), F.round(F.col("sy") / F.col("n") / 1e3, 6).alias("y_m"), "top_cm", "cls")


@register(f"WITH {O.FOLD} SELECT * FROM state")
def st01_fold(spark, sf_dir):
    """Height filter, ceiling, log-odds, class vote, reflectivity and counts of every cell over all frames (ST1-6)."""
    return state(spark, sf_dir)


@register(f"WITH {O.FOLD} SELECT ring, {O.OCC} AS occupancy, count(*) AS cells, min(mu) AS low_cm, max(mu) AS high_cm, CAST(sum(n) AS BIGINT) AS returns FROM state GROUP BY ring, {O.OCC}")
def flt04_occupancy(spark, sf_dir):
    s = state(spark, sf_dir).withColumn("occupancy", fold.occupancy(F.col("n"), F.col("odds")))
    return s.groupBy("ring", "occupancy").agg(F.count("*").alias("cells"), F.min("mu").alias("low_cm"), F.max("mu").alias("high_cm"), F.sum("n").alias("returns"))


@register(f"""WITH {O.FOLD}{O.TRANSIENT}{O.PROBES},
q AS (SELECT *, CASE WHEN m < 10000 THEN 0 WHEN m < 25000 THEN 1 WHEN m < 50000 THEN 2 WHEN m < 100000 THEN 3 END AS ring
      FROM (SELECT *, greatest(abs(x_mm - ego_x_mm), abs(y_mm - ego_y_mm)) AS m FROM probes)),
k AS (SELECT *, CAST(floor(x_mm / (50.0 * power(2, ring))) AS BIGINT) AS ix, CAST(floor(y_mm / (50.0 * power(2, ring))) AS BIGINT) AS iy FROM q)
SELECT query_id, k.ring AS ring, CAST(coalesce(t.top_cm, s.mu) AS INT) AS ground_cm, CASE WHEN s.ceil < 32767 THEN s.ceil END AS ceiling_cm, s.cand AS cls,
       coalesce(s.n, 0) AS confidence, CASE WHEN t.top_cm IS NOT NULL THEN 2 WHEN s.n IS NULL OR s.n < 1 THEN 0 WHEN s.odds > 0 THEN 2 ELSE 1 END AS occupancy, t.top_cm IS NOT NULL AS dynamic
FROM k LEFT JOIN state s ON s.ring = k.ring AND s.ix = k.ix AND s.iy = k.iy LEFT JOIN (SELECT * FROM transient WHERE frame = 6) t ON t.ring = k.ring AND t.ix = k.ix AND t.iy = k.iy""")
def qry01_lookup(spark, sf_dir):
    return flagship(spark, sf_dir)


@register(f"""WITH {O.FOLD} SELECT ring, ix, iy, ix * (50 * (1 << ring)) + 25 * (1 << ring) AS x_mm, iy * (50 * (1 << ring)) + 25 * (1 << ring) AS y_mm, {O.OCC} AS occupancy FROM state""")
def qry06_layers(spark, sf_dir):
    return query.layers(state(spark, sf_dir), S)


WINDOWS = [(r.ring, *((2400 // (L.mm(r.cell_m))) - S.side(r.ring) // 2, -(S.side(r.ring) // 2)), S.side(r.ring)) for r in S.rings]


@register(f"""WITH {O.FOLD}, w(ring, x0, y0, side) AS (VALUES {', '.join(map(str, WINDOWS))})
SELECT s.* FROM state s JOIN w USING (ring) WHERE ix >= x0 AND ix < x0 + side AND iy >= y0 AND iy < y0 + side""")
def lat17_evict(spark, sf_dir):
    """State cells inside the windows around the last vehicle position (LAT16, LAT17)."""
    return query.evict(state(spark, sf_dir), spark.createDataFrame(WINDOWS, "ring int, x0 int, y0 int, side int"))


REF = """, fine AS (
  SELECT i, j, frame, CAST(sum(z_cm) AS BIGINT) AS sz, count(*) AS n, arg_max(cls, point_id) AS cls
  FROM (SELECT *, CAST(floor(xw_mm / 50e0) AS BIGINT) AS i, CAST(floor(yw_mm / 50e0) AS BIGINT) AS j FROM pts) GROUP BY i, j, frame),
ref AS (SELECT i, j, CAST(sum(sz) AS BIGINT) AS sz, CAST(sum(n) AS BIGINT) AS n, coalesce(arg_min(cls, frame) FILTER (cls <> 0), 0) AS cls FROM fine GROUP BY i, j),
lv(ring, k) AS (VALUES (0, 1), (1, 2), (2, 4), (3, 8)),
fc AS (SELECT ring, CAST(floor(i / CAST(k AS DOUBLE)) AS BIGINT) AS ix, CAST(floor(j / CAST(k AS DOUBLE)) AS BIGINT) AS iy, sz / CAST(n AS DOUBLE) AS m, cls FROM ref, lv),
pc AS (SELECT ring, ix, iy, cls, count(*) AS c FROM fc GROUP BY ring, ix, iy, cls),
bc AS (SELECT ring, ix, iy, arg_max(cls, c * 100 - cls) AS cls_ref FROM pc GROUP BY ring, ix, iy),
bm AS (SELECT ring, ix, iy, count(*) AS n_ref, avg(m) AS mean_ref, var_pop(m) AS var_ref FROM fc GROUP BY ring, ix, iy),
blocks AS (SELECT * FROM bm JOIN bc USING (ring, ix, iy))"""


@register(f"WITH {O.PTS}{REF} SELECT * FROM ref")
def agg08_reference(spark, sf_dir):
    return evalmap.reference(points(spark, sf_dir))


@register(f"WITH {O.PTS}{REF} SELECT ring, ix, iy, n_ref, round(mean_ref, 4) AS mean_ref, round(var_ref, 4) AS var_ref, cls_ref FROM blocks")
def agg09_blocks(spark, sf_dir):
    b = evalmap.blocks(evalmap.reference(points(spark, sf_dir)), S)
    return b.select("ring", "ix", "iy", "n_ref", F.round("mean_ref", 4).alias("mean_ref"), F.round("var_ref", 4).alias("var_ref"), "cls_ref")


@register(f"""WITH {O.FOLD}{REF},
c AS (SELECT s.ring AS ring, s.mu - b.mean_ref AS err, n_ref, var_ref FROM state s JOIN blocks b ON b.ring = s.ring AND b.ix = s.ix AND b.iy = s.iy WHERE s.n > 0 AND s.code > 0 AND s.mu > -200 AND s.mu < 600),
g AS (SELECT ring, count(*) AS cells, sqrt(avg(err * err)) AS rmse, sqrt(avg(err * err + var_ref) FILTER (n_ref > 1)) AS il, sqrt(avg(var_ref) FILTER (n_ref > 1)) AS spread,
        avg(err) FILTER (n_ref > 1) AS bias, avg(CAST(err > 0 AS INT)) FILTER (n_ref > 1) AS above, count(*) FILTER (n_ref > 1) AS usable, median(n_ref / CAST(1 << (2 * ring) AS DOUBLE)) AS coverage FROM c GROUP BY ring)
SELECT ring, cells, round(rmse, 4) AS rmse_cm, round(il, 4) AS il_cm, round(spread, 4) AS spread_cm, round(bias, 4) AS bias_cm, round(above, 4) AS above, usable, round(coverage, 6) AS coverage,
       round(CASE WHEN spread > 1e-9 THEN il / spread END, 4) AS rho FROM g""")
def agg15_scores(spark, sf_dir):
    """Error, information loss and coarsening ratio per ring (AGG15, AGG16, AGG19)."""
    b = evalmap.blocks(evalmap.reference(points(spark, sf_dir)), S)
    s = evalmap.scores(evalmap.compared(state(spark, sf_dir), b), S)
    r = lambda c, n=4: F.round(c, n).alias(c)
    return s.select("ring", "cells", r("rmse_cm"), r("il_cm"), r("spread_cm"), r("bias_cm"), r("above"), "usable", r("coverage", 6), r("rho"))


@register(f"""WITH {O.FOLD}{REF},
j AS (SELECT coalesce(s.ring, b.ring) AS ring, b.n_ref IS NOT NULL AS truth, coalesce({O.OCC.replace('n <', 's.n <').replace('odds', 's.odds')} = 2 AND s.n IS NOT NULL, false) AS mine, coalesce(s.n, 0) AS n
      FROM state s FULL JOIN blocks b ON b.ring = s.ring AND b.ix = s.ix AND b.iy = s.iy)
SELECT ring, count(*) FILTER (mine AND truth) AS both, count(*) FILTER (mine OR truth) AS either, count(*) FILTER (truth AND n > 0) AS filled, count(*) FILTER (truth) AS blocks, count(*) FILTER (n = 255) AS saturated,
       round(count(*) FILTER (mine AND truth) / CAST(count(*) FILTER (mine OR truth) AS DOUBLE), 6) AS iou, round(count(*) FILTER (truth AND n > 0) / CAST(count(*) FILTER (truth) AS DOUBLE), 6) AS fill FROM j GROUP BY ring""")
def agg17_overlap(spark, sf_dir):
    """Occupancy overlap, fill rate and saturation per ring (AGG17, AGG18)."""
    b = evalmap.blocks(evalmap.reference(points(spark, sf_dir)), S)
    o = evalmap.overlap(state(spark, sf_dir), b)
    return o.withColumn("iou", F.round("iou", 6)).withColumn("fill", F.round("fill", 6))


from terrafold.plans import queries_engine, queries_image, queries_lattice, queries_map, queries_more, queries_plan  # noqa: E402, F401
