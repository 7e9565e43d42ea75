"""Queries for the rest of the inventory: model inputs, checks, exports, scores of labels, scene."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terrafold import api
from terrafold import config as C
from terrafold.operators import evalmap, fold
from terrafold.operators.scatter import moving
from terrafold.plans import oracle as O
from terrafold.plans.queries_image import SENSED, projected, sensed
from terrafold.plans.queries_lattice import XYV, metres
from terrafold.plans.registry import REF, S, binned, points, register, state
from terrafold.sources import synthetic

d = O.d


@register(f"""WITH {SENSED} SELECT frame, v, u, round(r / 100, 6) AS range, round(x / 100, 6) AS x, round(y / 100, 6) AS y, round(z / 100, 6) AS z, round(greatest(0e0, least(1e0, refl / 255e0)), 6) AS intensity FROM img""")
def tx07_model_input(spark, sf_dir):
    """Pixels scaled for a model: metres over 100, intensity over 255 and clipped (TX7)."""
    r = lambda c, n: F.round(c, 6).alias(n)
    i = projected(spark, sf_dir)
    return i.select("frame", "v", "u", r(F.col("r") / 100, "range"), *(r(F.col(c) / 100, c) for c in "xyz"), r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("refl") / 255.0)), "intensity"))


FOV = math.radians(2.0) - math.radians(-24.8)


@register(f"""WITH {SENSED} SELECT frame, point_id, CAST(greatest(0, least(511, floor(0.5e0 * (1 - atan2(y, x) / pi()) * 512))) AS INT) AS col,
 CAST(greatest(0, least(63, floor((1 - (asin(z / r) + abs(radians(CAST('-24.8' AS DOUBLE)))) / {d(FOV)}) * 64))) AS INT) AS row FROM pp WHERE r > 1e-6""")
def tx23_frustum(spark, sf_dir):
    """Column and row of a point in a model's frustum grid (TX23)."""
    p = sensed(spark, sf_dir).withColumn("r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).filter("r > 1e-6")
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c))).cast("int")
    col = 0.5 * (1 - F.atan2("y", "x") / math.pi) * 512
    row = (1 - (F.asin(F.col("z") / F.col("r")) + abs(math.radians(-24.8))) / FOV) * 64
    return p.select("frame", "point_id", clip(col, 512).alias("col"), clip(row, 64).alias("row"))


@register(f"""WITH {O.BINNED}, p AS (SELECT cls AS gt, CASE WHEN refl % 5 = 0 THEN (cls + 1) % 19 ELSE cls END AS pred FROM binned),
c AS (SELECT unnest(range(0, 19)) AS cls), s AS (SELECT cls, count(*) FILTER (gt = cls AND pred = cls) AS inter, count(*) FILTER (gt = cls OR pred = cls) AS either, count(*) FILTER (gt = cls) AS support FROM c, p GROUP BY cls)
SELECT cls, inter, either, support, round(inter / CAST(either AS DOUBLE), 6) AS iou FROM s WHERE either > 0""")
def agg23_iou(spark, sf_dir):
    """Overlap of predicted and true classes (AGG23): each point counts for one or two classes, in one pass."""
    p = binned(spark, sf_dir).filter("cls >= 0").select(F.col("cls").alias("gt"), F.when(F.col("refl") % 5 == 0, (F.col("cls") + 1) % 19).otherwise(F.col("cls")).alias("pred"))
    e = p.select("gt", "pred", F.explode(F.array_distinct(F.array("gt", "pred"))).alias("cls"))
    g = e.groupBy(F.col("cls").cast("bigint").alias("cls")).agg(F.count_if(F.col("gt") == F.col("pred")).alias("inter"), F.count("*").alias("either"), F.count_if(F.col("gt") == F.col("cls")).alias("support"))
    return g.withColumn("iou", F.round(F.col("inter") / F.col("either"), 6))


@register(f"WITH {SENSED} SELECT frame, v, u // 8 AS f, max(refl) AS top, arg_max(point_id, refl * CAST(100000000000000000 AS HUGEINT) - point_id) AS top_id, round(CAST(sum(refl) AS DOUBLE) / count(*), 6) AS mean, min(z_mm) AS low FROM (SELECT *, CAST(round_even(z * 1000, 0) AS BIGINT) AS z_mm FROM pv) GROUP BY frame, v, u // 8")
def agg24_frustum_pool(spark, sf_dir):
    """Largest feature, whose it is, and mean of each frustum (AGG24, EXT9)."""
    from terrafold.operators.image import with_pixel

    p = with_pixel(sensed(spark, sf_dir)).groupBy("frame", "v", F.floor(F.col("u") / 8).cast("int").alias("f"))
    return p.agg(F.max("refl").alias("top"), F.max_by("point_id", F.struct("refl", -F.col("point_id"))).alias("top_id"), F.round(F.sum("refl") / F.count("*"), 6).alias("mean"), F.min(F.rint(F.col("z") * 1000).cast("bigint")).alias("low"))


@register(f"""WITH {O.FOLD}{REF}, c AS (SELECT s.ring AS ring, s.mu - b.mean_ref AS err, n_ref, var_ref FROM state s JOIN blocks b ON b.ring = s.ring AND b.ix = s.ix AND b.iy = s.iy WHERE s.n > 0 AND s.code > 0 AND s.mu > -200 AND s.mu < 600),
g AS (SELECT ring, sqrt(avg(err * err)) AS rmse, sqrt(avg(err * err + var_ref) FILTER (n_ref > 1)) AS il, sqrt(avg(var_ref) FILTER (n_ref > 1)) AS spread FROM c GROUP BY ring)
SELECT '5_10_20_40' AS schedule, CAST(8.94e0 AS DOUBLE) AS mb, round(max(rmse), 4) AS worst_rmse_cm, round(avg(CASE WHEN spread > 1e-9 THEN il / spread END), 4) AS mean_rho FROM g""")
def agg31_summary_row(spark, sf_dir):
    """One row a schedule: memory, worst ring, mean coarsening ratio (AGG31)."""
    b = evalmap.blocks(evalmap.reference(points(spark, sf_dir)), S)
    s = evalmap.scores(evalmap.compared(state(spark, sf_dir), b), S)
    return s.agg(F.lit("5_10_20_40").alias("schedule"), F.lit(round(S.total_cells * 12 / 1e6, 2)).alias("mb"), F.round(F.max("rmse_cm"), 4).alias("worst_rmse_cm"), F.round(F.avg("rho"), 4).alias("mean_rho"))


@register(f"""WITH {O.PTS} SELECT frame, median(z_cm) FILTER (g = 1) AS ground_cm, abs(median(z_cm) FILTER (g = 1)) <= 200 AS upright, count(*) FILTER (g = 1) AS returns FROM pts GROUP BY frame""")
def flt13_upright(spark, sf_dir):
    """Whether a frame's ground lies near zero, as it does if up is up (FLT13)."""
    z = F.median(F.when(F.col("g") == 1, F.col("z_cm")))
    return points(spark, sf_dir).groupBy("frame").agg(z.alias("ground_cm"), (F.abs(z) <= 200).alias("upright"), F.count_if(F.col("g") == 1).alias("returns"))


#: The cap on point ids of LIM2; below it lie the first 5,000 orders or so.
MAX_POINT = 5_000_000_000


@register(f"""WITH {O.BINNED} SELECT frame, count(*) FILTER (abs(yv_mm) < 1500 AND xv_mm BETWEEN 5000 AND 40000) AS in_lane, count(*) FILTER ((raw_label & 65535) NOT BETWEEN 250 AND 259) AS shown,
 count(*) FILTER (point_id < {MAX_POINT}) AS within_cap FROM binned GROUP BY frame""")
def flt14_strips(spark, sf_dir):
    """Points in a lane strip, points shown without moving ones, points under a cap (FLT14, FLT15, LIM2)."""
    b = binned(spark, sf_dir)
    lane = (F.abs("yv_mm") < 1500) & F.col("xv_mm").between(5000, 40000)
    return b.groupBy("frame").agg(F.count_if(lane).alias("in_lane"), F.count_if(~moving(F.col("raw_label"))).alias("shown"), F.count_if(F.col("point_id") < MAX_POINT).alias("within_cap"))


@register(f"WITH {O.FOLD} SELECT ring, ix, iy FROM state WHERE {O.OCC} = 2 ORDER BY ring, iy, ix LIMIT 1000")
def lim01_candidates(spark, sf_dir):
    """The first candidates in slot order, a cap that is part of the operator (LIM1)."""
    s = state(spark, sf_dir).filter(fold.occupancy(F.col("n"), F.col("odds")) == 2)
    return s.select("ring", "ix", "iy").orderBy("ring", "iy", "ix").limit(1000)


@register(f"""WITH {O.FOLD}, c AS (SELECT *, 50 << ring AS size, CASE WHEN ring = 3 THEN 2 ELSE 1 END AS k FROM state),
e AS (SELECT ring, ix, iy, mu, CAST(floor(ix * size / 200e0) AS BIGINT) + dx AS gx, CAST(floor(iy * size / 200e0) AS BIGINT) + dy AS gy FROM c, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy) WHERE dx < k AND dy < k)
SELECT gx, gy, arg_min(mu, ring * CAST(1000000000000 AS BIGINT) + (ix + 100000) * 1000000 + iy + 100000) AS ground_cm, min(ring) AS ring FROM e WHERE abs(gx * 200) < 40000 AND abs(gy * 200) < 40000 GROUP BY gx, gy""")
def snk03_export_grid(spark, sf_dir):
    """Heights on a uniform 20 cm grid (SNK3)."""
    return api.export_grid(state(spark, sf_dir), S, 200, 40000)


@register(f"WITH {O.PTS}, v AS (SELECT DISTINCT CAST(floor((xv_mm + 100000) / 200e0) AS BIGINT) AS i, CAST(floor((yv_mm + 100000) / 200e0) AS BIGINT) AS j, (z_cm + 208) // 20 AS k FROM pts) SELECT (i * 1000 + j) * 60 + k AS voxel, i * 200 - 99900 AS x_mm, j * 200 - 99900 AS y_mm, k * 20 - 198 AS z_cm FROM v")
def ext01_dense_voxels(spark, sf_dir):
    """Occupied voxels of a dense grid, their flat index and centre (EXT1)."""
    p = points(spark, sf_dir).select(F.floor((F.col("xv_mm") + 100000) / 200).alias("i"), F.floor((F.col("yv_mm") + 100000) / 200).alias("j"), F.expr("(z_cm + 208) div 20").alias("k")).distinct()
    return p.select(((F.col("i") * 1000 + F.col("j")) * 60 + F.col("k")).alias("voxel"), (F.col("i") * 200 - 99900).alias("x_mm"), (F.col("j") * 200 - 99900).alias("y_mm"), (F.col("k") * 20 - 198).alias("z_cm"))


HEIGHT = f"""(0e0 - {d(0.02)} * least(abs(y), 3e0) * least(abs(y), 3e0) / 3e0 + CASE WHEN abs(y) > 3 THEN {d(0.12)} ELSE 0e0 END + CASE WHEN x > 30 THEN {d(0.06)} * (x - 30) ELSE 0e0 END
 + CASE WHEN abs(y) > 4 THEN {d(0.02)} * (sin({d(12.7)} * x + 0) * cos({d(11.3)} * y - 0)) ELSE 0e0 END - CASE WHEN sqrt((x - 18) * (x - 18) + y * y) < {d(0.3)} THEN {d(0.4)} ELSE 0e0 END)"""


@register(f"WITH {O.PTS}, {XYV} SELECT frame, point_id, round({HEIGHT}, 6) + 0e0 AS height_m, CASE WHEN abs(y) <= 3 THEN 40 WHEN abs(y) <= 4 THEN 48 ELSE 44 END AS raw FROM xyv")
def src13_terrain(spark, sf_dir):
    """Height and class of the analytic scene at points (SRC13)."""
    m = metres(spark, sf_dir)
    return m.select("frame", "point_id", F.round(synthetic.height(F.col("x"), F.col("y")), 6).alias("height_m"), synthetic.raw_class(F.col("y")).alias("raw"))


def _u(i: str, stream: int) -> str:
    return f"((({i}) * CAST({synthetic.STREAMS[stream]} AS BIGINT) + {(stream + 1) * 40503} * (seed + 1)) % 4294967296) / 4294967296e0"


def _in(i: str, k: int, lo: float, hi: float) -> str:
    return f"({d(lo)} + ({d(hi)} - {d(lo)}) * ({_u(i, k)}))"


_sides = [f"SELECT {raw} AS raw_label, seed, i AS solid_id, {_in('i', 0, *x)} AS x, {'CASE WHEN ' + _u('i', 3) + ' < 0.5 THEN -1e0 ELSE 1e0 END * ' if two else ''}{_in('i', 1, *y)} AS y, {_in('i', 2, *z)} AS z FROM (SELECT unnest(range(0, {n})) AS i) t, sd" for raw, n, x, y, z, two in synthetic.SOLIDS]
_half = lambda k, half: f"(2 * ({_u('i', k)}) - 1) * {d(half)}"


@register(f"""WITH sd AS (SELECT unnest(range(0, 3)) AS seed), st AS ({' UNION ALL '.join(_sides)} UNION ALL
SELECT {synthetic.PERSON}, seed, i, {_in('i // 24', 4, *synthetic.CROWD_X)} + {_half(0, 0.25)}, {_in('i // 24', 5, *synthetic.CROWD_Y)} + {_half(1, 0.25)}, 1.8e0 * ({_u('i', 2)}) FROM (SELECT unnest(range(0, 1200)) AS i) t, sd),
fv AS (SELECT * FROM st WHERE degrees(atan2(z - CAST('1.73' AS DOUBLE), sqrt(x * x + y * y))) BETWEEN CAST('-24.8' AS DOUBLE) AND 2e0 AND sqrt(x * x + y * y) > 1e0
 UNION ALL SELECT {synthetic.CAR}, seed, i, 12e0 + 0.5e0 * seed + {_half(0, 2.0)}, {_half(1, 1.0)}, 1.5e0 * ({_u('i', 2)}) FROM (SELECT unnest(range(0, 400)) AS i) t, sd)
SELECT CAST(seed AS INT) AS frame, raw_label, solid_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM fv""")
def src12_solids(spark, sf_dir):
    """Facades, poles, signs, trees, fifty people and a car in three frames of the scene (SRC12)."""
    three = [synthetic.solids(spark, f, f, crowd=50, car=True) for f in range(3)]
    return three[0].union(three[1]).union(three[2]).withColumns({c: F.round(c, 6) for c in "xyz"})


@register()
def src12_sweep(spark, sf_dir):
    """A sweep over the analytic scene (SRC12); hits lie on the ground along their beams, as the tests check."""
    return synthetic.sweep(spark, 3).withColumns({c: F.round(c, 6) for c in "xyz"})


@register(f"""WITH {O.PTS}{REF}, p AS (SELECT CAST(floor(i / 5e0) AS BIGINT) AS i, CAST(floor(j / 5e0) AS BIGINT) AS j, sz / CAST(n AS DOUBLE) AS m, cls FROM ref),
c AS (SELECT i, j, cls, count(*) AS c FROM p GROUP BY i, j, cls), t AS (SELECT i, j, arg_max(cls, c * 100 - cls) AS cls FROM c GROUP BY i, j), g AS (SELECT i, j, count(*) AS n, avg(m) AS z_cm, var_pop(m) AS v FROM p GROUP BY i, j)
SELECT i, j, n, round(z_cm, 4) AS z_cm, CAST(CASE WHEN v / 10000 > 0.0025 THEN 8 ELSE 0 END + CASE WHEN cls IN (8, 9, 10, 11, 16) THEN 0 ELSE 16 END + CASE WHEN n < 3 THEN 32 ELSE 0 END AS INT) AS trav FROM g JOIN t USING (i, j)""")
def qry08_reference_costs(spark, sf_dir):
    """Planning cells of the reference map: height, spread, class and the bits that don't need neighbours (QRY8)."""
    ref = evalmap.reference(points(spark, sf_dir)).withColumn("m", F.col("sz") / F.col("n"))
    p = ref.select(F.floor(F.col("i") / 5).alias("i"), F.floor(F.col("j") / 5).alias("j"), "m", "cls")
    c = p.groupBy("i", "j", "cls").agg(F.count("*").alias("c"), F.sum("m").alias("s1"), F.sum(F.col("m") * F.col("m")).alias("s2"))
    g = c.groupBy("i", "j").agg(F.sum("c").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.max_by("cls", F.struct("c", -F.col("cls"))).alias("cls"))
    z = F.col("s1") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - z * z) / 10000
    bit = lambda cond, b: F.when(cond, b).otherwise(0)
    trav = bit(F.round(var, 9) > 0.0025, 8) + bit(~F.col("cls").isin(C.THRESHOLDS["drivable"]), 16) + bit(F.col("n") < 3, 32)
    return g.select("i", "j", "n", F.round(z, 4).alias("z_cm"), trav.cast("int").alias("trav"))


@register(f"WITH {O.FOLD} SELECT ring, count(*) FILTER (n >= 255) AS saturated, count(*) FILTER (cnt = 0) AS undecided, count(*) FILTER (ceil < 32767) AS covered, round(avg(CAST(n >= 3 AS INT)), 6) AS evident FROM state GROUP BY ring")
def viz03_layer_counts(spark, sf_dir):
    """What a viewer's layers would hold per ring (VIZ2-4, EXT5, AGG18)."""
    return state(spark, sf_dir).groupBy("ring").agg(F.count_if(F.col("n") >= 255).alias("saturated"), F.count_if(F.col("cnt") == 0).alias("undecided"), F.count_if(F.col("ceil") < 32767).alias("covered"), F.round(F.avg((F.col("n") >= 3).cast("int")), 6).alias("evident"))


@register(f"""WITH {O.SCATTER}, t AS (SELECT ring, ix, iy, count(*) AS frames, max(frame) AS last FROM cells GROUP BY ring, ix, iy) SELECT CASE WHEN 6 - last > 3 THEN 'stale' ELSE 'fresh' END AS age, last, count(*) AS cells, CAST(sum(frames) AS BIGINT) AS visits FROM t GROUP BY ALL""")
def st11_freshness(spark, sf_dir):
    """Cells by the frame that saw them last (frames_since_seen)."""


    from terrafold.plans.registry import cells

    t = cells(spark, sf_dir).groupBy("ring", "ix", "iy").agg(F.count("*").alias("frames"), F.max("frame").alias("last"))
    return t.groupBy(F.when(6 - F.col("last") > 3, "stale").otherwise("fresh").alias("age"), "last").agg(F.count("*").alias("cells"), F.sum("frames").alias("visits"))
