"""Queries on keys, codecs and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold import config as C
from terrafold.functions import lattice as L
from terrafold.functions import sensor
from terrafold.operators import fold
from terrafold.plans import oracle as O
from terrafold.plans.registry import S, binned, points, register, state

d = O.d
X, Y = "(xv_mm / 1000e0)", "(yv_mm / 1000e0)"
SPEED = "CAST(refl % 4 * 5 AS DOUBLE)"


def metres(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("frame", "point_id", (F.col("xv_mm") / 1000.0).alias("x"), (F.col("yv_mm") / 1000.0).alias("y"), (F.col("z_cm") / 100.0).alias("z"), (F.col("refl") % 4 * 5).cast("double").alias("speed"), "cls", "g", "refl", "raw_label")


def _ratio(v: str) -> str:
    return f"({v} / 15e0)"


A_F = f"least(2e0, greatest(1e0, 1e0 + 1e0 * {_ratio('v')}))"
A_S = f"(1e0 / (1e0 + {d(0.5)} * {_ratio('v')}))"
D_ANISO = f"greatest(greatest(x, 0e0) / {A_F}, greatest(-x, 0e0) / 1e0, abs(y) / {A_S})"
COUNT = lambda e: f"(CAST({e} >= 10 AS INT) + CAST({e} >= 25 AS INT) + CAST({e} >= 50 AS INT) + CAST({e} >= 100 AS INT))"
XYV = f"xyv AS (SELECT frame, point_id, {X} AS x, {Y} AS y, z_cm / 100e0 AS z, {SPEED} AS v, cls, g, refl, raw_label FROM pts), da AS (SELECT *, {D_ANISO} AS da, greatest(abs(x), abs(y)) AS cheb FROM xyv)"
RING_OF = f"""ro AS (SELECT *, CASE WHEN {COUNT('cheb')} > 3 THEN -1
   WHEN x < 0 AND abs(x) < 50 AND {COUNT('cheb')} <= 2 THEN least(greatest({COUNT('da')}, {COUNT('cheb')}), 2) ELSE least(greatest({COUNT('da')}, {COUNT('cheb')}), 3) END AS ring FROM da)"""


@register(f"""WITH {O.PTS}, a AS (SELECT frame, point_id, {X} AS x, {d(0.05)} AS c FROM pts),
m AS (SELECT *, CASE WHEN x % c < 0 THEN x % c + c ELSE x % c END AS m FROM a), q AS (SELECT *, (x - m) / c AS q FROM m)
SELECT frame, point_id, CAST(floor(q) + CASE WHEN q - floor(q) > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS i FROM q""")
def lat01_i_fine(spark, sf_dir):
    return metres(spark, sf_dir).select("frame", "point_id", L.floor_div(F.col("x"), 0.05).alias("i"))


@register(f"WITH {O.PTS} SELECT frame, point_id, CAST(floor((xw_mm // 50 - CASE WHEN xw_mm % 50 < 0 THEN 1 ELSE 0 END) / 8e0) AS BIGINT) AS i8 FROM pts")
def lat02_i_ring(spark, sf_dir):
    return points(spark, sf_dir).select("frame", "point_id", L.int_floor_div(L.int_floor_div(F.col("xw_mm"), 50), 8).alias("i8"))


@register(f"WITH v AS (SELECT CAST(unnest(range(0, 31)) AS DOUBLE) AS v) SELECT v, round({A_F}, 9) AS ahead, round({A_S}, 9) AS side, 1e0 AS rear FROM v")
def lat03_stretch(spark, sf_dir):
    f, s, r = L.stretch_columns(F.col("v"), S)
    return spark.range(31).select(F.col("id").cast("double").alias("v")).select("v", F.round(f, 9).alias("ahead"), F.round(s, 9).alias("side"), r.alias("rear"))


@register(f"WITH {O.PTS}, {XYV} SELECT frame, point_id, round(da, 9) AS d FROM da")
def lat04_d_aniso(spark, sf_dir):
    return metres(spark, sf_dir).select("frame", "point_id", F.round(L.d_aniso(F.col("x"), F.col("y"), F.col("speed"), S), 9).alias("d"))


@register(f"WITH {O.PTS}, {XYV}, {RING_OF} SELECT frame, point_id, ring FROM ro")
def lat05_ring_of(spark, sf_dir):
    """Ring under the speed's stretch and the rear floor (LAT5, LAT6)."""
    return metres(spark, sf_dir).select("frame", "point_id", L.ring_of(F.col("x"), F.col("y"), S, F.col("speed")).alias("ring"))


@register(f"""WITH {O.PTS}, {XYV}, {RING_OF}, c AS (SELECT *, cls % 4 AS cur, [10e0, 25e0, 50e0, 100e0][cls % 4 + 1] AS b, [10e0, 25e0, 50e0, 100e0][greatest(cls % 4 - 1, 0) + 1] AS below FROM ro)
SELECT frame, point_id, CASE WHEN da > b * (1 + {d(0.1)}) THEN CASE WHEN ring = -1 THEN -1 ELSE greatest(ring, cur + 1) END WHEN cur > 0 AND da < below THEN ring ELSE cur END AS ring FROM c""")
def lat07_migrate_ring(spark, sf_dir):
    m = metres(spark, sf_dir)
    return m.select("frame", "point_id", L.migrate_ring(F.col("x"), F.col("y"), F.col("cls") % 4, S, F.col("speed")).alias("ring"))


@register(f"""WITH {O.BINNED}, r(ring, side, off) AS (VALUES (0, 400, 0), (1, 500, 160000), (2, 500, 410000), (3, 500, 660000))
SELECT frame, point_id, CAST(off + ((iy % side) + side) % side * side + ((ix % side) + side) % side AS BIGINT) AS slot FROM binned JOIN r USING (ring)""")
def lat09_slots(spark, sf_dir):
    b = binned(spark, sf_dir).join(F.broadcast(L.rings(spark, S).select("ring", "side", "offset")), "ring")
    return b.select("frame", "point_id", (F.col("offset") + L.slot(F.col("ix"), F.col("iy"), F.col("side"))).cast("bigint").alias("slot"))


@register("""SELECT * FROM (VALUES ('5_10_20_40', 0, 10e0, 0.05e0, 1, 400, 0, 160000, 0), ('5_10_20_40', 1, 25e0, 0.1e0, 2, 500, 200, 210000, 160000),
 ('5_10_20_40', 2, 50e0, 0.2e0, 4, 500, 250, 187500, 410000), ('5_10_20_40', 3, 100e0, 0.4e0, 8, 500, 250, 187500, 660000),
 ('5_10_50', 0, 10e0, 0.05e0, 1, 400, 0, 160000, 0), ('5_10_50', 1, 25e0, 0.1e0, 2, 500, 200, 210000, 160000), ('5_10_50', 2, 100e0, 0.5e0, 10, 400, 100, 150000, 410000))
 t(schedule, ring, half_width_m, cell_m, k, side, hole, cells, "offset")""")
def lat12_rings(spark, sf_dir):
    """Ring layouts of both schedules (SRC8, LAT11, LAT12)."""
    return L.rings(spark, S).union(L.rings(spark, C.load("5/10/50")))


@register("""WITH c AS (SELECT ix, iy FROM (SELECT unnest(range(0, 500)) AS ix) a, (SELECT unnest(range(0, 500)) AS iy) b)
SELECT ix, iy, CAST(CASE WHEN iy < 125 THEN iy * 500 + ix WHEN iy >= 375 THEN 62500 + (iy - 375) * 500 + ix WHEN ix < 125 THEN 125000 + (iy - 125) * 125 + ix
  WHEN ix >= 375 THEN 156250 + (iy - 125) * 125 + ix - 375 ELSE -1 END AS INT) AS place FROM c""")
def lat13_annulus(spark, sf_dir):
    c = spark.range(500 * 500).select((F.col("id") % 500).alias("ix"), F.floor(F.col("id") / 500).alias("iy"))
    return c.select("ix", "iy", L.annulus_index(F.col("ix"), F.col("iy"), F.lit(500), F.lit(250)).alias("place"))


@register(f"""WITH {O.BINNED}, r(ring, side, off) AS (VALUES (0, 400, 0), (1, 500, 160000), (2, 500, 410000), (3, 500, 660000)),
s AS (SELECT frame, point_id, off + ((iy % side) + side) % side * side + ((ix % side) + side) % side AS slot FROM binned JOIN r USING (ring))
SELECT frame, point_id, CASE WHEN slot >= 660000 THEN 3 WHEN slot >= 410000 THEN 2 WHEN slot >= 160000 THEN 1 ELSE 0 END AS ring FROM s""")
def lat14_ring_of_slot(spark, sf_dir):
    s = lat09_slots(spark, sf_dir)
    return s.select("frame", "point_id", F.when(F.col("slot") >= 660000, 3).when(F.col("slot") >= 410000, 2).when(F.col("slot") >= 160000, 1).otherwise(0).alias("ring"))


@register("""WITH f AS (SELECT unnest(range(0, 7)) AS frame), r(ring, cell, side) AS (VALUES (0, 50, 400), (1, 100, 500), (2, 200, 500), (3, 400, 500))
SELECT frame, ring, (frame * 400) // cell - side // 2 AS own_x0, ((frame * 400) // 400 - 250) * (400 // cell) + (250 * (400 // cell) - side // 2) AS coarse_x0 FROM f, r""")
def lat15_windows(spark, sf_dir):
    """Window origins per frame, each ring in its own cells or all in whole coarsest cells (LAT15, LAT16)."""
    r = L.rings(spark, S).withColumn("cell", F.round(F.col("cell_m") * 1000).cast("bigint"))
    f = spark.range(7).select(F.col("id").alias("frame")).crossJoin(F.broadcast(r))
    half, scale = F.floor(F.col("side") / 2), F.floor(F.lit(400) / F.col("cell"))
    coarse = (F.floor(F.col("frame") * 400 / F.lit(400)) - 250) * scale + (250 * scale - half)
    return f.select("frame", "ring", (F.floor(F.col("frame") * 400 / F.col("cell")) - half).alias("own_x0"), coarse.alias("coarse_x0"))


@register("""WITH a AS (SELECT unnest(range(-6, 7)) AS dx), b AS (SELECT unnest(range(-6, 7)) AS dy), r(side) AS (VALUES (5), (400), (500))
SELECT side, dx, dy, CASE WHEN abs(dx) >= side OR abs(dy) >= side THEN CAST(side * side AS BIGINT) ELSE abs(dx) * side + abs(dy) * side - abs(dx) * abs(dy) END AS cells FROM a, b, r""")
def lat18_cells_per_shift(spark, sf_dir):
    g = spark.range(13 * 13 * 3).select((F.col("id") % 13 - 6).alias("dx"), (F.floor(F.col("id") / 13) % 13 - 6).alias("dy"), F.get(F.array(*map(F.lit, (5, 400, 500))), F.floor(F.col("id") / 169).cast("int")).alias("side"))
    a, b = F.abs("dx"), F.abs("dy")
    whole = (F.col("side") * F.col("side")).cast("bigint")
    return g.select("side", "dx", "dy", F.when((a >= F.col("side")) | (b >= F.col("side")), whole).otherwise(a * F.col("side") + b * F.col("side") - a * b).alias("cells"))


@register(f"""WITH {O.FOLD} SELECT ring, ix, iy, CAST(CASE WHEN abs(dz) >= 800 THEN CASE WHEN dz > 0 THEN -200 ELSE 600 END ELSE greatest(-200, least(600, mu - dz)) END AS INT) AS mu,
  CAST(CASE WHEN ceil = 32767 THEN ceil WHEN abs(dz) >= 800 THEN CASE WHEN dz > 0 THEN -200 ELSE 600 END ELSE greatest(-200, least(600, ceil - dz)) END AS INT) AS ceil
FROM (SELECT *, (last_frame % 3 - 1) * 450 AS dz FROM state)""")
def lat19_rebase(spark, sf_dir):
    """Heights after the datum moved (LAT19)."""
    dz = (F.col("last_frame") % 3 - 1) * 450
    return state(spark, sf_dir).select("ring", "ix", "iy", fold.rebase(F.col("mu"), dz).cast("int").alias("mu"), fold.rebase(F.col("ceil"), dz, 32767).cast("int").alias("ceil"))


VAR = O.variance("(sqrt(x * x + y * y + z * z))")


@register(f"WITH {O.PTS}, {XYV} SELECT frame, point_id, round({VAR}, 6) AS var_cm2, {O.weight(VAR)} AS w FROM xyv")
def tx12_variance_weight(spark, sf_dir):
    """Measurement variance and its integer weight (TX12, TX13)."""
    v = sensor.measurement_variance_cm2(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    return metres(spark, sf_dir).select("frame", "point_id", F.round(v, 6).alias("var_cm2"), sensor.quantise_weight(v).alias("w"))


@register(f"WITH {O.PTS}, {XYV} SELECT frame, point_id, CAST(greatest(-200e0, least(600e0, round_even(z * 100e0 - 3e0 * 100e0, 0))) AS INT) AS z_cm FROM xyv")
def tx14_quantise_height(spark, sf_dir):
    return metres(spark, sf_dir).select("frame", "point_id", sensor.quantise_height_cm(F.col("z"), 3.0).alias("z_cm"))


@register(f"""WITH v AS (SELECT i, exp(i / 1000e0 - 3) AS v FROM (SELECT unnest(range(0, 17000)) AS i)), t AS (SELECT {O.TABLE} AS tv)
SELECT i, {O.code_of('v', 'tv')} AS code, round(tv[{O.code_of('v', 'tv')} + 1], 4) AS back_cm2 FROM v, t""")
def tx15_variance_codec(spark, sf_dir):
    """Codes of variances and what they stand for (TX15)."""
    v = spark.range(17000).select(F.col("id").alias("i"), F.exp(F.col("id") / 1000.0 - 3).alias("v"))
    code = sensor.quantise_variance(F.col("v"))
    return v.select("i", code.cast("bigint").alias("code"), F.round(sensor.variance_cm2(code), 4).alias("back_cm2"))


@register(f"WITH {O.FOLD} SELECT ring, ix, iy, (cand << 3) | cnt AS packed FROM state")
def tx16_pack_class(spark, sf_dir):
    return state(spark, sf_dir).select("ring", "ix", "iy", sensor.pack_class(F.col("cand"), F.col("cnt")).alias("packed"))


@register(f"WITH {O.PTS}, {XYV} SELECT frame, point_id, sqrt(x * x + y * y) < {d(3.74)} AS blind, CASE WHEN sqrt(x * x + y * y) < {d(3.74)} THEN 0 ELSE 1 END AS known FROM xyv")
def tx17_blind(spark, sf_dir):
    m = metres(spark, sf_dir)
    b = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) < C.THRESHOLDS["blind_m"]
    return m.select("frame", "point_id", b.alias("blind"), F.when(b, 0).otherwise(1).alias("known"))


@register(f"WITH {O.PTS}, {XYV} SELECT frame, point_id, round(greatest(3 * sqrt({VAR}) / 100, {d(0.3)}), 6) AS tol FROM xyv")
def tx18_clear_tolerance(spark, sf_dir):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return metres(spark, sf_dir).select("frame", "point_id", F.round(sensor.clear_tolerance_m(r), 6).alias("tol"))


@register(f"""WITH {O.PTS}, {XYV}, t AS (SELECT *, sqrt(x * x + y * y) AS r, raw_label BETWEEN 250 AND 259 AS dyn, CASE WHEN v > 1e-6 AND x > 0 THEN x / v END AS ttc FROM xyv)
SELECT frame, point_id, round(1 / (1 + r / 10e0) * CASE WHEN dyn THEN 4 ELSE 1 END * CASE WHEN ttc IS NULL THEN {d(0.05)} ELSE greatest(1 / (1 + ttc / 3e0), {d(0.05)}) END, 8) AS score FROM t""")
def tx19_priority(spark, sf_dir):
    """Score of a refinement request (TX19, TX20)."""
    m = metres(spark, sf_dir)
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    p = sensor.priority(r, F.col("raw_label").between(250, 259), sensor.time_to_collision(F.col("x"), F.col("speed")))
    return m.select("frame", "point_id", F.round(p, 8).alias("score"))


_map = ", ".join(f"({a}, {b})" for a, b in C.CLASS_OF.items())


@register(f"""WITH {O.PTS}, m(raw, cls) AS (VALUES {_map})
SELECT frame, point_id, coalesce(m.cls, -1) AS cls, CASE WHEN coalesce(m.cls, -1) = -1 THEN 31 ELSE m.cls END AS learning, raw_label BETWEEN 250 AND 259 AS moving, coalesce(m.cls, -1) IN (8, 9, 10, 11, 16) AS ground
FROM (SELECT frame, point_id, raw_label & 65535 AS raw_label FROM pts) p LEFT JOIN m ON m.raw = p.raw_label""")
def tx08_labels(spark, sf_dir):
    """Classes, learning ids, motion and ground from raw labels (TX8-11, JN2); the map is a fixed small table."""
    dim = spark.createDataFrame(list(C.CLASS_OF.items()), "raw int, c int")
    p = points(spark, sf_dir).select("frame", "point_id", F.col("raw_label").bitwiseAND(65535).alias("raw")).join(F.broadcast(dim), "raw", "left")
    cls = F.coalesce("c", F.lit(-1))
    return p.select("frame", "point_id", cls.alias("cls"), F.when(cls == -1, 31).otherwise(cls).alias("learning"), F.col("raw").between(*C.MOVING).alias("moving"), cls.isin(C.THRESHOLDS["drivable"]).alias("ground"))


@register("""SELECT ring, cell_m, round(half * 2 * pi() / 1800, 9) AS s_az_m, round(1.73e0 / tan(radians(24.8e0)), 9) AS blind_m, round(cell_m * 1800 / (2 * pi()), 9) AS r_max_m,
 round(half * half * radians(26.9e0 / 63) / 1.73e0, 9) AS s_rad_m, round(least(1e0, cell_m / (half * half * radians(26.9e0 / 63) / 1.73e0)) * least(1e0, cell_m / (half * radians(0.2e0))), 9) AS p_fill, round(sqrt(0.5e0 * 1.73e0 / radians(26.9e0 / 63)), 9) AS hole_50cm_m
FROM (VALUES (0, 10e0, 0.05e0), (1, 25e0, 0.1e0), (2, 50e0, 0.2e0), (3, 100e0, 0.4e0)) t(ring, half, cell_m)""")
def tx22_sampling(spark, sf_dir):
    """Spacing along azimuth and range at a ring's edge, chance of a return in a cell, blind radius, limits (TX22)."""
    import math

    half, cell, beam = F.col("half_width_m"), F.col("cell_m"), math.radians(26.9 / 63)
    s_rad = half * half * beam / 1.73
    fill = F.least(F.lit(1.0), cell / s_rad) * F.least(F.lit(1.0), cell / (half * math.radians(0.2)))
    told = {"s_az_m": half * 2 * math.pi / 1800, "blind_m": F.lit(1.73 / math.tan(math.radians(24.8))), "r_max_m": cell * 1800 / (2 * math.pi), "s_rad_m": s_rad, "p_fill": fill, "hole_50cm_m": F.lit(math.sqrt(0.5 * 1.73 / beam))}
    return L.rings(spark, S).select("ring", "cell_m", *(F.round(v, 9).alias(k) for k, v in told.items()))


@register("""SELECT 'map' AS part, CAST(745000 AS BIGINT) AS cells, CAST(12 * 745000 AS BIGINT) AS bytes UNION ALL SELECT 'uniform_5cm', 16000000, 192000000 UNION ALL SELECT 'dense_3d', 2560000000, 2560000000 UNION ALL SELECT 'pool', 8192, 98304 UNION ALL SELECT 'transient', 910000, 3640000""")
def agg26_memory(spark, sf_dir):
    """Closed-form memory of the map and of its baselines (AGG26, EXT2)."""
    side = round(200 / 0.05)
    rows = [("map", S.total_cells, 12 * S.total_cells), ("uniform_5cm", side**2, 12 * side**2), ("dense_3d", side**2 * 160, side**2 * 160), ("pool", 512 * 16, 512 * 16 * 12), ("transient", S.slots, 4 * S.slots)]
    return spark.createDataFrame(rows, "part string, cells bigint, bytes bigint")
