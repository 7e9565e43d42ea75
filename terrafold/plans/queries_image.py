"""Queries on the range image and on poses: projection, reflectivity, motion, visibility, transforms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrafold import config as C
from terrafold.functions import frames
from terrafold.operators import evalmap, fold, image, tracks
from terrafold.operators.scatter import moving
from terrafold.plans import oracle as O
from terrafold.plans.queries_lattice import metres
from terrafold.plans.registry import S, binned, points, register, state

PHI = "radians(2e0)"
DPHI = "((radians(2e0) - radians(CAST('-24.8' AS DOUBLE))) / 64)"


def pix(x: str, y: str, z: str) -> str:
    r = f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"
    return f"""{r} AS r, CAST(floor((atan2({y}, {x}) + pi()) / (2 * pi() / 512)) AS INT) % 512 AS u, CAST(floor(({PHI} - asin(greatest(-1e0, least(1e0, {z} / {r})))) / {DPHI}) AS INT) AS v_raw"""


#: Points seen from the sensor: the vehicle's height taken off, over a narrower spread of heights than the map's.
SENSED = f"""{O.PTS}, sp AS (SELECT frame, point_id, xv_mm / 1000e0 AS x, yv_mm / 1000e0 AS y, z_cm / 1000e0 - CAST('1.73' AS DOUBLE) AS z, refl, raw_label FROM pts),
pp AS (SELECT *, {pix('x', 'y', 'z')} FROM sp), pv AS (SELECT *, greatest(0, least(63, v_raw)) AS v FROM pp),
img AS (SELECT frame, v, u, r, point_id, x, y, z, refl, raw_label FROM (SELECT *, row_number() OVER (PARTITION BY frame, v, u ORDER BY r, point_id) AS k FROM pv WHERE r > 1e-6) WHERE k = 1)"""


def sensed(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("frame", "point_id", (F.col("xv_mm") / 1000.0).alias("x"), (F.col("yv_mm") / 1000.0).alias("y"), (F.col("z_cm") / 1000.0 - 1.73).alias("z"), "refl", "raw_label")


def projected(spark, sf_dir):
    return image.project(sensed(spark, sf_dir), ["x", "y", "z", "refl", "raw_label"])


@register(f"WITH {SENSED} SELECT frame, point_id, u, v_raw, round(r, 6) AS r FROM pv")
def tx06_pixel(spark, sf_dir):
    return image.with_pixel(sensed(spark, sf_dir)).select("frame", "point_id", "u", "v_raw", F.round("r", 6).alias("r"))


@register(f"WITH {SENSED} SELECT frame, v, u, round(r, 6) AS r, point_id FROM img")
def agg06_range_image(spark, sf_dir):
    """Nearest return of each pixel (AGG6)."""
    return projected(spark, sf_dir).select("frame", "v", "u", F.round("r", 6).alias("r"), "point_id")


@register(f"""WITH {SENSED}, st AS (SELECT frame, count(*) AS n_input, count(*) FILTER (r <= 1e-6) AS n_zero_range, count(*) FILTER (r > 1e-6 AND v_raw < 0) AS n_clamped_above,
 count(*) FILTER (r > 1e-6 AND v_raw >= 64) AS n_clamped_below, count(DISTINCT v * 512 + u) AS n_filled FROM pv GROUP BY frame)
SELECT *, round(n_filled / 32768e0, 6) AS fill_fraction, round((n_clamped_above + n_clamped_below) / CAST(n_input - n_zero_range AS DOUBLE), 6) AS out_of_fov FROM st""")
def agg07_projection_stats(spark, sf_dir):
    return image.projection_stats(sensed(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("fill_fraction", "out_of_fov")})


INCIDENCE = f"""{SENSED}, inc AS (
 SELECT c.frame AS frame, c.v AS v, c.u AS u, c.r AS r, c.refl AS refl, c.x AS x, c.y AS y, c.z AS z,
   (e.y - w.y) * (s.z - n.z) - (e.z - w.z) * (s.y - n.y) AS nx, (e.z - w.z) * (s.x - n.x) - (e.x - w.x) * (s.z - n.z) AS ny, (e.x - w.x) * (s.y - n.y) - (e.y - w.y) * (s.x - n.x) AS nz
 FROM img c LEFT JOIN img e ON e.frame = c.frame AND e.v = c.v AND e.u = (c.u + 1) % 512 LEFT JOIN img w ON w.frame = c.frame AND w.v = c.v AND w.u = (c.u + 511) % 512
 LEFT JOIN img s ON s.frame = c.frame AND s.v = c.v + 1 AND s.u = c.u LEFT JOIN img n ON n.frame = c.frame AND n.v = c.v - 1 AND n.u = c.u),
co AS (SELECT *, CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-6 AND r > 1e-6 THEN abs((nx * x + ny * y + nz * z) / (sqrt(nx * nx + ny * ny + nz * nz) * r)) END AS cos_inc FROM inc)"""


@register(f"WITH {INCIDENCE} SELECT frame, v, u, round(cos_inc, 6) AS cos_inc FROM co")
def stn06_incidence(spark, sf_dir):
    return image.incidence(projected(spark, sf_dir)).select("frame", "v", "u", F.round("cos_inc", 6).alias("cos_inc"))


@register(f"""WITH {INCIDENCE} SELECT frame, v, u, CAST(greatest(0e0, least(255e0, round_even(refl / 256e0 * 255e0, 0))) AS INT) AS rho8, CASE WHEN cos_inc IS NULL THEN 2 WHEN cos_inc < 0.1 THEN 1 ELSE 0 END AS rho_flags FROM co""")
def stn07_reflectivity(spark, sf_dir):
    """Reflectivity byte and flags per pixel (STN7)."""
    i = image.incidence(projected(spark, sf_dir))
    return image.reflectivity(i, F.col("refl") / 256.0).select("frame", "v", "u", "rho8", "rho_flags")


@register(f"""WITH {INCIDENCE}, px AS (SELECT frame, v, u, CAST(greatest(0e0, least(255e0, round_even(refl / 256e0 * 255e0, 0))) AS INT) AS rho8, CASE WHEN cos_inc IS NULL THEN 2 WHEN cos_inc < 0.1 THEN 1 ELSE 0 END AS rho_flags FROM co)
SELECT p.frame AS frame, p.point_id AS point_id, px.rho8 AS rho8, px.rho_flags AS rho_flags FROM pv p LEFT JOIN px ON px.frame = p.frame AND px.v = p.v AND px.u = p.u""")
def jn07_pixel_to_points(spark, sf_dir):
    """Every point with the reflectivity of the pixel that it falls in (JN7, STN7)."""
    i = image.reflectivity(image.incidence(projected(spark, sf_dir)), F.col("refl") / 256.0)
    return image.to_points(sensed(spark, sf_dir), i, ["rho8", "rho_flags"]).select("frame", "point_id", "rho8", "rho_flags")


@register(f"""WITH {SENSED}, w AS (SELECT frame, point_id, x - CAST('0.4' AS DOUBLE) AS x, y, z FROM sp), wp AS (SELECT *, {pix('x', 'y', 'z')} FROM w),
pr AS (SELECT frame + 1 AS frame, greatest(0, least(63, v_raw)) AS v, u, min(r) AS pred FROM wp WHERE r > 1e-6 GROUP BY ALL)
SELECT c.frame AS frame, c.v AS v, c.u AS u, round(abs(c.r - pred), 6) AS residual, abs(c.r - pred) > 0.75 AS moving FROM img c JOIN pr ON pr.frame = c.frame AND pr.v = c.v AND pr.u = c.u WHERE c.r >= 2""")
def stn10_residual_motion(spark, sf_dir):
    """Range residuals against the frame before, moved by the vehicle's step (STN10, JN8, TX4)."""
    p = sensed(spark, sf_dir)
    warped = image.project(p.withColumn("x", F.col("x") - 0.4), ["x"])
    m = image.residual_motion(projected(spark, sf_dir), warped)
    return m.select("frame", "v", "u", F.round("residual", 6).alias("residual"), "moving")


@register(f"""WITH {SENSED}, gaps AS (SELECT a.frame AS frame, a.v AS v, a.u + 1 AS u, (a.r + b.r) / 2 AS r FROM img a JOIN img b ON b.frame = a.frame AND b.v = a.v AND b.u = a.u + 2
  LEFT JOIN img c ON c.frame = a.frame AND c.v = a.v AND c.u = a.u + 1 WHERE c.frame IS NULL)
SELECT frame, v, u, round(r, 6) AS r, false AS filled FROM img UNION ALL SELECT frame, v, u, round(r, 6), true FROM gaps""")
def stn11_fill_gaps(spark, sf_dir):
    """The image with one-pixel gaps filled (STN11)."""
    return image.fill_gaps(projected(spark, sf_dir)).withColumn("r", F.round("r", 6))


VIS = f"""{O.FOLD}, {SENSED[len(O.PTS) + 2:]},
cand AS (SELECT 6 AS frame, ring, ix, iy, ((ix + 0.5e0) * (0.05e0 * (1 << ring))) - 2.4e0 AS x, (iy + 0.5e0) * (0.05e0 * (1 << ring)) AS y, CASE WHEN ceil < 32767 THEN ceil ELSE mu END / 1000e0 - CAST('1.73' AS DOUBLE) AS z, odds FROM state WHERE {O.OCC} = 2),
cp AS (SELECT *, {pix('x', 'y', 'z')} FROM cand),
touched AS (SELECT DISTINCT ring, ix, iy FROM binned WHERE frame = 6),
j AS (SELECT cp.*, v_raw BETWEEN 0 AND 63 AS in_view, img.r AS observed, t.ring IS NOT NULL AS touched FROM cp LEFT JOIN img ON img.frame = 6 AND img.v = cp.v_raw AND img.u = cp.u LEFT JOIN touched t ON t.ring = cp.ring AND t.ix = cp.ix AND t.iy = cp.iy),
th AS (SELECT *, coalesce(in_view AND observed > r + greatest(3e0 * sqrt({O.variance('r')}) / 100, CAST('0.3' AS DOUBLE)), false) AS far FROM j)"""


def seen(spark, sf_dir):
    s = state(spark, sf_dir).withColumn("occ", fold.occupancy(F.col("n"), F.col("odds"))).filter("occ = 2")
    size = F.lit(0.05) * F.expr("shiftleft(1, ring)")
    z = F.when(F.col("ceil") < 32767, F.col("ceil")).otherwise(F.col("mu")) / 1000.0
    c = s.select(F.lit(6).alias("frame"), "ring", "ix", "iy", ((F.col("ix") + 0.5) * size - 2.4).alias("x"), ((F.col("iy") + 0.5) * size).alias("y"), z.alias("z"), "odds")
    touched = binned(spark, sf_dir).filter("frame = 6")
    return image.see_through(c, projected(spark, sf_dir).filter("frame = 6"), touched)


@register(f"WITH {VIS} SELECT ring, ix, iy, far AND NOT touched AS through, far AND touched AS protected, CAST(CASE WHEN far AND NOT touched THEN greatest(odds - 2, -64) ELSE odds END AS INT) AS odds FROM th")
def st08_visibility(spark, sf_dir):
    """Occupied cells that the last frame sees through, protected ones, and log-odds after the misses (ST7-9, JN5, JN6)."""
    c = seen(spark, sf_dir)
    return c.select("ring", "ix", "iy", "through", "protected", F.when(F.col("through"), fold.miss(F.col("odds"))).otherwise(F.col("odds")).cast("int").alias("odds"))


@register(f"WITH {VIS} SELECT count(*) AS tested, count(*) FILTER (NOT in_view) AS out_of_view, count(*) FILTER (far AND touched) AS protected, count(*) FILTER (far AND NOT touched) AS cleared FROM th")
def st09_cleanup_counts(spark, sf_dir):
    c = seen(spark, sf_dir)
    return c.agg(F.count("*").alias("tested"), F.count_if(~F.col("in_view")).alias("out_of_view"), F.count_if(F.col("protected")).alias("protected"), F.count_if(F.col("through")).alias("cleared"))


@register(f"""WITH {VIS}, mv AS (SELECT DISTINCT ring, ix, iy FROM binned WHERE (raw_label & 65535) BETWEEN 250 AND 259),
c AS (SELECT mv.ring IS NOT NULL AS dynamic, far AND NOT touched AS removed FROM th LEFT JOIN mv ON mv.ring = th.ring AND mv.ix = th.ix AND mv.iy = th.iy),
g AS (SELECT count(*) FILTER (dynamic AND removed) AS a, nullif(count(*) FILTER (dynamic), 0) AS b, count(*) FILTER (NOT dynamic AND NOT removed) AS c, nullif(count(*) FILTER (NOT dynamic), 0) AS d FROM c)
SELECT round(dr, 6) AS dr, round(sp, 6) AS sp, round(CASE WHEN dr + sp > 0 THEN 2 * dr * sp / (dr + sp) ELSE 0e0 END, 6) AS f FROM (SELECT CAST(a AS DOUBLE) / b AS dr, CAST(c AS DOUBLE) / d AS sp FROM g)""")
def agg20_removal(spark, sf_dir):
    """How well the clean-up of the last frame told cells in which something ever moved from the others (AGG20)."""
    key = ["ring", "ix", "iy"]
    moved = binned(spark, sf_dir).filter(moving(F.col("raw_label"))).select(*key).distinct().withColumn("dynamic", F.lit(True))
    c = seen(spark, sf_dir).join(moved, key, "left").select(F.coalesce("dynamic", F.lit(False)).alias("dynamic"), F.col("through").alias("removed"))
    return evalmap.removal(c).select(F.round("dr", 6).alias("dr"), F.round("sp", 6).alias("sp"), F.round("f", 6).alias("f"))


POSES = "po AS (SELECT CAST(f AS INT) AS frame, cos(f / 20e0) AS c, sin(f / 20e0) AS s, f * 4e-1 AS tx, f * 1e-1 AS ty FROM (SELECT unnest(range(0, 7)) AS f))"


@register(f"""WITH {O.PTS}, {POSES}, m AS (SELECT frame, point_id, xv_mm / 1000e0 AS x, yv_mm / 1000e0 AS y, z_cm / 100e0 AS z FROM pts)
SELECT frame, point_id, round(c * x - s * y + tx, 6) AS xw, round(s * x + c * y + ty, 6) AS yw, round(z + CAST('1.73' AS DOUBLE), 6) AS zw FROM m JOIN po USING (frame)""")
def tx01_transform(spark, sf_dir):
    """Points by their frame's pose, raised by the sensor's height (TX1-3, JN1); poses are a few rows a frame."""
    f = spark.range(7).select(F.col("id").cast("int").alias("frame"), F.col("id").cast("double").alias("f"))
    po = f.select("frame", F.cos(F.col("f") / 20).alias("c"), F.sin(F.col("f") / 20).alias("s"), (F.col("f") * 0.4).alias("tx"), (F.col("f") * 0.1).alias("ty"))
    m = metres(spark, sf_dir).join(F.broadcast(po), "frame")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return m.select("frame", "point_id", F.round(F.col("c") * x - F.col("s") * y + F.col("tx"), 6).alias("xw"), F.round(F.col("s") * x + F.col("c") * y + F.col("ty"), 6).alias("yw"), F.round(z + 1.73, 6).alias("zw"))


@register(f"""WITH {POSES}, l AS (SELECT *, lag(tx) OVER (ORDER BY frame) AS px, lag(ty) OVER (ORDER BY frame) AS py, lag(c) OVER (ORDER BY frame) AS pc, lag(s) OVER (ORDER BY frame) AS ps FROM po)
SELECT frame, round(sqrt((tx - px) * (tx - px) + (ty - py) * (ty - py)) / 1e-1, 6) AS speed_ms, round(pc * c + ps * s, 6) AS cos_rel, round(c * (px - tx) + s * (py - ty), 6) AS dx, round(-s * (px - tx) + c * (py - ty), 6) AS dy FROM l WHERE px IS NOT NULL""")
def wf03_relative_pose(spark, sf_dir):
    """Speed and transform between successive poses of a sequence (TX4, WF3); one row a frame, per sequence."""
    f = spark.range(7).select(F.lit(0).alias("seq"), F.col("id").cast("int").alias("frame"), F.col("id").cast("double").alias("f"))
    po = f.select("seq", "frame", F.cos(F.col("f") / 20).alias("c"), F.sin(F.col("f") / 20).alias("s"), (F.col("f") * 0.4).alias("tx"), (F.col("f") * 0.1).alias("ty"))
    w = Window.partitionBy("seq").orderBy("frame")
    po = po.select("*", *(F.lag(c).over(w).alias(n) for c, n in (("tx", "px"), ("ty", "py"), ("c", "pc"), ("s", "ps")))).filter("px IS NOT NULL")
    dx, dy = F.col("px") - F.col("tx"), F.col("py") - F.col("ty")
    r = lambda c, n: F.round(c, 6).alias(n)
    return po.select("frame", r(F.sqrt(dx * dx + dy * dy) / 0.1, "speed_ms"), r(F.col("pc") * F.col("c") + F.col("ps") * F.col("s"), "cos_rel"), r(F.col("c") * dx + F.col("s") * dy, "dx"), r(-F.col("s") * dx + F.col("c") * dy, "dy"))


@register()
def agg13_instances(spark, sf_dir):
    """Connected moving pixels of each frame (AGG13, SRT3); sequential inside an image."""
    return tracks.instances(projected(spark, sf_dir).filter(moving(F.col("raw_label"))).select("frame", "v", "u", "r", "x", "y", "z"))


def scene_pixels(spark):
    """Moving pixels of three frames of the scene: fifty people and a car."""
    from terrafold.sources import synthetic

    p = [synthetic.solids(spark, f, f, crowd=50, car=True) for f in range(3)]
    p = p[0].union(p[1]).union(p[2]).withColumns({"z": F.col("z") - C.THRESHOLDS["sensor_height_m"], "point_id": F.col("raw_label") * 1_000_000 + F.col("solid_id")})
    return image.project(p, ["x", "y", "z", "raw_label"]).filter(moving(F.col("raw_label"))).select("frame", "v", "u", "r", "x", "y", "z")


@register()
def agg13_scene(spark, sf_dir):
    """People and the car of the scene as instances (AGG13, SRT3); the tables' points have no such neighbours."""
    return tracks.instances(scene_pixels(spark))


#: Points are dealt to so many sequences by their reflectivity.
SEQUENCES = 16


def sequenced(df):
    return df.withColumn("seq", F.pmod(F.col("refl"), F.lit(SEQUENCES)).cast("int"))


@register()
def st12_tracks(spark, sf_dir):
    """Tracks of moving clusters over the frames of each sequence (ST12, ST13, JN15)."""
    from terrafold.operators.scatter import cluster

    c = cluster(sequenced(points(spark, sf_dir).filter(moving(F.col("raw_label")))), key=("seq", "frame"))
    return tracks.track(c.select("seq", "frame", (F.col("sx") / F.col("n") / 1000).alias("x_m"), (F.col("sy") / F.col("n") / 1000).alias("y_m"), F.col("cls").cast("int").alias("cls")))


def fired(spark, sf_dir):
    """Cells of each sequence and frame with a class that asks for refinement, and whether something moves in them."""
    b = sequenced(binned(spark, sf_dir)).filter("ring >= 0").groupBy("seq", "frame", "ring", "ix", "iy").agg(F.bool_or(F.col("cls").isin(C.THRESHOLDS["refine"])).alias("fires"), F.bool_or(moving(F.col("raw_label"))).alias("dynamic"))
    return b.filter("fires OR dynamic").select("seq", "frame", "ring", "ix", "iy", "dynamic")


def rides(spark):
    """The vehicle of every sequence in each of the seven frames: 4 m/s ahead from the origin, as in the points' view."""
    f = spark.range(7 * SEQUENCES)
    frame = (F.col("id") % 7).cast("int")
    return f.select(F.expr("CAST(id DIV 7 AS INT)").alias("seq"), frame.alias("frame"), (frame * 400).cast("bigint").alias("ego_x_mm"), F.lit(0).cast("bigint").alias("ego_y_mm"), F.lit(4.0).alias("speed_ms"))


@register()
def st14_pool(spark, sf_dir):
    """Blocks of the refinement pool held at the end of each sequence (ST14, TOPK1)."""
    r = tracks.refine(fired(spark, sf_dir), rides(spark), S).filter("block IS NOT NULL")
    return r.select("seq", "block", "ring", "ix", "iy", "levels", "score")


@register()
def st15_gate(spark, sf_dir):
    """What the gate did in each frame: blocks released, cells fired, acquired, refused, not fitting (ST15, JN19)."""
    r = tracks.refine(fired(spark, sf_dir), rides(spark), S).filter("block IS NULL")
    return r.select("seq", "frame", "released", "fired", "acquired", "refused", "unfit")


@register()
def st15_fill(spark, sf_dir):
    """Children of the cells that hold a block, split from the map (ST15, ST16)."""
    held = tracks.refine(fired(spark, sf_dir), rides(spark), S)
    return tracks.filled(held, state(spark, sf_dir), S).withColumns({"mu_m": F.round("mu_m", 6), "sigma2_m2": F.round("sigma2_m2", 9)})


#: A sensor-to-camera calibration that isn't the identity, and poses of a camera that turns and climbs.
TR = [0.0, -1.0, 0.0, 0.1, 0.0, 0.0, -1.0, -0.2, 1.0, 0.0, 0.0, -0.3]
CAMERA = "SELECT CAST(f AS INT) AS frame, [cos(f / 20e0), 0e0, sin(f / 20e0), f * 4e-1, 0e0, 1e0, 0e0, f * -5e-2, -sin(f / 20e0), 0e0, cos(f / 20e0), f * 9e-1] AS m FROM (SELECT unnest(range(0, 7)) AS f)"


def camera(spark):
    f = F.col("id").cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.array(F.cos(f / 20), zero, F.sin(f / 20), f * 0.4, zero, one, zero, f * -0.05, -F.sin(f / 20), zero, F.cos(f / 20), f * 0.9)
    return spark.range(7).select(F.col("id").cast("int").alias("frame"), m.alias("m"))


def _times(a: str, b: str) -> str:
    """SQL of the product of two transforms, lists of twelve."""
    cell = lambda i, j: " + ".join(f"{a}[{4 * i + k + 1}] * {b}[{4 * k + j + 1}]" for k in range(3)) + (f" + {a}[{4 * i + 4}]" if j == 3 else "")
    return "[" + ", ".join(cell(i, j) for i in range(3) for j in range(4)) + "]"


_list = lambda m: "[" + ", ".join(f"CAST('{v}' AS DOUBLE)" for v in m) + "]"
TO_WORLD = f"""cam AS ({CAMERA}), k AS (SELECT {_list(frames.FLIP)} AS flip, {_list(TR)} AS tr, {_list(frames.shifted(-1.73))} AS down),
s1 AS (SELECT frame, m, flip, {_times('tr', 'down')} AS a FROM cam, k), s2 AS (SELECT frame, flip, {_times('m', 'a')} AS b FROM s1), tw AS (SELECT frame, {_times('flip', 'b')} AS t FROM s2)"""


@register(f"""WITH {O.PTS}, {TO_WORLD}, v AS (SELECT frame, point_id, xv_mm / 1000e0 AS x, yv_mm / 1000e0 AS y, z_cm / 100e0 AS z FROM pts)
SELECT frame, point_id, {', '.join(f"round(t[{4 * i + 1}] * x + t[{4 * i + 2}] * y + t[{4 * i + 3}] * z + t[{4 * i + 4}], 6) + 0e0 AS {n}" for i, n in enumerate(("xw", "yw", "zw")))} FROM v JOIN tw USING (frame)""")
def tx03_world(spark, sf_dir):
    """Vehicle points in the world through pose, calibration and axes (TX1-3, JN1); composed once a frame."""
    t = camera(spark).select("frame", frames.vehicle_to_world(F.col("m"), TR).alias("t"))
    p = metres(spark, sf_dir).join(F.broadcast(t), "frame")
    return p.select("frame", "point_id", *((F.round(c, 6) + 0.0).alias(n) for c, n in zip(frames.apply(F.col("t"), F.col("x"), F.col("y"), F.col("z")), ("xw", "yw", "zw"), strict=True)))


_inv = "[t[1], t[5], t[9], -(t[1] * t[4] + t[5] * t[8] + t[9] * t[12]), t[2], t[6], t[10], -(t[2] * t[4] + t[6] * t[8] + t[10] * t[12]), t[3], t[7], t[11], -(t[3] * t[4] + t[7] * t[8] + t[11] * t[12])]"


@register(f"""WITH {TO_WORLD}, l AS (SELECT frame, t, lag(t) OVER (ORDER BY frame) AS p FROM tw), i AS (SELECT frame, p, {_inv} AS q FROM l WHERE p IS NOT NULL), r AS (SELECT frame, {_times('q', 'p')} AS m FROM i)
SELECT frame, i.i - 1 AS place, round(m[i.i], 6) + 0e0 AS value FROM r, (SELECT unnest(range(1, 13)) AS i) i""")
def tx04_relative(spark, sf_dir):
    """The transform from each frame's vehicle to the next one's (TX4); twelve rows a frame, per sequence."""
    t = camera(spark).select(F.lit(0).alias("seq"), "frame", frames.vehicle_to_world(F.col("m"), TR).alias("t"))
    t = t.withColumn("p", F.lag("t").over(Window.partitionBy("seq").orderBy("frame"))).filter("p IS NOT NULL")
    return t.select("frame", F.posexplode(frames.relative(F.col("p"), F.col("t"))).alias("place", "v")).select("frame", F.col("place").cast("bigint").alias("place"), (F.round("v", 6) + 0.0).alias("value"))
