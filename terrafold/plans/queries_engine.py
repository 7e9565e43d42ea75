"""Queries on windows, planning lattices, checks and counters: the parts of the engine around the map."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terrafold import config as C
from terrafold.functions import lattice as L
from terrafold.operators import evalmap, fold, plan, scatter
from terrafold.plans import oracle as O
from terrafold.plans.queries_image import VIS, projected, sensed
from terrafold.plans.queries_map import _bits, bits
from terrafold.plans.queries_plan import _weight, costs
from terrafold.plans.registry import S, binned, points, register, state
from terrafold.sources.points import SIDE

#: Rings with cell, side and slot offset: ring, cell_mm, side, offset.
RINGS = [(r.ring, L.mm(r.cell_m), S.side(r.ring), sum(S.side(q) ** 2 for q in range(r.ring))) for r in S.rings]
_rings = f"r(ring, cell, side, off) AS (VALUES {', '.join(map(str, RINGS))})"
WINDOWS = f"""{_rings}, win AS (SELECT frame, ring, side, off, (frame * 400) // cell - side // 2 AS x0, -(side // 2) AS y0 FROM (SELECT unnest(range(0, 7)) AS frame) f, r)"""


def windows(spark):
    """Each ring's window around the vehicle in the seven frames: 28 rows."""
    rows = [(f, r, f * 400 // cell - side // 2, -(side // 2), side, off) for f in range(7) for r, cell, side, off in RINGS]
    return spark.createDataFrame(rows, "frame int, ring int, x0 bigint, y0 bigint, side int, offset int")


@register(f"""WITH {O.BINNED}, {WINDOWS} SELECT frame, point_id, ring, off + ((iy % side) + side) % side * side + ((ix % side) + side) % side AS slot
FROM binned JOIN win USING (frame, ring) WHERE ix >= x0 AND ix < x0 + side AND iy >= y0 AND iy < y0 + side""")
def lat08_in_window(spark, sf_dir):
    """Points whose cell lies inside its ring's window, with the cell's slot (LAT8, LAT9)."""
    return scatter.in_windows(binned(spark, sf_dir), windows(spark)).select("frame", "point_id", "ring", "slot")


@register(f"""WITH {WINDOWS}, s AS (SELECT a.frame AS frame, a.ring AS ring, a.side AS side, a.off AS off, a.y0 AS y0, a.x0 + a.side AS first, b.x0 - a.x0 AS n FROM win a JOIN win b ON b.ring = a.ring AND b.frame = a.frame + 1),
c AS (SELECT *, unnest(range(first, first + n)) AS ix FROM s), e AS (SELECT *, unnest(range(y0, y0 + side)) AS iy FROM c)
SELECT frame + 1 AS frame, ring, off + ((iy % side) + side) % side * side + ((ix % side) + side) % side AS slot FROM e""")
def lat18_strips(spark, sf_dir):
    """Slots that a frame's shift clears, for the columns and rows that come into the window (LAT18)."""
    w = windows(spark)
    before = w.select((F.col("frame") + 1).alias("frame"), "ring", F.col("x0").alias("px"), F.col("y0").alias("py"))
    return L.strips(w.join(F.broadcast(before), ["frame", "ring"])).select("frame", "ring", "slot")


@register(f"""WITH {O.FOLD}, c AS (SELECT *, CASE WHEN sqrt(((ix + 0.5e0) * (50 << ring) - 2400) * ((ix + 0.5e0) * (50 << ring) - 2400) + (iy + 0.5e0) * (50 << ring) * ((iy + 0.5e0) * (50 << ring))) < 3740 THEN 4 ELSE 0 END AS flags FROM state)
SELECT ring, ix, iy, flags, CASE WHEN flags = 4 THEN 0 ELSE {O.OCC} END AS occupancy FROM c""")
def st10_blind(spark, sf_dir):
    """Cells below the sensor are flagged and unknown, whatever was seen there (ST10, FLT4)."""
    s = fold.mark_blind(state(spark, sf_dir), S, (2400, 0))
    return s.select("ring", "ix", "iy", "flags", fold.occupancy(F.col("n"), F.col("odds"), F.col("flags")).alias("occupancy"))


@register(f"""WITH {O.PTS}, g AS (SELECT frame, frame * 400 AS x_mm, median(z_cm) FILTER (g = 1) AS ground_cm FROM pts GROUP BY frame), f AS (SELECT min(frame) AS f0, min(frame) FILTER (x_mm >= 1000) AS f1 FROM g)
SELECT g.frame AS frame, ground_cm, abs(ground_cm) <= 200 AS upright FROM g, f WHERE g.frame = f0 OR g.frame = f1""")
def flt13_guard(spark, sf_dir):
    """The frames at which the axes are checked, the first one and the first that lies a metre on (FLT13)."""
    p = points(spark, sf_dir).withColumn("x_m", F.col("frame") * 0.4)
    return evalmap.guard(p, far_m=1.0).select("frame", "ground_cm", "upright")


@register(f"""WITH {O.PTS} SELECT frame, count(*) AS points, count(*) FILTER (xv_mm >= -100000 AND xv_mm < 100000 AND yv_mm >= -100000 AND yv_mm < 100000) AS in_footprint,
count(*) FILTER (xv_mm >= -100000 AND xv_mm < 100000 AND yv_mm >= -100000 AND yv_mm < 100000 AND z_cm >= -200 AND z_cm < 600) AS in_layers FROM pts GROUP BY frame""")
def flt16_footprint(spark, sf_dir):
    """Points inside the baselines' square footprint, and inside the height layers of the dense one (FLT16, EXT2)."""
    inside = evalmap.in_footprint(F.col("xv_mm"), F.col("yv_mm"))
    return points(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("points"), F.count_if(inside).alias("in_footprint"), F.count_if(inside & evalmap.in_layers(F.col("z_cm"))).alias("in_layers"))


@register(f"""WITH {_bits()}, w AS (SELECT {_weight('trav', 'n < 1')} AS cost FROM bits), s(bits, cost) AS (SELECT a * 8 + b * 16 + c * 32, 1e0 + a * 2 + b * 3 + c * 4 FROM (VALUES (0), (1)) a(a), (VALUES (0), (1)) b(b), (VALUES (0), (1)) c(c))
SELECT w.cost AS cost, s.bits AS bits, count(*) AS cells FROM w LEFT JOIN s USING (cost) WHERE w.cost IS NOT NULL GROUP BY w.cost, s.bits""")
def agg25_from_cost(spark, sf_dir):
    """Costs taken apart into the soft bits that add up to them (AGG25); a null would be a cost that none explains."""
    return plan.from_cost(bits(spark, sf_dir).select(plan.cost(F.col("trav"), F.col("n") < 1).alias("cost")))


#: A planning window of 64 x 64 cells around the vehicle.
PLAN_N, X0, Y0 = 64, 2400 - 8000, -8000
SAMPLES = f"""pl AS (SELECT i, j, {X0} + i * 250 + du * 50 + 25 AS x, {Y0} + j * 250 + dv * 50 + 25 AS y FROM (SELECT unnest(range(0, {PLAN_N})) AS i) a, (SELECT unnest(range(0, {PLAN_N})) AS j) b, (SELECT unnest(range(0, 5)) AS du) c, (SELECT unnest(range(0, 5)) AS dv) d),
rg AS (SELECT *, greatest(abs(x - 2400), abs(y)) AS m FROM pl), rr AS (SELECT *, CASE WHEN m < 10000 THEN 0 WHEN m < 25000 THEN 1 WHEN m < 50000 THEN 2 WHEN m < 100000 THEN 3 END AS ring FROM rg),
sm AS (SELECT DISTINCT i, j, ring, CAST(floor(x / (50.0 * power(2, ring))) AS BIGINT) AS ix, CAST(floor(y / (50.0 * power(2, ring))) AS BIGINT) AS iy FROM rr WHERE ring IS NOT NULL)"""


def sampled(spark):
    return plan.samples(spark, S, X0, Y0, PLAN_N, PLAN_N, (2400, 0))


@register(f"WITH {SAMPLES} SELECT i, j, ring, ix, iy FROM sm")
def jn14_samples(spark, sf_dir):
    """Distinct map cells that each planning cell samples (JN14)."""
    return sampled(spark)


GRIDMAP = f"""{O.FOLD}, {SAMPLES}, gm AS (SELECT i, j, CAST(sum(n) AS BIGINT) AS n, sum(n * mu) / CAST(sum(n) AS DOUBLE) AS z_cm, sum(n * mu * mu) / CAST(sum(n) AS DOUBLE) AS sq,
 arg_max(cand, n * CAST(1000000000000 AS BIGINT) - (ring * 100000000 + (ix + 5000) * 10000 + iy + 5000)) AS cls, bit_or(CASE WHEN tv[code + 1] * {O.d(1e-4)} > {O.d(0.0025)} THEN 8 ELSE 0 END) AS soft FROM sm JOIN state USING (ring, ix, iy), (SELECT {O.TABLE} AS tv) t WHERE n >= 1 GROUP BY i, j),
gk AS (SELECT i, j, n, z_cm, greatest(0e0, sq - z_cm * z_cm) AS var_cm2, cls, soft FROM gm)"""


def lattice_sql(known: str) -> str:
    """SQL of the bits of all planning cells from a table of those known."""
    return f"""wi AS (SELECT i, j FROM (SELECT unnest(range(0, {PLAN_N})) AS i) a, (SELECT unnest(range(0, {PLAN_N})) AS j) b),
ne AS (SELECT w.i AS i, w.j AS j, coalesce(c.n, 0) AS n, c.z_cm AS z_cm, c.var_cm2 AS var_cm2, c.cls AS cls, coalesce(c.soft, 0) AS soft, e.z_cm AS ez, x.z_cm AS wz, u.z_cm AS uz, d.z_cm AS dz,
  CASE WHEN w.i IN (0, {PLAN_N - 1}) THEN 0e0 ELSE (e.z_cm - x.z_cm) / 100 / 0.5e0 END AS sx, CASE WHEN w.j IN (0, {PLAN_N - 1}) THEN 0e0 ELSE (u.z_cm - d.z_cm) / 100 / 0.5e0 END AS sy
  FROM wi w LEFT JOIN {known} c ON c.i = w.i AND c.j = w.j LEFT JOIN {known} e ON e.i = w.i + 1 AND e.j = w.j LEFT JOIN {known} x ON x.i = w.i - 1 AND x.j = w.j LEFT JOIN {known} u ON u.i = w.i AND u.j = w.j + 1 LEFT JOIN {known} d ON d.i = w.i AND d.j = w.j - 1),
lb AS (SELECT i, j, n, z_cm, var_cm2, cls, CAST(CASE WHEN coalesce(sqrt(sx * sx + sy * sy), 0) > {O.d(math.tan(math.radians(20.0)))} THEN 2 ELSE 0 END + CASE WHEN coalesce(greatest(abs(ez - z_cm), abs(wz - z_cm), abs(uz - z_cm), abs(dz - z_cm)), 0) > 15 THEN 4 ELSE 0 END
  + CASE WHEN coalesce(var_cm2, 0) > 25 OR (soft & 8) <> 0 THEN 8 ELSE 0 END + CASE WHEN coalesce(cls IN (8, 9, 10, 11, 16), false) THEN 0 ELSE 16 END + CASE WHEN n < 3 THEN 32 ELSE 0 END AS INT) AS trav, n = 0 AS unknown FROM ne)"""


def told(df):
    return df.withColumns({"z_cm": F.round("z_cm", 4), "var_cm2": F.round("var_cm2", 3)})


@register(f"WITH {GRIDMAP}, {lattice_sql('gk')} SELECT i, j, n, round(z_cm, 4) AS z_cm, round(var_cm2, 3) AS var_cm2, cls, trav, unknown FROM lb")
def qry07_gridmap(spark, sf_dir):
    """A planning window of the folded map with its bits, judged on the planning lattice (QRY7, STN9)."""
    return told(plan.lattice_bits(plan.gridmap(state(spark, sf_dir), sampled(spark)), PLAN_N, PLAN_N))


_REFGRID = f"""{O.PTS}, fine AS (SELECT CAST(floor(xw_mm / 50e0) AS BIGINT) AS fi, CAST(floor(yw_mm / 50e0) AS BIGINT) AS fj, frame, CAST(sum(z_cm) AS BIGINT) AS sz, count(*) AS n, arg_max(cls, point_id) AS cls FROM pts GROUP BY 1, 2, 3),
rf AS (SELECT fi, fj, CAST(sum(sz) AS BIGINT) AS sz, CAST(sum(n) AS BIGINT) AS n, coalesce(arg_min(cls, frame) FILTER (cls <> 0), 0) AS cls FROM fine GROUP BY fi, fj),
rp AS (SELECT (fi * 50 - ({X0})) // 250 AS i, (fj * 50 - ({Y0})) // 250 AS j, sz / CAST(n AS DOUBLE) AS m, cls FROM rf WHERE fi * 50 >= {X0} AND fj * 50 >= {Y0} AND fi * 50 < {X0 + PLAN_N * 250} AND fj * 50 < {Y0 + PLAN_N * 250}),
rc AS (SELECT i, j, cls, count(*) AS c FROM rp GROUP BY i, j, cls), rt AS (SELECT i, j, arg_max(cls, c * 100 - cls) AS cls FROM rc GROUP BY i, j),
rk AS (SELECT i, j, n, z_cm, v AS var_cm2, cls, 0 AS soft FROM (SELECT i, j, count(*) AS n, sum(m) / count(*) AS z_cm, greatest(0e0, sum(m * m) / count(*) - sum(m) / count(*) * (sum(m) / count(*))) AS v FROM rp GROUP BY i, j) JOIN rt USING (i, j))"""


def reference_grid(spark, sf_dir):
    """Known planning cells of the reference map: fine cells seen, their mean height and spread, most common class."""
    return plan.reference_cells(evalmap.reference(points(spark, sf_dir)), X0, Y0, PLAN_N, PLAN_N)


@register(f"WITH {_REFGRID}, {lattice_sql('rk')} SELECT i, j, n, round(z_cm, 4) AS z_cm, round(var_cm2, 3) AS var_cm2, cls, trav, unknown FROM lb")
def qry08_reference_lattice(spark, sf_dir):
    """The same window of the reference map with the same bits (QRY8, STN9)."""
    return told(plan.lattice_bits(reference_grid(spark, sf_dir), PLAN_N, PLAN_N))


def lattice_costs(df):
    """Bits of a window as the cost map of one tile."""
    return df.select(F.lit(0).alias("tile"), F.col("i").cast("int").alias("ix"), F.col("j").cast("int").alias("iy"), plan.cost(F.col("trav"), F.col("unknown")).alias("cost"), "unknown")


@register()
def qry13_window_regret(spark, sf_dir):
    """What planning on the folded map costs on the reference, for sixteen seeded queries on their common support (QRY13, QRY14, QRY16)."""
    mine = lattice_costs(plan.lattice_bits(plan.gridmap(state(spark, sf_dir), sampled(spark)), PLAN_N, PLAN_N))
    truth = lattice_costs(plan.lattice_bits(reference_grid(spark, sf_dir), PLAN_N, PLAN_N))
    support = plan.common_support([mine, truth])
    r = plan.regrets(plan.restrict(mine, support), plan.restrict(truth, support), plan.plan_queries(8, PLAN_N) + plan.plan_queries(8, PLAN_N, family="lateral"))
    return r.withColumns({c: F.round(c, 6) for c in ("best", "paid", "regret")})


@register(f"""WITH {_bits()}, a AS (SELECT tile, ix, iy, {_weight('trav', 'n < 1')} AS cost FROM bits), s AS (SELECT tile, ix, iy FROM bits WHERE n >= 2 AND (trav & 32) = 0)
SELECT a.tile AS tile, a.ix AS ix, a.iy AS iy, CASE WHEN s.ix IS NOT NULL THEN cost END AS cost FROM a LEFT JOIN s ON s.tile = a.tile AND s.ix = a.ix AND s.iy = a.iy""")
def qry14_restrict(spark, sf_dir):
    """Costs outside the common support are blocked (QRY14)."""
    b = bits(spark, sf_dir)
    c = b.select("tile", "ix", "iy", plan.cost(F.col("trav"), F.col("n") < 1).alias("cost"))
    known = b.filter((F.col("n") >= 2) & (F.col("trav").bitwiseAND(32) == 0)).select("tile", "ix", "iy")
    return plan.restrict(c, known)


_queries = [(f, k, *a, *b) for f in ("longitudinal", "lateral") for k, (a, b) in enumerate(plan.plan_queries(32, SIDE, family=f))]


@register(f"SELECT * FROM (VALUES {', '.join(str(q) for q in _queries)}) q(family, query, sx, sy, gx, gy)")
def qry16_plan_queries(spark, sf_dir):
    """Seeded starts and goals of both families (QRY16)."""
    return spark.createDataFrame(_queries, "family string, query int, sx int, sy int, gx int, gy int")


@register()
def agg28_regret_average(spark, sf_dir):
    """Mean and spread of the regret over 64 seeded queries on each tile; found and blocked ones counted (AGG28)."""
    queries = [(q[2:4], q[4:6]) for q in _queries]
    r = plan.regrets(costs(spark, sf_dir, False), costs(spark, sf_dir), queries)
    g = r.groupBy("tile").agg(F.count("*").alias("queries"), F.count_if(F.col("found")).alias("found"), F.count("regret").alias("finite"), F.avg("regret").alias("mean_regret"), F.stddev("regret").alias("sd"))
    return g.withColumn("blocked", F.col("queries") - F.col("found")).withColumns({c: F.round(c, 6) for c in ("mean_regret", "sd")})


@register(f"""WITH {VIS}, a AS (SELECT count(*) AS points FROM pts WHERE frame = 6), b AS (SELECT count(*) AS binned, count(DISTINCT (ring, ix, iy)) AS touched, count(*) FILTER ((raw_label & 65535) BETWEEN 250 AND 259) AS moving FROM binned WHERE frame = 6),
s AS (SELECT count(*) AS occupied, count(*) AS tested, count(*) FILTER (NOT in_view) AS out_of_view, count(*) FILTER (far AND touched) AS protected_cells, count(*) FILTER (far AND NOT touched) AS cleared, round(count(*) FILTER (far AND touched) / CAST(nullif(count(*) FILTER (far), 0) AS DOUBLE), 6) AS protected_fraction FROM th)
SELECT a.*, b.*, s.* FROM a, b, s""")
def agg30_step_counters(spark, sf_dir):
    """All counters of the last frame's step and the share of seen-through cells that were protected (AGG30, EXT19)."""
    from terrafold.plans.queries_image import seen

    b = binned(spark, sf_dir).filter("frame = 6")
    c = seen(spark, sf_dir)
    n = F.count_if(F.col("protected")) + F.count_if(F.col("through"))
    cleaned = c.agg(F.count("*").alias("occupied"), F.count("*").alias("tested"), F.count_if(~F.col("in_view")).alias("out_of_view"), F.count_if(F.col("protected")).alias("protected_cells"), F.count_if(F.col("through")).alias("cleared"), F.round(F.try_divide(F.count_if(F.col("protected")).cast("double"), n), 6).alias("protected_fraction"))
    seen_points = points(spark, sf_dir).filter("frame = 6").agg(F.count("*").alias("points"))
    of = b.agg(F.count("*").alias("binned"), F.count_distinct("ring", "ix", "iy").alias("touched"), F.count_if(scatter.moving(F.col("raw_label"))).alias("moving"))
    return seen_points.crossJoin(of).crossJoin(cleaned)  # one row each


@register()
def qry17_compare(spark, sf_dir):
    """Errors of both schedules and of a uniform one over the same points, with their memory (QRY17, AGG31)."""
    schedules = [S, C.load("5_10_50"), C.uniform(0.2)]
    e = evalmap.compare(points(spark, sf_dir), schedules)
    out = evalmap.summary(e, {s.name: round(s.total_cells * 12 / 1e6, 2) for s in schedules})
    return out.withColumns({c: F.round(c, 4) for c in ("worst_rmse_cm", "mean_rho")})


@register(f"""WITH {O.FOLD}{O.PROBES},
q AS (SELECT *, CASE WHEN m < 10000 THEN 0 WHEN m < 25000 THEN 1 WHEN m < 50000 THEN 2 WHEN m < 100000 THEN 3 END AS ring FROM (SELECT *, greatest(abs(x_mm - ego_x_mm), abs(y_mm - ego_y_mm)) AS m FROM probes)),
k AS (SELECT *, CAST(floor(x_mm / (50.0 * power(2, ring))) AS BIGINT) AS ix, CAST(floor(y_mm / (50.0 * power(2, ring))) AS BIGINT) AS iy,
  CAST(floor(x_mm / (25.0 * power(2, ring))) AS BIGINT) AS fx, CAST(floor(y_mm / (25.0 * power(2, ring))) AS BIGINT) AS fy FROM q)
SELECT query_id, k.ring AS ring, CAST(CASE WHEN s.ring >= 1 AND (s.ix + s.iy) % 7 = 0 THEN s.mu + 10 * ((fy % 2 + 2) % 2 * 2 + (fx % 2 + 2) % 2) ELSE s.mu END AS INT) AS ground_cm
FROM k LEFT JOIN state s ON s.ring = k.ring AND s.ix = k.ix AND s.iy = k.iy""")
def qry02_refined(spark, sf_dir):
    """Lookups that go on to a refined cell's child (QRY2, JN11); every seventh cell has children, 10 cm apart."""
    from terrafold.operators import query
    from terrafold.plans.registry import probes

    s = state(spark, sf_dir)
    kids = s.filter((F.col("ring") >= 1) & ((F.col("ix") + F.col("iy")) % 7 == 0)).select("ring", "ix", "iy", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("child"), "mu")
    kids = kids.withColumn("mu", F.col("mu") + 10 * F.col("child"))
    return query.lookup(probes(spark, sf_dir), s, S, None, kids).select("query_id", "ring", "ground_cm")
