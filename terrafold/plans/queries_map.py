"""Queries on cells: stencils, features, confidence, pyramid, split and merge, overlays."""

from __future__ import annotations


from pyspark.sql import functions as F

from terrafold import config as C
from terrafold.operators import fold, pyramid, scatter, stencil
from terrafold.plans import oracle as O
from terrafold.plans.registry import S, binned, field, points, register, state
from terrafold.sources.points import SIDE

CELL = 0.20
K = C.stencil_k(CELL, C.THRESHOLDS["baseline_m"])
T = C.THRESHOLDS
TAN = O.d(stencil.TAN)


def _bits() -> str:
    ax = O.axes(K).replace("{cell}", O.d(CELL))
    return f"""{O.FIELD}, ax AS ({ax}), bits AS (
  SELECT tile, ix, iy, ground_cm, ceiling_cm, code, n, cand, cnt, flags, CAST(
    CASE WHEN ceiling_cm - ground_cm < 180 THEN 1 ELSE 0 END + CASE WHEN seen AND sqrt(dx * dx + dy * dy) > {TAN} THEN 2 ELSE 0 END + CASE WHEN seen AND step > 15 THEN 4 ELSE 0 END
    + CASE WHEN tv[code + 1] * {O.d(1e-4)} > {O.d(0.0025)} THEN 8 ELSE 0 END + CASE WHEN cand NOT IN (8, 9, 10, 11, 16) THEN 16 ELSE 0 END + CASE WHEN n < 3 OR {O.EDGE} THEN 32 ELSE 0 END AS INT) AS trav
  FROM ax, (SELECT {O.TABLE} AS tv) t)"""


def bits(spark, sf_dir):
    return stencil.bits(field(spark, sf_dir), SIDE, CELL)


@register(f"WITH {_bits()} SELECT tile, ix, iy, trav FROM bits")
def stn01_bitfield(spark, sf_dir):
    return bits(spark, sf_dir).select("tile", "ix", "iy", "trav")


@register(f"WITH {_bits()} SELECT bit, count(*) AS blocked FROM bits, (VALUES (1), (2), (4), (8), (16), (32)) b(bit) WHERE (trav & bit) <> 0 GROUP BY bit")
def agg25_bit_breakdown(spark, sf_dir):
    """Cells with each bit (AGG25); one pass, a row for each set bit."""
    each = F.explode(F.filter(F.array(*map(F.lit, (1, 2, 4, 8, 16, 32))), lambda b: F.col("trav").bitwiseAND(b) != 0))
    return bits(spark, sf_dir).select(each.alias("bit")).groupBy("bit").agg(F.count("*").alias("blocked"))


@register(f"WITH {_bits()} SELECT tile, count(*) AS cells, count(*) FILTER (trav = 0) AS free, count(*) FILTER (trav & 63 <> 0) AS blocked FROM bits GROUP BY tile")
def flt06_free_space(spark, sf_dir):
    """Traversable cells per tile (FLT6)."""
    return bits(spark, sf_dir).groupBy("tile").agg(F.count("*").alias("cells"), F.count_if(F.col("trav") == 0).alias("free"), F.count_if(F.col("trav") != 0).alias("blocked"))


UNIT = lambda e: f"greatest(0e0, least(1e0, {e}))"
MARGINS = f"""{O.FIELD}, ax AS ({O.axes(K).replace('{cell}', O.d(CELL))}), mg AS (
  SELECT *, CASE WHEN n >= 1 THEN {UNIT('(n + cnt) / (2e0 * n)')} ELSE 0e0 END AS class_share, CASE WHEN (flags & 4) <> 0 THEN 0e0 ELSE {UNIT('n / 3e0')} END AS evidence,
         {UNIT(f'least(1e0 - sqrt(dx * dx + dy * dy) / {TAN}, 1e0 - step / 100e0 / {O.d(0.15)})')} AS geometry, {UNIT(f'1e0 - tv[code + 1] * {O.d(1e-4)} / {O.d(0.0025)}')} AS surface
  FROM ax, (SELECT {O.TABLE} AS tv) t),
cf AS (SELECT *, CASE WHEN cand IN (8, 9, 10, 11, 16) THEN least(class_share, evidence, geometry, surface) ELSE 0e0 END AS confidence FROM mg)"""


@register(f"WITH {MARGINS} SELECT tile, ix, iy, round(class_share, 6) AS class_share, round(evidence, 6) AS evidence, round(geometry, 6) AS geometry, round(surface, 6) AS surface, round(confidence, 6) AS confidence FROM cf")
def stn08_margins(spark, sf_dir):
    m = stencil.margins(field(spark, sf_dir), CELL)
    return m.select("tile", "ix", "iy", *(F.round(c, 6).alias(c) for c in ("class_share", "evidence", "geometry", "surface", "confidence")))


@register(f"""WITH {MARGINS}, low AS (SELECT *, [CASE WHEN cand IN (8, 9, 10, 11, 16) THEN 9e0 ELSE -1e0 END, class_share, evidence, geometry, surface] AS v FROM cf WHERE n >= 1),
b AS (SELECT tile, confidence, list_position(v, list_min(v)) - 1 AS binding FROM low),
c AS (SELECT tile, binding, count(*) AS c FROM b GROUP BY tile, binding), top AS (SELECT tile, CAST(arg_max(binding, c * 10 - binding) AS INT) AS binding FROM c GROUP BY tile)
SELECT tile, count(*) AS cells, round(avg(confidence), 6) AS mean, round(avg(CAST(confidence >= 0.8 AS INT)), 6) AS high, round(avg(CAST(confidence < 0.2 AS INT)), 6) AS low, any_value(top.binding) AS binding FROM b JOIN top USING (tile) GROUP BY tile""")
def agg14_confidence(spark, sf_dir):
    return stencil.summarise(stencil.margins(field(spark, sf_dir), CELL))


KC, RIM = C.stencil_k(CELL, T["curb_baseline_m"]), C.rim_r(CELL)
KERBS = f"""{O.FIELD}, ok AS MATERIALIZED (SELECT CAST(tile * 10000 + ix * 100 + iy AS BIGINT) AS key, tile, ix, iy, ground_cm AS z FROM field WHERE n >= 1 AND (flags & 4) = 0),
ew AS MATERIALIZED (SELECT c.*, e.z - w.z AS dx FROM ok c JOIN ok e ON e.key = c.key + {100 * KC} JOIN ok w ON w.key = c.key - {100 * KC}),
g AS MATERIALIZED (SELECT c.*, u.z - s.z AS dy FROM ew c JOIN ok u ON u.key = c.key + {KC} JOIN ok s ON s.key = c.key - {KC}),
o AS MATERIALIZED (SELECT *, dx * dx + dy * dy AS r2, (CAST(round_even(atan2(CAST(dy AS DOUBLE), CAST(dx AS DOUBLE)) / (pi() / 4), 0) AS INT) + 8) % 8 AS octant FROM g WHERE dx * dx + dy * dy BETWEEN 25 AND 625),
t AS MATERIALIZED (SELECT *, [100, 101, 1, -99, -100, -101, -1, 99][(octant + 2) % 8 + 1] AS turn FROM o),
f AS MATERIALIZED (SELECT t.*, key + turn AS k1, key - turn AS k2 FROM t)"""


@register(f"""WITH {KERBS} SELECT f.tile AS tile, f.ix AS ix, f.iy AS iy, round(sqrt(f.r2), 6) AS height_cm, f.octant AS octant FROM f JOIN o a ON a.key = f.k1 JOIN o b ON b.key = f.k2
WHERE abs((a.octant - f.octant + 12) % 8 - 4) <= 1 AND abs((b.octant - f.octant + 12) % 8 - 4) <= 1""")
def stn03_kerbs(spark, sf_dir):
    return stencil.kerbs(field(spark, sf_dir), SIDE, CELL).withColumn("height_cm", F.round("height_cm", 6))


_dirs = ", ".join(f"({i}, {a * RIM}, {b * RIM})" for i, (a, b) in enumerate(stencil.OCTANTS))


@register(f"""WITH {O.FIELD}, ok AS MATERIALIZED (SELECT tile, ix, iy, ground_cm AS z, n >= 1 AND (flags & 4) = 0 AS ok FROM field), dirs(o, dx, dy) AS (VALUES {_dirs}),
r AS (SELECT c.tile AS tile, c.ix AS ix, c.iy AS iy, c.z AS z, o % 4 AS axis, x.z AS rz, x.ok AS rok FROM ok c, dirs JOIN ok x ON x.tile = c.tile AND x.ix = c.ix + dx AND x.iy = c.iy + dy
      WHERE c.ok AND c.ix BETWEEN {RIM} AND {SIDE - 1 - RIM} AND c.iy BETWEEN {RIM} AND {SIDE - 1 - RIM}),
p AS (SELECT *, count(*) FILTER (rok) OVER (PARTITION BY tile, ix, iy, axis) = 2 AS paired FROM r),
m AS (SELECT tile, ix, iy, z, median(rz) AS med, max(rz) - min(rz) AS spread, count(*) // 2 AS pairs, list(rz) AS rim FROM p WHERE paired GROUP BY tile, ix, iy, z)
SELECT tile, ix, iy, med - z AS depth_cm, CAST(pairs AS INT) AS rim_pairs FROM m
WHERE pairs >= 2 AND med - z BETWEEN 8 AND 50 AND spread <= 8 AND len(list_filter(rim, lambda q: med - q > 4)) <= 0.5 * pairs""")
def stn04_potholes(spark, sf_dir):
    return stencil.potholes(field(spark, sf_dir), SIDE, CELL)


PYR = f"""{_bits()}, lv(level) AS (VALUES (0), (1), (2), (3), (4), (5), (6)),
pyr AS (SELECT tile, level, ix >> level AS bx, iy >> level AS by_, max(ground_cm) AS h_max, min(ground_cm) AS h_min, min(ceiling_cm) AS c_min, min(n) AS n_min, bit_and(trav) AS and_mask, bit_or(trav) AS or_mask
        FROM bits, lv GROUP BY ALL)"""


@register(f"""WITH {PYR} SELECT * EXCLUDE (by_), by_ AS "by", h_max - h_min < 15 AND c_min - h_max > 180 AND n_min >= 3 AS safe, CASE WHEN or_mask = 0 THEN 0 WHEN and_mask <> 0 THEN 1 ELSE 2 END AS lod FROM pyr""")
def agg12_pyramid(spark, sf_dir):
    """Blocks of all levels with their certainly-safe flag and class (AGG12, FLT10)."""
    p = pyramid.build(bits(spark, sf_dir), 6)
    return p.withColumn("safe", pyramid.theorem_safe()).withColumn("lod", pyramid.classify())


@register(f"""WITH {PYR}, c AS (SELECT tile, CASE WHEN or_mask = 0 THEN 0 WHEN and_mask <> 0 THEN 1 ELSE 2 END AS lod FROM pyr WHERE level = 2 AND bx BETWEEN 2 AND 6 AND by_ BETWEEN 3 AND 7)
SELECT tile, CASE WHEN min(lod) = max(lod) THEN min(lod) ELSE 2 END AS lod, count(*) AS blocks FROM c GROUP BY tile""")
def qry04_box(spark, sf_dir):
    """Conservative answer for a box of cells (QRY4)."""
    return pyramid.query_box(pyramid.build(bits(spark, sf_dir), 6), 2, 8, 12, 27, 31)


_SPLIT = f"tv[code + 1] * {O.d(1e-4)} + {O.d(0.0625)} * grad * grad * {O.d(0.20**2 - 0.10**2)} + 0e0"


@register(f"""WITH {O.FIELD}, g AS (SELECT *, (ix % 5) / 10e0 AS grad FROM field)
SELECT tile, ix, iy, child, round(ground_cm / 100e0, 6) AS mu_m, round({_SPLIT}, 9) AS sigma2_m2, n, (flags | 1) & ~2 AS flags FROM g, (SELECT unnest(range(0, 4)) AS child) c, (SELECT {O.TABLE} AS tv) t""")
def st16_split(spark, sf_dir):
    s = pyramid.split(field(spark, sf_dir), 0.20, 0.10, (F.col("ix") % 5) / 10.0)
    return s.withColumn("mu_m", F.round("mu_m", 6)).withColumn("sigma2_m2", F.round("sigma2_m2", 9)).withColumn("child", F.col("child").cast("bigint"))


@register(f"""WITH {O.FIELD}, c AS (SELECT tile, ix >> 1 AS px, iy >> 1 AS py, ground_cm / 100e0 AS mu, tv[code + 1] * {O.d(1e-4)} AS v, n, flags FROM field, (SELECT {O.TABLE} AS tv) t),
w AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY tile, px, py) > 0 THEN n ELSE 1 END AS w FROM c),
m AS (SELECT tile, px, py, sum(w * mu) / sum(w) AS mu, sum(w * v) / sum(w) AS within, sum(w * mu * mu) / sum(w) AS sq, min(n) AS n, bit_and(flags & 5) | bit_or(flags & 8) AS flags FROM w GROUP BY tile, px, py)
SELECT tile, px, py, round(mu, 6) AS mu_m, round(within + greatest(0e0, sq - mu * mu), 6) AS sigma2_m2, n, flags FROM m""")
def agg11_merge(spark, sf_dir):
    """Parents of 2 x 2 cells by the law of total variance (AGG11)."""
    f = field(spark, sf_dir)
    c = f.select("tile", F.expr("shiftright(ix, 1)").alias("px"), F.expr("shiftright(iy, 1)").alias("py"), (F.col("ground_cm") / 100.0).alias("mu_m"), (pyramid.variance_cm2(F.col("code").cast("int")) * 1e-4).alias("sigma2_m2"), "n", "flags")
    return pyramid.merge(c, ["tile", "px", "py"]).withColumn("mu_m", F.round("mu_m", 6)).withColumn("sigma2_m2", F.round("sigma2_m2", 6))


@register(f"""WITH {_bits()} SELECT tile, ix, iy FROM bits, (SELECT {O.TABLE} AS tv) t
WHERE cand IN (1, 2, 5, 6, 7, 17, 18) OR (ix + iy) % 13 = 0 OR ((trav & 6) <> 0 AND tv[code + 1] * {O.d(1e-4)} > {O.d(0.0025)})""")
def flt08_gate(spark, sf_dir):
    """Cells that ask for refinement (FLT8)."""
    return bits(spark, sf_dir).filter(pyramid.gate((F.col("ix") + F.col("iy")) % 13 == 0)).select("tile", "ix", "iy")


@register(f"""WITH {O.BINNED} SELECT frame, count(*) AS binned, count(*) FILTER ((raw_label & 65535) BETWEEN 250 AND 259) AS moving, count(DISTINCT (ring, ix, iy)) AS touched FROM binned GROUP BY frame""")
def agg30_counters(spark, sf_dir):
    """Counters of each frame (AGG30, FLT2)."""
    return binned(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("binned"), F.count_if(scatter.moving(F.col("raw_label"))).alias("moving"), F.count_distinct("ring", "ix", "iy").alias("touched"))


_WORD = "CAST('0x' || substr(md5(concat_ws(',', ring, ix, iy, last_frame, mu, code, ceil, odds, cand, cnt, refl, n)), 1, 15) AS BIGINT)"


@register(f"WITH {O.FOLD} SELECT ring, count(*) AS cells, CAST(sum(mu) AS BIGINT) AS heights, CAST(sum(n) AS BIGINT) AS returns, bit_xor({_WORD}) AS digest FROM state GROUP BY ring")
def agg22_map_hash(spark, sf_dir):
    """An order-free digest of the map per ring (AGG22): that of all fields of all cells, however rows are dealt."""
    fields = [F.col(c).cast("string") for c in ("ring", "ix", "iy", "last_frame", *fold.FIELDS)]
    word = F.conv(F.substring(F.md5(F.concat_ws(",", *fields).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return state(spark, sf_dir).groupBy("ring").agg(F.count("*").alias("cells"), F.sum("mu").alias("heights"), F.sum("n").alias("returns"), F.bit_xor(word).alias("digest"))


@register(f"""WITH {O.PTS} SELECT CAST(floor(xw_mm / 2e3) AS BIGINT) AS i, CAST(floor(yw_mm / 2e3) AS BIGINT) AS j, arg_max(z_cm, frame * 1000000000000000 + point_id) AS z_cm, least(count(*), 255) AS n, count(DISTINCT z_cm // 16) AS voxels
FROM pts GROUP BY i, j""")
def agg27_baselines(spark, sf_dir):
    """Last return and saturating count of a uniform grid, and voxels of a dense one (AGG27, EXT1, FLT16)."""
    p = points(spark, sf_dir).withColumn("i", F.floor(F.col("xw_mm") / 2e3)).withColumn("j", F.floor(F.col("yw_mm") / 2e3))
    return p.groupBy("i", "j").agg(F.max_by("z_cm", F.struct("frame", "point_id")).alias("z_cm"), F.least(F.count("*"), F.lit(255).cast("bigint")).alias("n"), F.count_distinct(F.expr("z_cm div 16")).alias("voxels"))


@register("""WITH e AS (SELECT event_type AS stage, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT stage, max(CASE WHEN k = CAST(ceil(0.5 * (n - 1)) AS BIGINT) + 1 THEN ms END) AS p50, max(CASE WHEN k = CAST(ceil(0.99 * (n - 1)) AS BIGINT) + 1 THEN ms END) AS p99, max(ms) AS worst, max(n) AS n, round(1000 / max(CASE WHEN k = CAST(ceil(0.5 * (n - 1)) AS BIGINT) + 1 THEN ms END), 4) AS fps FROM e GROUP BY stage""")
def agg21_timer(spark, sf_dir):
    """Observed percentiles of timings per stage: the sample at or above the rank (AGG21, WF7).

    Equal values are counted first, so a stage's window holds its distinct values only, not its samples.
    """
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("stage"), F.col("value").alias("ms")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("stage")
    e = e.withColumn("upto", F.sum("c").over(w.orderBy("ms"))).withColumn("n", F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * (F.col("n") - 1)) + 1, F.col("ms")))
    return e.groupBy("stage").agg(at(F.lit(0.5)).alias("p50"), at(F.lit(0.99)).alias("p99"), F.max("ms").alias("worst"), F.max("n").alias("n"), F.round(1000 / at(F.lit(0.5)), 4).alias("fps"))


