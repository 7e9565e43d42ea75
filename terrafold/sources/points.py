"""Points out of tables: a deterministic view of lineitem in whole millimetres, and dense fields for stencils.

Only projections: every column comes from its own row, so the view scales like its scan and filters and column pruning
reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The view in SQL; ``{div}`` is integer division that truncates, the only difference between the engines.
SQL = """
SELECT frame, point_id, xv_mm, yv_mm, xv_mm + 400 * frame AS xw_mm, yv_mm AS yw_mm, z_cm, cls,
       CASE WHEN cls IN (8, 9, 10, 11, 16) THEN 1 ELSE 0 END AS g, refl, raw_label
FROM (
  SELECT CAST(l_linenumber - 1 AS INT) AS frame,
         l_orderkey * 1000003 + (l_partkey * 1009 + l_suppkey * 61 + CAST(l_quantity AS BIGINT)) % 1000003 AS point_id,
         ((p - 1000) * abs(p - 1000)) {div} 10 + 3 AS xv_mm,
         ((q - 50) * 20 * abs(q - 50) * 20) {div} 10 + 7 AS yv_mm,
         CAST(l_quantity AS BIGINT) * 16 - 208 + CAST(l_linenumber AS BIGINT) AS z_cm,
         CAST((l_partkey + l_suppkey) % 19 AS INT) AS cls, (l_orderkey * 7) % 256 AS refl,
         CAST((l_partkey + l_orderkey) % 262 AS INT) AS raw_label
  FROM (SELECT *, (l_partkey * 131 + l_orderkey * 17) % 2000 AS p, (l_suppkey * 7 + l_partkey + l_orderkey * 3) % 100 AS q FROM {lineitem}) s) t
"""
DUCK = SQL.format(div="//", lineitem="lineitem")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, point_id, vehicle and world position (mm), height (cm), class, ground flag, reflectivity, raw label."""
    return spark.sql(SQL.format(div="div", lineitem="{lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


#: A dense field of SIDE x SIDE cells per tile (one tile per supplier modulo 8): heights from an integer terrain formula.
SIDE = 48
FIELD = """
SELECT tile, ix, iy, ground_cm, ceiling_cm, code, n, cand, cnt, CASE WHEN (ix * 5 + iy * 3 + tile) % 61 = 0 THEN 4 ELSE 0 END AS flags
FROM (
  SELECT tile, ix, iy, CASE WHEN (ix + 2 * iy + tile) % 37 = 0 THEN 0 ELSE 1 + (ix * iy + tile) % 9 END AS n,
         CASE WHEN iy > 30 THEN 12 ELSE 0 END + CASE WHEN ix BETWEEN 10 AND 12 AND iy BETWEEN 10 AND 12 THEN -30 ELSE 0 END
           + (ix * (tile % 3)) {div} 4 + bump AS ground_cm,
         CASE WHEN (ix + iy) % 11 = 0 THEN 150 ELSE 32767 END AS ceiling_cm,
         170 + (ix * 3 + iy + tile) % 80 AS code, (ix {div} 8 + iy {div} 8 + tile) % 19 AS cand, (ix + iy) % 8 AS cnt
  FROM (SELECT tile, bump, ix, iy FROM (SELECT s_suppkey % 8 AS tile, CAST(max(s_suppkey) % 3 AS BIGINT) AS bump FROM {supplier} GROUP BY s_suppkey % 8) s
        CROSS JOIN (SELECT {xs} AS ix) a CROSS JOIN (SELECT {ys} AS iy) b) f) g
"""
DUCK_FIELD = FIELD.format(div="//", supplier="supplier", xs=f"unnest(range(0, {SIDE}))", ys=f"unnest(range(0, {SIDE}))")


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense lattice of cells (tile, ix, iy, ...) for stencil, pyramid and planning operators; its size is fixed."""
    seq = f"explode(sequence(0L, {SIDE - 1}L))"
    return spark.sql(FIELD.format(div="div", supplier="{supplier}", xs=seq, ys=seq), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
