"""The same rows in SQL of another engine, written apart from the DataFrame operators."""

from __future__ import annotations

from terrafold.config import LOG_RANGE, THRESHOLDS as T
from terrafold.config import VARIANCE
from terrafold.functions.sensor import SIGMA_PHI
from terrafold.sources.points import DUCK, DUCK_FIELD, SIDE


def d(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


PTS = f"pts AS ({DUCK})"
BINNED = (
    PTS
    + """, ringed AS (
  SELECT *, CASE WHEN m < 10000 THEN 0 WHEN m < 25000 THEN 1 WHEN m < 50000 THEN 2 WHEN m < 100000 THEN 3 END AS ring
  FROM (SELECT *, greatest(abs(xv_mm), abs(yv_mm)) AS m FROM pts)),
binned AS (
  SELECT *, CAST(floor(xw_mm / (50.0 * power(2, ring))) AS BIGINT) AS ix, CAST(floor(yw_mm / (50.0 * power(2, ring))) AS BIGINT) AS iy
  FROM ringed WHERE ring IS NOT NULL)"""
)
R = "(sqrt(CAST(xv_mm * xv_mm + yv_mm * yv_mm + z_cm * z_cm * 100 AS DOUBLE)) / 1000)"


def variance(r: str) -> str:
    r = f"greatest({r}, {d(1e-3)})"
    h = f"({d(T['sensor_height_m'])} / {r})"
    return f"(({h} * {h} * {d(T['sigma_r_m'] ** 2)} + {r} * {r} * {d(SIGMA_PHI**2)}) / (1e0 * 1e0) * 1e4)"


def weight(var: str) -> str:
    return f"CAST(least(greatest(round_even(1024e0 / greatest({var}, 1e-9), 0), 1e0), 1048576e0) AS BIGINT)"


SCATTER = (
    BINNED
    + f""", weighted AS (SELECT *, {weight(variance(R))} AS w FROM binned),
cells AS (
  SELECT frame, ring, ix, iy, CAST(sum(w * g * z_cm) AS BIGINT) AS wz_sum, CAST(sum(w * g) AS BIGINT) AS w_sum, count(*) AS n,
         CAST(sum(refl) AS BIGINT) AS refl_sum, min(CASE WHEN g = 0 THEN z_cm ELSE 32767 END) AS ceiling_cm, arg_min(cls, point_id) AS cls
  FROM weighted GROUP BY frame, ring, ix, iy)"""
)
MEAN = "CASE WHEN w_sum > 0 THEN CAST(sign(wz_sum) AS BIGINT) * ((2 * abs(wz_sum) + w_sum) // (2 * w_sum)) ELSE 0 END"


def code_of(v: str, table: str) -> str:
    """Code of a variance inside a lambda; the table of codes is a list column."""
    guess = f"CAST(greatest(0e0, least(255e0, floor(255 * ln({d(640000.0)} / v) / {d(LOG_RANGE)}))) AS BIGINT)"
    pick = f"CASE WHEN p.v <= {table}[least(p.g + 1, 255) + 1] THEN least(p.g + 1, 255) WHEN p.v > {table}[p.g + 1] AND p.g > 0 THEN p.g - 1 ELSE p.g END"
    return f"list_transform(list_transform([greatest({v}, 1e-12)], lambda v: {{'v': v, 'g': {guess}}}), lambda p: {pick})[1]"


TABLE = "[" + ", ".join(d(v) for v in VARIANCE) + "]"
_ITEM = "{{'frame': {f}, 'z': {z}, 'w': {w}, 'c': {c}, 'refl': {r}, 'ceil': {e}, 'cls': {k}, 'mu': {m}, 'code': {o}, 'odds': {l}, 'cand': {a}, 'cnt': {t}, 'n': {n}}}"
_b = lambda x: f"CAST({x} AS BIGINT)"
_OBS = _ITEM.format(f=_b("frame"), z=_b(MEAN), w=_b("w_sum"), c=_b("n"), r=_b("refl_sum"), e=_b("ceiling_cm"), k=_b("cls"), m=_b(0), o=_b(0), l=_b(0), a=_b(0), t=_b(0), n=_b(0))
_INIT = _ITEM.format(f=_b(-1), z=_b(0), w=_b(0), c=_b(0), r=_b(0), e=_b(32767), k=_b(0), m=_b(0), o=_b(0), l=_b(0), a=_b(0), t=_b(0), n=_b(0))
_PRIOR = f"(tv[a.code + 1] + {d(T['process_noise_m2_per_s'] * 1e4 * T['frame_dt_s'])})"
_MEAS = "(1024e0 / CAST(greatest(y.w, 1) AS DOUBLE))"
_GAIN = f"({_PRIOR} / ({_PRIOR} + {_MEAS}))"
_STEP = _ITEM.format(
    f="y.frame", z="y.z", w="y.w", c="y.c", r=_b("greatest(0, least(255, y.refl // y.c))"), e="least(a.ceil, y.ceil)", k="y.cls",
    m=_b(f"CASE WHEN y.w <= 0 THEN CAST(a.mu AS DOUBLE) WHEN a.n = 0 THEN CAST(y.z AS DOUBLE) ELSE round_even(a.mu + {_GAIN} * (y.z - a.mu), 0) END"),
    o=_b(code_of(f"CASE WHEN y.w <= 0 THEN {_PRIOR} WHEN a.n = 0 THEN {_MEAS} ELSE (1e0 - {_GAIN}) * {_PRIOR} END", "tv")),
    l="least(a.odds + 4, 63)", a="CASE WHEN a.cnt = 0 THEN y.cls ELSE a.cand END",
    t="CASE WHEN a.cnt = 0 THEN 1 WHEN a.cand = y.cls THEN least(a.cnt + 1, 7) ELSE a.cnt - 1 END", n="least(a.n + y.c, 255)",
)
FOLD = (
    SCATTER
    + f""", lists AS (SELECT ring, ix, iy, list({_OBS} ORDER BY frame) AS obs, max(frame) AS last_frame FROM cells GROUP BY ring, ix, iy),
folded AS (SELECT ring, ix, iy, last_frame, list_reduce(obs, lambda a, y: {_STEP}, {_INIT}) AS s FROM lists, (SELECT {TABLE} AS tv) t),
state AS (
  SELECT ring, ix, iy, last_frame, CAST(s.mu AS INT) AS mu, CAST(s.code AS INT) AS code, CAST(s.ceil AS INT) AS ceil, CAST(s.odds AS INT) AS odds,
         CAST(s.cand AS INT) AS cand, CAST(s.cnt AS INT) AS cnt, CAST(s.refl AS INT) AS refl, CAST(s.n AS INT) AS n FROM folded)"""
)
TRANSIENT = """, transient AS (
  SELECT frame, ring, ix, iy, greatest(max(least(greatest(z_cm, -200), 600)), 0) AS top_cm FROM binned
  WHERE (raw_label & 65535) BETWEEN 250 AND 259 GROUP BY frame, ring, ix, iy)"""
OCC = "CASE WHEN n < 1 THEN 0 WHEN odds > 0 THEN 2 ELSE 1 END"
PROBES = """, probes AS (
  SELECT c_custkey AS query_id, ((c_custkey * 7919) % 200000) - 100000 + 2400 AS x_mm, ((c_custkey * 104729) % 200000) - 100000 AS y_mm,
         CAST(2400 AS BIGINT) AS ego_x_mm, CAST(0 AS BIGINT) AS ego_y_mm FROM customer
  UNION ALL
  SELECT 1000000000 + point_id AS query_id, xw_mm AS x_mm, yw_mm AS y_mm, CAST(2400 AS BIGINT), CAST(0 AS BIGINT) FROM pts WHERE frame = 6)"""

FIELD = f"field AS ({DUCK_FIELD})"


def axes(k: int, extra: str = "") -> str:
    """field with its neighbours' heights and counts at +-k, null outside."""
    side = lambda name, dx, dy: f"LEFT JOIN field {name} ON {name}.tile = c.tile AND {name}.ix = c.ix + {dx} AND {name}.iy = c.iy + {dy}"
    joins = " ".join(side(n, dx * k, dy * k) for n, dx, dy in (("e", 1, 0), ("w", -1, 0), ("nn", 0, 1), ("s", 0, -1)))
    z = lambda a: f"coalesce({a}.ground_cm, c.ground_cm)"
    o = lambda a: f"coalesce({a}.n, c.n)"
    span = lambda a, b: f"(CASE WHEN {a}.tile IS NULL THEN 0 ELSE {k} END + CASE WHEN {b}.tile IS NULL THEN 0 ELSE {k} END)"
    return f"""SELECT c.*, least(c.n, {o('e')}, {o('w')}, {o('nn')}, {o('s')}) >= 1 AS seen,
      greatest(abs({z('e')} - c.ground_cm), abs({z('w')} - c.ground_cm), abs({z('nn')} - c.ground_cm), abs({z('s')} - c.ground_cm)) AS step,
      ({z('e')} - {z('w')}) / 100e0 / ({span('e', 'w')} * {{cell}}) AS dx, ({z('nn')} - {z('s')}) / 100e0 / ({span('nn', 's')} * {{cell}}) AS dy {extra}
    FROM field c {joins}"""


EDGE = f"(ix = 0 OR iy = 0 OR ix = {SIDE - 1} OR iy = {SIDE - 1})"
