"""Cost maps, paths and regret (QRY7-17, AGG28-31, WF9, JN14, JN16, JN18).

Cost maps are plain expressions. A path search is sequential, so each (map, start, goal) is one group in Python; a planning
lattice is a fixed window of some thousand cells whatever the size of the map.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.config import THRESHOLDS as T
from terrafold.config import Schedule, stencil_k
from terrafold.functions import lattice as L
from terrafold.functions.sensor import variance_cm2
from terrafold.operators.stencil import gather

DIAGONAL = math.sqrt(2.0)
STEPS = [(dx, dy, DIAGONAL if dx and dy else 1.0) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
PATHS = "tile int, found boolean, cost double, steps int, path array<struct<ix:int,iy:int>>"


def cost(trav: Column, unknown: Column) -> Column:
    """Weight of a planning cell; null where it can't be crossed (FLT11). Roughness, class and doubt add up."""
    bit = lambda b: trav.bitwiseAND(b) != 0
    soft = F.lit(T["w_base"]) + F.when(bit(8), T["w_roughness"]).otherwise(0.0) + F.when(bit(16), T["w_class"]).otherwise(0.0)
    return F.when(~(bit(1) | bit(2) | bit(4)), soft + F.when(unknown | bit(32), T["w_unknown"]).otherwise(0.0))


def costmap(cells: DataFrame, factor: int) -> DataFrame:
    """Planning cells of factor x factor map cells: count-weighted height, spread between cells, class of the largest count,
    soft bits (QRY7); columns tile, i, j, n, z_cm, var_cm2, cls, soft."""
    c = cells.filter("n >= 1").withColumn("i", F.floor(F.col("ix") / factor)).withColumn("j", F.floor(F.col("iy") / factor))
    g = c.groupBy("tile", "i", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("ground_cm")).alias("s1"), F.sum(F.col("n") * F.col("ground_cm") * F.col("ground_cm")).alias("s2"),
        F.max_by("cand", F.struct("n", -F.col("ix"), -F.col("iy"))).alias("cls"), F.bit_or(F.col("trav").bitwiseAND(24)).alias("soft"),
    )
    z = F.col("s1") / F.col("n")
    return g.select("tile", "i", "j", "n", z.alias("z_cm"), (F.col("s2") / F.col("n") - z * z).alias("var_cm2"), "cls", "soft")


def samples(spark: SparkSession, s: Schedule, x0_mm: int, y0_mm: int, nx: int, ny: int, ego_mm: tuple[int, int], cell_mm: int = round(1000 * T["plan_cell_m"]), per_side: int = 5) -> DataFrame:
    """The distinct map cells that each planning cell (i, j) of a window samples, per_side x per_side points each (JN14).

    A window is a fixed number of cells around the vehicle, whatever the size of the map.
    """
    w = spark.range(nx * ny).select((F.col("id") % nx).alias("i"), F.expr(f"id DIV {nx}").alias("j"))
    step = cell_mm // per_side
    at = F.explode(F.sequence(F.lit(0), F.lit(per_side - 1)))
    w = w.withColumn("du", at).withColumn("dv", at)
    x, y = (F.lit(o).cast("bigint") + F.col(c) * cell_mm + F.col(d) * step + step // 2 for o, c, d in ((x0_mm, "i", "du"), (y0_mm, "j", "dv")))
    w = w.select("i", "j", x.alias("x"), y.alias("y"))
    w = w.withColumn("ring", L.ring_of_mm(F.col("x") - ego_mm[0], F.col("y") - ego_mm[1], s)).filter("ring IS NOT NULL")
    return w.select("i", "j", "ring", L.index(F.col("x"), F.col("ring"), s).alias("ix"), L.index(F.col("y"), F.col("ring"), s).alias("iy")).distinct()


def lattice_bits(known: DataFrame, nx: int, ny: int, cell_m: float = T["plan_cell_m"]) -> DataFrame:
    """All planning cells of a window with their bits, from those known (i, j, n, z_cm, var_cm2, cls, soft) (STN9, QRY7, QRY8).

    Slope and step are differenced on the planning lattice over the baseline; what isn't known on either side is no evidence,
    and the outermost rows have no slope across the edge. Clearance isn't judged, as a reference of ground has no ceiling.
    """
    k = stencil_k(cell_m, T["baseline_m"])
    w = known.sparkSession.range(nx * ny).select((F.col("id") % nx).alias("i"), F.expr(f"id DIV {nx}").alias("j"))
    c = w.join(known, ["i", "j"], "left").select(F.lit(0).alias("tile"), F.col("i").alias("ix"), F.col("j").alias("iy"), F.coalesce("n", F.lit(0)).alias("n"), "z_cm", "var_cm2", "cls", F.coalesce("soft", F.lit(0)).alias("soft"))
    g = gather(c, {"e": (k, 0), "w": (-k, 0), "u": (0, k), "d": (0, -k)}, ["z_cm"])
    z, of = F.col("z_cm"), lambda c: F.col(f"{c}.z_cm")
    dx = F.when(F.col("ix").isin(0, nx - 1), 0.0).otherwise((of("e") - of("w")) / 100 / (2 * k * F.lit(cell_m)))
    dy = F.when(F.col("iy").isin(0, ny - 1), 0.0).otherwise((of("u") - of("d")) / 100 / (2 * k * F.lit(cell_m)))
    slope = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    step = F.coalesce(F.greatest(*(F.abs(of(c) - z) for c in "ewud")), F.lit(0.0))
    flag = lambda cond, bit: F.when(cond, bit).otherwise(0)
    bits = flag(slope > math.tan(math.radians(T["theta_max_deg"])), 2) + flag(step > T["s_max_cm"], 4)
    bits = bits + flag((F.coalesce("var_cm2", F.lit(0.0)) > T["sigma2_max_m2"] * 1e4) | (F.col("soft").bitwiseAND(8) != 0), 8)
    bits = bits + flag(~F.coalesce(F.col("cls").isin(T["drivable"]), F.lit(False)), 16) + flag(F.col("n") < T["n_min"], 32)
    return g.select(F.col("ix").alias("i"), F.col("iy").alias("j"), "n", "z_cm", "var_cm2", "cls", bits.alias("trav"), (F.col("n") == 0).alias("unknown"))


def gridmap(state: DataFrame, sampled: DataFrame) -> DataFrame:
    """What a map tells of planning cells (QRY7): counts summed over the distinct cells sampled, their count-weighted height and
    its spread between them, class of the largest count, roughness of any; ties go to the finest and then first cell."""
    rough = F.when(variance_cm2(F.col("code")) * 1e-4 > T["sigma2_max_m2"], 8).otherwise(0)
    c = sampled.join(state.filter(F.col("n") >= T["unknown_below"]), ["ring", "ix", "iy"]).withColumn("w", F.greatest("n", F.lit(1)).cast("bigint"))
    g = c.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("mu")).alias("s1"), F.sum(F.col("w") * F.col("mu") * F.col("mu")).alias("s2"),
        F.max_by("cand", F.struct("w", -F.col("ring"), -F.col("ix"), -F.col("iy"))).alias("cls"), F.bit_or(rough).alias("soft"),
    )
    z = F.col("s1") / F.col("sw")
    return g.select("i", "j", "n", z.alias("z_cm"), F.greatest(F.lit(0.0), F.col("s2") / F.col("sw") - z * z).alias("var_cm2"), "cls", "soft")


def reference_cells(ref: DataFrame, x0_mm: int, y0_mm: int, nx: int, ny: int, cell_mm: int = round(1000 * T["plan_cell_m"]), fine_mm: int = 50) -> DataFrame:
    """What a reference map (i, j, sz, n, cls in fine cells) tells of the planning cells of a window (QRY8)."""
    inside = lambda c, o, n: (F.col(c) * fine_mm >= o) & (F.col(c) * fine_mm < o + n * cell_mm)
    p = ref.filter(inside("i", x0_mm, nx) & inside("j", y0_mm, ny))
    at = lambda c, o: F.floor((F.col(c) * fine_mm - o) / cell_mm)
    p = p.select(at("i", x0_mm).alias("i"), at("j", y0_mm).alias("j"), (F.col("sz") / F.col("n")).alias("m"), "cls")
    c = p.groupBy("i", "j", "cls").agg(F.count("*").alias("c"), F.sum("m").alias("s1"), F.sum(F.col("m") * F.col("m")).alias("s2"))
    g = c.groupBy("i", "j").agg(F.sum("c").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.max_by("cls", F.struct("c", -F.col("cls"))).alias("cls"))
    z = F.col("s1") / F.col("n")
    return g.select("i", "j", "n", z.alias("z_cm"), F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - z * z).alias("var_cm2"), "cls", F.lit(0).alias("soft"))


def from_cost(costs: DataFrame) -> DataFrame:
    """Rows of each sum of soft weights (roughness, class, doubt), the bits that make it, and those that none explains (AGG25)."""
    sums = [(8 * a + 16 * b + 32 * c, T["w_base"] + a * T["w_roughness"] + b * T["w_class"] + c * T["w_unknown"]) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    dim = costs.sparkSession.createDataFrame(sums, "bits int, cost double")
    return costs.filter("cost IS NOT NULL").join(F.broadcast(dim), "cost", "left").groupBy("cost", "bits").agg(F.count("*").alias("cells"))


def plan_queries(n: int, side: int, seed: int = 0, family: str = "longitudinal", lane: int = 6) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Starts and goals on opposite edges of a window (QRY16), by numpy's seeded generator: along the lane, the first of them
    ``lane`` cells beside the middle, or across it."""
    if family not in ("longitudinal", "lateral"):
        raise ValueError(f"family must be longitudinal or lateral, not {family!r}")
    along, r = family == "longitudinal", np.random.default_rng(seed)
    out = [((1, side // 2 - lane), (side - 2, side // 2 - lane))] if along else []
    while len(out) < n:
        a, b = int(r.integers(1, side - 1)), int(r.integers(1, side - 1))
        out.append(((1, a), (side - 2, b)) if along else ((a, 1), (b, side - 2)))
    return out[:n]


REGRETS = "tile int, query int, found boolean, best double, paid double, regret double"


def regrets(mine: DataFrame, truth: DataFrame, queries: list[tuple[tuple[int, int], tuple[int, int]]], cell_m: float = T["plan_cell_m"]) -> DataFrame:
    """Regret of many queries on each tile (QRY13 over QRY16): planned on one map (tile, ix, iy, cost), paid for on the other.

    A tile is a planning window of fixed size; distances of equal starts are made once.
    """
    both = mine.select("tile", "ix", "iy", F.col("cost").alias("a")).join(truth.select("tile", "ix", "iy", F.col("cost").alias("b")), ["tile", "ix", "iy"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (grid(pdf[["ix", "iy", c]].rename(columns={c: "cost"})) for c in "ab")
        far_a, far_b = ({s: distances(c, s, cell_m) for s, _ in queries} for c in (a, b))
        rows = []
        for k, (s, g) in enumerate(queries):
            best, found = float(far_b[s][g]), bool(np.isfinite(far_a[s][g]))
            path = walk(far_a[s], a, s, g, cell_m) if found else []
            paid = sum(b[q] * math.hypot(q[0] - p[0], q[1] - p[1]) * cell_m for p, q in zip(path, path[1:], strict=False))
            known = found and math.isfinite(best) and math.isfinite(paid) and best > 0
            rows.append((int(pdf["tile"].iloc[0]), k, found, best if math.isfinite(best) else None, float(paid) if known else None, (paid - best) / best if known else None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REGRETS.split(", ")])

    return both.groupBy("tile").applyInPandas(run, REGRETS)


def grid(pdf: pd.DataFrame) -> np.ndarray:
    out = np.full((int(pdf["ix"].max()) + 1, int(pdf["iy"].max()) + 1), np.inf)
    out[pdf["ix"], pdf["iy"]] = pdf["cost"].astype(float).fillna(np.inf)
    return out


def _moved(a: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """a shifted by a step; infinite where nothing comes from inside."""
    out = np.full_like(a, np.inf)
    into, of = (tuple(slice(max(0, s * d), a.shape[k] + min(0, s * d)) for k, d in enumerate((dx, dy))) for s in (1, -1))
    out[into] = a[of]
    return out


def distances(c: np.ndarray, source: tuple[int, int], cell_m: float, into: bool = False) -> np.ndarray:
    """Least cost from a source to all cells (into: from all cells to it); a step costs the weight of the cell it enters.

    All cells are relaxed at once, a step at a time, until nothing changes: one sweep for each step of the longest path.
    """
    dist = np.full(c.shape, np.inf)
    if np.isfinite(c[source]):
        dist[source] = 0.0
    while True:
        old = dist
        for dx, dy, size in STEPS:
            dist = np.minimum(dist, _moved(old + c * size * cell_m, -dx, -dy) if into else _moved(old, dx, dy) + c * size * cell_m)
        if into:
            dist = np.where(np.isfinite(c), dist, np.inf)
        if np.array_equal(dist, old):
            return dist


def walk(dist: np.ndarray, c: np.ndarray, start: tuple[int, int], goal: tuple[int, int], cell_m: float) -> list[tuple[int, int]]:
    """The cells of a cheapest path, from the distances of its start; of equal ways back to the smaller cell."""
    path = [goal]
    while path[-1] != start:
        x, y = path[-1]
        inside = [((x - dx, y - dy), size) for dx, dy, size in STEPS if 0 <= x - dx < c.shape[0] and 0 <= y - dy < c.shape[1]]
        path.append(min(inside, key=lambda q: (dist[q[0]] + c[x, y] * q[1] * cell_m, q[0]))[0])  # noqa: B023
    return path[::-1]


def plan(costs: DataFrame, start: tuple[int, int], goal: tuple[int, int], cell_m: float = T["plan_cell_m"]) -> DataFrame:
    """Cheapest path of each tile's cost map (tile, ix, iy, cost) (QRY10)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = grid(pdf)
        dist = distances(c, start, cell_m)
        path = walk(dist, c, start, goal, cell_m) if np.isfinite(dist[goal]) else []
        row = (int(pdf["tile"].iloc[0]), bool(path), float(dist[goal]) if path else None, max(0, len(path) - 1), [{"ix": a, "iy": b} for a, b in path])
        return pd.DataFrame([row], columns=["tile", "found", "cost", "steps", "path"])

    return costs.select("tile", "ix", "iy", "cost").groupBy("tile").applyInPandas(run, PATHS)


def corridor(costs: DataFrame, start: tuple[int, int], goal: tuple[int, int], tau: float = T["corridor_tau"], cell_m: float = T["plan_cell_m"]) -> DataFrame:
    """Cells on a path that costs less than tau above the best (QRY11, QRY12)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = grid(pdf)
        there, back = distances(c, start, cell_m), distances(c, goal, cell_m, into=True)
        through = there + back
        ix, iy = np.nonzero(through - there[goal] < tau) if np.isfinite(there[goal]) else ([], [])
        return pd.DataFrame({"tile": int(pdf["tile"].iloc[0]), "ix": ix, "iy": iy, "slack": through[ix, iy] - there[goal] if len(ix) else []})

    return costs.select("tile", "ix", "iy", "cost").groupBy("tile").applyInPandas(run, "tile int, ix int, iy int, slack double")


def path_cost(paths: DataFrame, costs: DataFrame, cell_m: float = T["plan_cell_m"]) -> DataFrame:
    """Cost of given paths (tile, path) on a cost map; null if a path enters a blocked cell (WF9, QRY13)."""
    w = Window.partitionBy("tile").orderBy("pos")
    steps = paths.select("tile", F.posexplode("path").alias("pos", "p")).select("tile", "pos", "p.ix", "p.iy", F.lag("p.ix").over(w).alias("px"), F.lag("p.iy").over(w).alias("py"))
    size = F.when((F.col("ix") != F.col("px")) & (F.col("iy") != F.col("py")), DIAGONAL).otherwise(1.0)
    j = steps.filter("pos > 0").join(costs.select("tile", "ix", "iy", "cost"), ["tile", "ix", "iy"], "left")
    return j.groupBy("tile").agg(F.when(F.count_if(F.col("cost").isNull()) == 0, F.sum(F.col("cost") * size * cell_m)).alias("path_cost"))


def regret(mine: DataFrame, truth: DataFrame, start: tuple[int, int], goal: tuple[int, int]) -> DataFrame:
    """What planning on one map costs on another, relative to the best there (QRY13)."""
    a, b = plan(mine, start, goal), plan(truth, start, goal)
    paid = path_cost(a.select("tile", "path"), truth)
    r = a.select("tile", F.col("found").alias("found_mine")).join(b.select("tile", "found", F.col("cost").alias("best")), "tile").join(paid, "tile", "left")
    return r.withColumn("regret", (F.col("path_cost") - F.col("best")) / F.col("best"))


def frechet(a: np.ndarray, b: np.ndarray) -> float:
    """Discrete distance between two paths walked forward together (QRY15)."""
    if not len(a) or not len(b):
        return math.nan
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    reach = np.maximum.accumulate(d[0])
    for i in range(1, len(a)):
        row = np.empty_like(reach)
        row[0] = max(reach[0], d[i, 0])
        for j in range(1, len(b)):
            row[j] = max(d[i, j], min(row[j - 1], reach[j], reach[j - 1]))
        reach = row
    return float(reach[-1])


def frechet_of(paths: DataFrame, other: DataFrame, cell_m: float = T["plan_cell_m"]) -> DataFrame:
    """Distance between the paths of two plans of each tile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        as_xy = lambda p: (np.array([(q["ix"], q["iy"]) for q in p], float).reshape(-1, 2) + 0.5) * cell_m
        return pd.DataFrame([(int(r.tile), frechet(as_xy(r.a), as_xy(r.b))) for r in pdf.itertuples()], columns=["tile", "frechet_m"])

    both = paths.select("tile", F.col("path").alias("a")).join(other.select("tile", F.col("path").alias("b")), "tile")
    return both.groupBy("tile").applyInPandas(run, "tile int, frechet_m double")


def common_support(maps: list[DataFrame]) -> DataFrame:
    """Cells that every map knows, an n-way inner join by set operation (QRY14, JN16)."""
    out = maps[0].filter("NOT unknown").select("tile", "ix", "iy")
    for m in maps[1:]:
        out = out.intersect(m.filter("NOT unknown").select("tile", "ix", "iy"))
    return out


def restrict(costs: DataFrame, support: DataFrame) -> DataFrame:
    """Costs with everything outside the support blocked; bits stay (QRY14)."""
    s = support.withColumn("inside", F.lit(True))
    return costs.join(s, ["tile", "ix", "iy"], "left").withColumn("cost", F.when(F.col("inside"), F.col("cost"))).drop("inside")
