"""Neighbour operators on cells: traversability bits, kerbs, potholes, confidence (STN1-5, STN8, FLT7, AGG14, JN9).

Cells are keyed (tile, ix, iy); each is sent to the neighbours that need it and gathered there, one shuffle for all. World adjacency and the true window edge are used, not the memory order of a ring buffer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import THRESHOLDS as T
from terrafold.config import rim_r, stencil_k
from terrafold.functions.sensor import variance_cm2

TAN = math.tan(math.radians(T["theta_max_deg"]))
AXES = {"east": (1, 0), "west": (-1, 0), "north": (0, 1), "south": (0, -1)}
#: Directions by octant, anticlockwise from +x: (dx, dy).
OCTANTS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
KEY = ["tile", "ix", "iy"]


def gather(cells: DataFrame, offsets: dict[str, tuple[int, int]], cols: list[str]) -> DataFrame:
    """cells with a struct column for each neighbour, null where there is none: one shuffle for all offsets.

    Every cell is sent to the neighbours it has (itself included) and gathered there, so the table isn't joined with itself
    for each offset; a key gets len(offsets) + 1 rows at most.
    """
    places = [F.struct(F.lit(n).alias("p"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, (dx, dy) in {"own": (0, 0), **offsets}.items()]
    rest = [c for c in cells.columns if c not in KEY]
    sent = cells.select("*", F.explode(F.array(*places)).alias("to")).select(
        "tile", (F.col("ix") - F.col("to.dx")).alias("ix"), (F.col("iy") - F.col("to.dy")).alias("iy"), F.col("to.p").alias("p"), F.struct(*rest).alias("c"))
    own = F.max(F.when(F.col("p") == "own", F.col("c"))).alias("own")
    got = sent.groupBy(*KEY).agg(own, *(F.max(F.when(F.col("p") == n, F.struct(*(F.col(f"c.{x}").alias(x) for x in cols)))).alias(n) for n in offsets))
    return got.filter("own IS NOT NULL").select(*KEY, "own.*", *offsets)


def axes(cells: DataFrame, k: int, cols: list[str]) -> DataFrame:
    return gather(cells, {n: (dx * k, dy * k) for n, (dx, dy) in AXES.items()}, cols)


def differences(cell_m: float, k: int) -> tuple[Column, Column, Column, Column]:
    """(dz/dx, dz/dy, largest step in cm, all seen); at the edge the stencil is clipped to the cell itself and its true span used (STN2)."""
    z = lambda c: F.coalesce(F.col(f"{c}.ground_cm"), F.col("ground_cm"))
    span_x = F.when(F.col("east").isNotNull(), k).otherwise(0) + F.when(F.col("west").isNotNull(), k).otherwise(0)
    span_y = F.when(F.col("north").isNotNull(), k).otherwise(0) + F.when(F.col("south").isNotNull(), k).otherwise(0)
    dx = F.when(span_x > 0, (z("east") - z("west")) / 100.0 / (span_x * F.lit(cell_m))).otherwise(0.0)
    dy = F.when(span_y > 0, (z("north") - z("south")) / 100.0 / (span_y * F.lit(cell_m))).otherwise(0.0)
    step = F.greatest(*(F.abs(z(c) - F.col("ground_cm")) for c in AXES))
    seen = F.least("obs", *(F.coalesce(F.col(f"{c}.obs"), F.col("obs")) for c in AXES)) >= 1
    return dx, dy, step, seen


def bits(cells: DataFrame, side: int, cell_m: float) -> DataFrame:
    """cells (ground_cm, ceiling_cm, code, n, cand) with the six traversability bits, 0 = traversable (STN1)."""
    k = stencil_k(cell_m, T["baseline_m"])
    g = axes(cells.withColumn("obs", F.col("n")).withColumnRenamed("n", "count"), k, ["ground_cm", "obs"])
    dx, dy, step, seen = differences(cell_m, k)
    edge = (F.col("ix") == 0) | (F.col("iy") == 0) | (F.col("ix") == side - 1) | (F.col("iy") == side - 1)
    flag = lambda cond, bit: F.when(cond, bit).otherwise(0)
    out = flag(F.col("ceiling_cm") - F.col("ground_cm") < T["h_vehicle_cm"], 1)
    out = out + flag(seen & (F.sqrt(dx * dx + dy * dy) > TAN), 2) + flag(seen & (step > T["s_max_cm"]), 4)
    out = out + flag(variance_cm2(F.col("code").cast("int")) * 1e-4 > T["sigma2_max_m2"], 8) + flag(~F.col("cand").isin(T["drivable"]), 16)
    out = out + flag((F.col("obs") < T["n_min"]) | edge, 32)
    return g.withColumn("trav", out.cast("int")).withColumnRenamed("count", "n").drop(*AXES, "obs")


def margins(cells: DataFrame, cell_m: float) -> DataFrame:
    """Four margins from 0 to 1 and their least, 0 where the class isn't drivable (STN8)."""
    k = stencil_k(cell_m, T["baseline_m"])
    g = axes(cells.withColumn("obs", F.col("n")).withColumnRenamed("n", "count"), k, ["ground_cm", "obs"])
    dx, dy, step, _ = differences(cell_m, k)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    n = F.col("obs").cast("double")
    g = g.withColumns({
        "class_share": F.when(n >= 1, unit((n + F.col("cnt")) / (2.0 * n))).otherwise(0.0),
        "evidence": F.when(F.col("flags").bitwiseAND(4) != 0, 0.0).otherwise(unit(n / float(T["n_min"]))),
        "geometry": unit(F.least(1.0 - F.sqrt(dx * dx + dy * dy) / TAN, 1.0 - step / 100.0 / (T["s_max_cm"] / 100))),
        "surface": unit(1.0 - variance_cm2(F.col("code").cast("int")) * 1e-4 / T["sigma2_max_m2"]),
    })
    least = F.least("class_share", "evidence", "geometry", "surface")
    return g.withColumn("confidence", F.when(F.col("cand").isin(T["drivable"]), least).otherwise(0.0)).withColumnRenamed("count", "n").drop(*AXES, "obs")


def summarise(margined: DataFrame, group: str = "tile") -> DataFrame:
    """Per group: seen cells, mean confidence, shares of high and low, and the channel that binds most often (AGG14)."""
    channels = ["class", "class_share", "evidence", "geometry", "surface"]
    drivable = F.when(F.col("cand").isin(T["drivable"]), 9.0).otherwise(-1.0)
    vals = [drivable, *(F.col(c) for c in channels[1:])]
    low = F.least(*vals)
    binding = F.lit(None).cast("int")
    for i in reversed(range(5)):
        binding = F.when(vals[i] == low, i).otherwise(binding)
    m = margined.filter("n >= 1").withColumn("binding", binding)
    counts = [F.count_if(F.col("binding") == i) for i in range(5)]
    return m.groupBy(group).agg(
        F.count("*").alias("cells"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.avg((F.col("confidence") >= 0.8).cast("int")), 6).alias("high"),
        F.round(F.avg((F.col("confidence") < 0.2).cast("int")), 6).alias("low"), *(c.alias(f"b{i}") for i, c in enumerate(counts)),
    ).withColumn("binding", F.array_position(F.array(*(f"b{i}" for i in range(5))), F.greatest(*(f"b{i}" for i in range(5)))).cast("int") - 1).drop(*(f"b{i}" for i in range(5)))


def kerbs(cells: DataFrame, side: int, cell_m: float) -> DataFrame:
    """Cells with a rise in the kerb band that goes on to both sides along the kerb (STN3)."""
    k = stencil_k(cell_m, T["curb_baseline_m"])
    ok = (F.col("n") >= 1) & (F.col("flags").bitwiseAND(4) == 0)
    g = axes(cells.select(*KEY, "ground_cm", ok.alias("ok")), k, ["ground_cm", "ok"])
    inner = F.col("ix").between(k, side - 1 - k) & F.col("iy").between(k, side - 1 - k)
    g = g.filter(F.col("ok") & F.col("east.ok") & F.col("west.ok") & F.col("north.ok") & F.col("south.ok") & inner)
    g = g.select(*KEY, (F.col("east.ground_cm") - F.col("west.ground_cm")).alias("dx"), (F.col("north.ground_cm") - F.col("south.ground_cm")).alias("dy"))
    g = g.withColumn("rise2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).filter(F.col("rise2").between(T["curb_min_cm"] ** 2, T["curb_max_cm"] ** 2))
    g = g.withColumn("octant", F.pmod(F.rint(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double")) / (math.pi / 4)).cast("int"), F.lit(8)))
    turn = F.get(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in OCTANTS)), F.pmod(F.col("octant") + 2, F.lit(8)))
    sides = g.withColumn("t", turn).select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("d"))
    other = g.select("tile", F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.col("octant").alias("o2"))
    sides = sides.withColumns({"jx": F.col("ix") + F.col("d") * F.col("t.a"), "jy": F.col("iy") + F.col("d") * F.col("t.b")}).join(other, ["tile", "jx", "jy"])
    both = sides.filter(F.abs(F.pmod(F.col("o2") - F.col("octant") + 4, F.lit(8)) - 4) <= 1).groupBy(*KEY, "rise2", "dx", "dy", "octant").agg(F.count("*").alias("c"))
    return both.filter("c = 2").select(*KEY, F.sqrt("rise2").alias("height_cm"), "octant")


def potholes(cells: DataFrame, side: int, cell_m: float) -> DataFrame:
    """Cells below an even rim seen on opposed sides (STN4): the rim's median is the surface, depth lies in the band."""
    r = rim_r(cell_m)
    c = cells.select(*KEY, "ground_cm", ((F.col("n") >= 1) & (F.col("flags").bitwiseAND(4) == 0)).alias("ok"))
    g = gather(c, {f"o{i}": (dx * r, dy * r) for i, (dx, dy) in enumerate(OCTANTS)}, ["ground_cm", "ok"])
    inner = F.col("ix").between(r, side - 1 - r) & F.col("iy").between(r, side - 1 - r)
    g = g.filter(F.col("ok") & inner)
    pair = [F.coalesce(F.col(f"o{i}.ok") & F.col(f"o{i + 4}.ok"), F.lit(False)) for i in range(4)]
    rim = F.array_compact(F.array(*(F.when(pair[i % 4], F.col(f"o{i}.ground_cm")) for i in range(8))))
    g = g.withColumn("rim", F.sort_array(rim)).withColumn("pairs", (F.size("rim") / 2).cast("int")).filter(F.col("pairs") >= T["rim_pairs"])
    g = g.withColumn("median", (F.get("rim", F.col("pairs") - 1) + F.get("rim", F.col("pairs"))) / 2.0).withColumn("depth_cm", F.col("median") - F.col("ground_cm"))
    down = F.size(F.filter("rim", lambda x: F.col("median") - x > 0.5 * T["hole_min_cm"]))
    keep = F.col("depth_cm").between(T["hole_min_cm"], T["hole_max_cm"]) & (F.array_max("rim") - F.array_min("rim") <= T["rim_spread_cm"]) & (down <= T["rim_depressed"] * F.col("pairs"))
    return g.filter(keep).select(*KEY, "depth_cm", F.col("pairs").alias("rim_pairs"))
