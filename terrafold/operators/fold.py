"""Per-cell state as an ordered fold over frames (ST1-6, ST10, FLT4).

A cell's state isn't associative over frames (clamps, a saturating vote, variance re-quantised each frame), so its frames
are folded in order. Within a frame everything was summed by scatter, so a cell has one row per frame it was seen in and
the list that is folded grows with frames only, never with points. Long sequences run through streaming.replay, whose
state is one row per cell.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import BLIND, FREE, OCCUPIED, THRESHOLDS as T
from terrafold.config import UNKNOWN, VARIANCE, Schedule
from terrafold.functions import lattice as L
from terrafold.functions.sensor import let, quantise_variance, variance_cm2
from terrafold.operators.scatter import mean_height_cm

STATE = "struct<mu:int,code:int,ceil:int,odds:int,cand:int,cnt:int,refl:int,n:int>"
EMPTY = f"CAST(named_struct('mu', 0, 'code', 0, 'ceil', {T['no_ceiling']}, 'odds', 0, 'cand', 0, 'cnt', 0, 'refl', 0, 'n', 0) AS {STATE})"
FIELDS = ["mu", "code", "ceil", "odds", "cand", "cnt", "refl", "n"]


def observation() -> Column:
    """What a scatter row tells the fold."""
    return F.struct(
        "frame", mean_height_cm(F.col("wz_sum"), F.col("w_sum")).alias("z"), "w_sum", F.col("n").alias("count"), "refl_sum", "ceiling_cm", "cls",
    )


def vote(cand: Column, cnt: Column, cls: Column) -> tuple[Column, Column]:
    """One majority vote: an empty counter adopts, a match adds up to 7, anything else takes one away (ST4)."""
    return F.when(cnt == 0, cls).otherwise(cand), F.when(cnt == 0, 1).when(cand == cls, F.least(cnt + 1, F.lit(7))).otherwise(cnt - 1)


def step(s: Column, x: Column) -> Column:
    """State after one frame's observation."""
    prior_var = variance_cm2(s["code"]) + T["process_noise_m2_per_s"] * 1e4 * T["frame_dt_s"]
    meas = F.lit(float(T["weight_scale"])) / F.greatest(x["w_sum"], F.lit(1)).cast("double")
    first, ground = s["n"] == 0, x["w_sum"] > 0

    def filtered(q: Column) -> Column:
        mu = F.when(~ground, s["mu"].cast("double")).when(first, x["z"].cast("double")).otherwise(s["mu"] + q["gain"] * (x["z"] - s["mu"]))
        var = F.when(~ground, q["prior"]).when(first, q["meas"]).otherwise((1.0 - q["gain"]) * q["prior"])
        return F.struct(F.rint(mu).alias("mu"), quantise_variance(var).alias("code"))

    height = let(F.struct(prior_var.alias("prior"), meas.alias("meas")), lambda q: let(F.struct(q["prior"].alias("prior"), q["meas"].alias("meas"), (q["prior"] / (q["prior"] + q["meas"])).alias("gain")), filtered))
    cand, cnt = vote(s["cand"], s["cnt"], x["cls"])
    refl = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x["refl_sum"] / x["count"])))
    rest = [F.least(s["ceil"], x["ceiling_cm"]), F.least(s["odds"] + T["hit"], F.lit(T["odds_max"])), cand, cnt, refl, F.least(s["n"] + x["count"], F.lit(255))]
    return let(height, lambda h: F.struct(*(v.cast("int").alias(f) for v, f in zip([h["mu"], h["code"], *rest], FIELDS, strict=True))))


def code_of(variance: float) -> int:
    """quantise_variance for one number: the largest code whose variance is at least that."""
    return max(0, bisect.bisect_right(_FALLING, -max(variance, 1e-12)) - 1)


def stepped(s: tuple, z: int, w_sum: int, count: int, refl_sum: int, ceiling_cm: int, cls: int) -> tuple:
    """step for one cell in plain numbers, for state that is kept outside of Spark's expressions; s: FIELDS in order."""
    mu, code, ceil, odds, cand, cnt, _, n = s
    if w_sum > 0:
        prior, meas = VARIANCE[code] + T["process_noise_m2_per_s"] * 1e4 * T["frame_dt_s"], T["weight_scale"] / w_sum
        gain = prior / (prior + meas)
        mu, var = (float(z), meas) if n == 0 else (mu + gain * (z - mu), (1.0 - gain) * prior)
        code = code_of(var)
    else:  # no ground was seen; uncertainty grows
        code = code_of(VARIANCE[code] + T["process_noise_m2_per_s"] * 1e4 * T["frame_dt_s"])
    cand, cnt = (cls, 1) if cnt == 0 else (cand, min(cnt + 1, 7)) if cand == cls else (cand, cnt - 1)
    return round(mu), code, min(ceil, ceiling_cm), min(odds + T["hit"], T["odds_max"]), cand, cnt, max(0, min(255, refl_sum // count)), min(n + count, 255)


_FALLING = [-v for v in VARIANCE]
EMPTY_STATE = (0, 0, T["no_ceiling"], 0, 0, 0, 0, 0)


def mark_blind(state: DataFrame, s: Schedule, ego_mm: tuple[int, int]) -> DataFrame:
    """state with the flag of cells whose centre lies in the cone below the sensor (ST10); the others have none."""
    size = L.cell_mm(F.col("ring"), s)
    x, y = ((F.col(i) + 0.5) * size - e for i, e in zip(("ix", "iy"), ego_mm, strict=True))
    return state.withColumn("flags", F.when(F.sqrt(x * x + y * y) < T["blind_m"] * 1000, BLIND).otherwise(0))


def fold(cells: DataFrame, key: list[str] | None = None) -> DataFrame:
    """State of each cell (ring, ix, iy) after all frames of a scatter result.

    The state leaves the fold through a generator: no filter on a field of it goes below, where it would fold once more. The
    fold is heavy for its few bytes, so its shuffle has as many parts as the session says and isn't coalesced by size.
    """
    key = key or ["ring", "ix", "iy"]
    n = max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    seen = cells.repartition(n, *key).groupBy(*key).agg(F.array_sort(F.collect_list(observation())).alias("obs"), F.max("frame").alias("last_frame"))
    return seen.select(*key, "last_frame", F.inline(F.array(F.aggregate("obs", F.expr(EMPTY), step))))


def occupancy(n: Column, odds: Column, flags: Column | int = 0) -> Column:
    """Unknown where blind or unseen, else occupied above the threshold, else free (FLT4)."""
    f = flags if isinstance(flags, Column) else F.lit(flags)
    return F.when((f.bitwiseAND(4) != 0) | (n < T["unknown_below"]), UNKNOWN).when(odds > T["occupied_above"], OCCUPIED).otherwise(FREE)


def miss(odds: Column) -> Column:
    """Log-odds after a cell was seen through (ST7)."""
    return F.greatest(odds + T["miss"], F.lit(T["odds_min"]))


def rebase(height: Column, delta_cm: Column, none: int | None = None) -> Column:
    """Heights after the datum moved by delta: clipped to the band; beyond its span all go to its end (LAT19)."""
    lo, hi = T["z_min_cm"], T["z_max_cm"]
    moved = F.greatest(F.lit(lo), F.least(F.lit(hi), height - delta_cm))
    out = F.when(F.abs(delta_cm) >= hi - lo, F.when(delta_cm > 0, lo).otherwise(hi)).otherwise(moved)
    return out if none is None else F.when(height == none, height).otherwise(out)
