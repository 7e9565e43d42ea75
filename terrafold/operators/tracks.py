"""Sequential state that belongs to a whole sequence: tracks, the refinement pool, moving instances (ST12-15, AGG13, JN19).

Rows of a sequence are sorted by frame in the task that holds it and stream through as Arrow batches. Only the state is held:
256 tracks, 512 blocks, the rows of one frame. Sequences are dealt over the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import THRESHOLDS as T
from terrafold.config import Schedule
from terrafold.functions import lattice as L
from terrafold.functions import sensor

#: Rows of an output batch, about.
TOGETHER = 4096


def in_order(rows: DataFrame, order: list[str], run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``run`` makes of the rows of each sequence, which come as tuples in the given order; the column seq is the first."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for _, own in groupby(each, key=lambda r: r[0]):
            for r in run(own):
                out.append(r)
                if len(out) >= TOGETHER:
                    yield from batch(out)
                    out = []
        yield from batch(out)

    names = [c.split()[0] for c in schema.split(", ")]

    def batch(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if any(v is not None for v in c) else pa.nulls(len(c)) for c in zip(*out, strict=True)], names).cast(types)

    types = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[k]) for n, k in (c.split() for c in schema.split(", "))])
    return rows.repartition(n, "seq").sortWithinPartitions("seq", *order).mapInArrow(task, schema)


TRACKS = "seq int, frame int, track_id int, x_m double, y_m double, vx_ms double, vy_ms double, cls int, age int"


def track(detections: DataFrame) -> DataFrame:
    """Tracks after each frame with a detection: seq, frame, x_m, y_m, cls -> greedy nearest match in the gate (ST12, ST13)."""
    return in_order(detections.select("seq", "frame", "x_m", "y_m", "cls"), ["frame", "x_m", "y_m", "cls"], _track, TRACKS)


def _track(rows: Iterator[tuple]) -> Iterator[tuple]:
    dt, cap = T["frame_dt_s"], T["track_capacity"]
    # id, class, age; x, y; vx, vy of the live ones, in the order in which they began
    live, at, move = np.zeros((0, 3), np.int64), np.zeros((0, 2)), np.zeros((0, 2))
    last, next_id = None, 1
    for (seq, frame), found in groupby(rows, key=lambda r: r[:2]):
        for _ in range(0 if last is None else min(frame - last, T["track_ttl"] + 1)):
            stay = live[:, 2] < T["track_ttl"]
            live, at, move = live[stay] + [0, 0, 1], at[stay] + move[stay] * dt, move[stay]
        last = frame
        for _, _, x, y, cls in found:
            p = np.array([x, y])
            away = np.hypot(*(at - p).T)
            if len(away) and away[k := int(away.argmin())] <= T["track_gate_m"]:
                move[k], at[k], live[k, 2] = (p - at[k]) / dt, p, 0
                continue
            if len(live) == cap:
                old = int(live[:, 2].argmax())
                live, at, move = (np.delete(v, old, 0) for v in (live, at, move))
            live, at, move = np.vstack([live, [next_id % 65536, cls, 0]]), np.vstack([at, p]), np.vstack([move, [0.0, 0.0]])
            next_id += 1
        for (i, c, age), (x, y), (vx, vy) in zip(live.tolist(), at.tolist(), move.tolist(), strict=True):
            yield seq, frame, i, x, y, vx, vy, c, age


class Pool:
    """A fixed number of blocks, each with the children of one cell (ST14)."""

    def __init__(self, blocks: int):
        self.held: dict[tuple[int, int, int], int] = {}
        self.owner: list[tuple[int, int, int] | None] = [None] * blocks
        self.levels, self.score = [0] * blocks, np.zeros(blocks)
        self.free = list(range(blocks - 1, -1, -1))  # the lowest is taken first; given back ones as they come

    def acquire(self, cell: tuple[int, int, int], levels: int, score: float) -> int | None:
        """The cell's block, with a new score; a free one; else that of the lowest score, if it is lower; else none."""
        b = self.held.get(cell)
        if b is None:
            if not self.free:
                worst = int(self.score.argmin())
                if self.score[worst] >= score:
                    return None
                self.release(worst)
            b = min(self.free)
            self.free.remove(b)
            self.held[cell], self.owner[b], self.levels[b] = b, cell, levels
        self.score[b] = score
        return b

    def release(self, b: int) -> None:
        del self.held[self.owner[b]]
        self.owner[b], self.levels[b], self.score[b] = None, 0, 0.0
        self.free.append(b)

    def release_overtaken(self, ring_now: Callable[[int, int, int], int | None]) -> int:
        """Gives back the blocks of cells that now lie in a ring as fine as the block made them; how many."""
        gone = [b for cell, b in self.held.items() if (now := ring_now(*cell)) is not None and now <= cell[0] - self.levels[b]]
        for b in gone:
            self.release(b)
        return len(gone)


def levels_available(s: Schedule, ring: int, cells: int = T["block_cells"]) -> int:
    """Levels of refinement of a ring's cell that a block holds; 0 where not even one fits."""
    n, levels = 1, 0
    while ring >= 1:
        n *= (s.k(ring) // s.k(ring - 1)) ** 2
        if n > cells:
            break
        levels, ring = levels + 1, ring - 1
    return levels


REFINED = "seq int, frame int, released int, fired int, acquired int, refused int, unfit int, block int, ring int, ix bigint, iy bigint, levels int, score double"


def refine(fired: DataFrame, frames: DataFrame, s: Schedule, blocks: int = T["pool_blocks"]) -> DataFrame:
    """The life of the pool (ST14, ST15, JN19): rows of two kinds, counts of a frame and blocks held after the last frame.

    fired: cells that the gate found (seq, frame, ring, ix, iy, dynamic); frames: seq, frame, ego_x_mm, ego_y_mm, speed_ms of
    every frame. In each frame the blocks of cells that the schedule has overtaken go first; then the cells ask in the order
    ring, iy, ix. Rows of a frame have a null block, rows of a block null counts.
    """
    size = L.cell_mm(F.col("ring"), s)
    ego = F.broadcast(frames.select("seq", "frame", "ego_x_mm", "ego_y_mm", "speed_ms"))
    c = fired.select("seq", "frame", "ring", "ix", "iy", "dynamic").join(ego, ["seq", "frame"])
    x, y = (((F.col(i) + 0.5) * size - F.col(e)) / 1000.0 for i, e in (("ix", "ego_x_mm"), ("iy", "ego_y_mm")))
    score = sensor.priority(F.sqrt(x * x + y * y), F.col("dynamic"), sensor.time_to_collision(x, F.col("speed_ms")))
    first = frames.select("seq", "frame", F.lit(-1).alias("ring"), F.lit(0).cast("bigint").alias("ix"), F.lit(0).cast("bigint").alias("iy"), F.lit(0.0).alias("score"), F.col("ego_x_mm").cast("double").alias("ex"), F.col("ego_y_mm").cast("double").alias("ey"), F.col("speed_ms").cast("double").alias("v"))
    asks = c.select("seq", "frame", "ring", "ix", "iy", score.alias("score"), F.lit(0.0).alias("ex"), F.lit(0.0).alias("ey"), F.lit(0.0).alias("v"))
    cell_mm, fit = [L.mm(r.cell_m) for r in s.rings], [levels_available(s, r.ring) for r in s.rings]

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        pool, seq, frame = Pool(blocks), 0, 0
        for (seq, frame), own in groupby(rows, key=lambda r: r[:2]):  # noqa: B007
            _, _, _, _, _, _, ex, ey, v = next(own)
            centre = lambda ring, ix, iy: (((ix + 0.5) * cell_mm[ring] - ex) / 1000, ((iy + 0.5) * cell_mm[ring] - ey) / 1000)  # noqa: B023, E731
            released = pool.release_overtaken(lambda ring, ix, iy: L.migrated(*centre(ring, ix, iy), ring, s, v))  # noqa: B023
            n = {"fired": 0, "acquired": 0, "refused": 0, "unfit": 0}
            for _, _, ring, ix, iy, score, *_ in own:
                n["fired"] += 1
                if ring < 1:
                    continue
                n["unfit" if fit[ring] < 1 else "refused" if pool.acquire((ring, ix, iy), 1, score) is None else "acquired"] += 1
            yield seq, frame, released, *n.values(), None, None, None, None, None, None
        for cell, b in sorted(pool.held.items(), key=lambda x: x[1]):
            yield seq, frame, None, None, None, None, None, b, *cell, pool.levels[b], float(pool.score[b])

    return in_order(first.union(asks), ["frame", "ring", "iy", "ix"], run, REFINED)


def filled(blocks: DataFrame, state: DataFrame, s: Schedule, grad: Column | float = 0.0) -> DataFrame:
    """Children of the cells that hold a block, split from the map's state (ST15): seq, block, ring, ix, iy, child, values.

    blocks: at most a pool of each sequence, so they are joined by broadcast.
    """
    from terrafold.operators.pyramid import variance_cm2

    b = blocks.filter("block IS NOT NULL").select("seq", "block", "ring", "ix", "iy")
    c = state.join(F.broadcast(b), ["ring", "ix", "iy"])
    m = lambda r: F.get(F.array(F.lit(1), *(F.lit(s.k(x.ring) // s.k(x.ring - 1)) for x in s.rings[1:])), r)
    size = L.cell_mm(F.col("ring"), s) / 1000.0
    fine = size / m(F.col("ring"))
    grad = grad if isinstance(grad, Column) else F.lit(float(grad))
    var = variance_cm2(F.col("code").cast("int")) * 1e-4 + T["kappa"] * grad * grad * (size * size - fine * fine) + T["alpha_m2"]
    c = c.withColumn("child", F.explode(F.sequence(F.lit(0), m(F.col("ring")) * m(F.col("ring")) - 1)))
    return c.select("seq", "block", "ring", "ix", "iy", "child", (F.col("mu") / 100.0).alias("mu_m"), var.alias("sigma2_m2"), "n")


INSTANCES = "frame int, label int, n int, cx double, cy double, cz double, range_m double, x_min double, y_min double, z_min double, x_max double, y_max double, z_max double"


def instances(pixels: DataFrame, tolerance_m: float = 0.75, least: int = 4) -> DataFrame:
    """Connected moving pixels of each frame, largest first (AGG13): frame, v, u, r, x, y, z of moving pixels.

    One image is one group; it holds rows x columns pixels at most. Neighbours share a side, azimuth wraps, and ranges
    differ by the tolerance at most. Groups of equal size go by their first pixel. Each has its centre, mean range and box.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {(int(v), int(u)): i for i, (v, u) in enumerate(zip(pdf["v"], pdf["u"], strict=True))}
        r, seen, groups, pixel = pdf["r"].to_numpy(), set(), [], list(at)
        for p in at:
            if p in seen:
                continue
            seen.add(p)
            todo, got = [p], []
            while todo:
                v, u = q = todo.pop()
                got.append(at[q])
                for n in ((v + 1, u), (v - 1, u), (v, (u + 1) % T["columns"]), (v, (u - 1) % T["columns"])):
                    if n in at and n not in seen and abs(r[at[n]] - r[at[q]]) <= tolerance_m:
                        seen.add(n)
                        todo.append(n)
            if len(got) >= least:
                groups.append(got)
        groups.sort(key=lambda g: (-len(g), min(pixel[i] for i in g)))
        rows = []
        for k, g in enumerate(groups, 1):
            own = pdf.iloc[g][["x", "y", "z"]].to_numpy(float)
            rows.append((int(pdf["frame"].iloc[0]), k, len(g), *own.mean(0).tolist(), float(r[g].mean()), *own.min(0).tolist(), *own.max(0).tolist()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in INSTANCES.split(", ")])

    return pixels.groupBy("frame").applyInPandas(run, INSTANCES)
