"""Ring schedules, thresholds and label classes, with their checks (SRC8-10, LAT12, LAT20)."""

from __future__ import annotations

import hashlib
import json
import math
import warnings
from dataclasses import dataclass, field


class ScheduleError(ValueError):
    pass


@dataclass(frozen=True)
class Ring:
    ring: int
    half_width_m: float
    cell_m: float
    s_az_cm: float | None = None


@dataclass(frozen=True)
class Schedule:
    name: str
    rings: tuple[Ring, ...]
    base_cell_m: float = 0.05
    hysteresis: float = 0.1
    kappa_forward: float = 1.0
    kappa_side: float = 0.5
    v_ref_ms: float = 15.0
    rear_stretch: float = 1.0
    rear_floor_cell_m: float = 0.20

    def k(self, ring: int) -> int:
        return round(self.rings[ring].cell_m / self.base_cell_m)

    def side(self, ring: int) -> int:
        return round(2 * self.rings[ring].half_width_m / self.rings[ring].cell_m)

    def hole(self, ring: int) -> int:
        return round(2 * self.rings[ring - 1].half_width_m / self.rings[ring].cell_m) if ring else 0

    def cells(self, ring: int) -> int:
        return self.side(ring) ** 2 - self.hole(ring) ** 2

    @property
    def total_cells(self) -> int:
        return sum(self.cells(r.ring) for r in self.rings)

    @property
    def slots(self) -> int:
        return sum(self.side(r.ring) ** 2 for r in self.rings)

    def validate(self) -> Schedule:
        """Integer ratios and growing half-widths are required; a cell far from the azimuth spacing only warns."""
        for a, b in zip((None, *self.rings), self.rings, strict=False):
            ratio = b.cell_m / self.base_cell_m
            if abs(ratio - round(ratio)) > 1e-9:
                raise ScheduleError(f"{self.name}: cell {b.cell_m} is no multiple of {self.base_cell_m}")
            if a:
                step = b.cell_m / a.cell_m
                if abs(step - round(step)) > 1e-9:
                    raise ScheduleError(f"{self.name}: cells {a.cell_m} and {b.cell_m} have no integer ratio")
                if b.half_width_m <= a.half_width_m:
                    raise ScheduleError(f"{self.name}: half-widths don't grow")
            if b.s_az_cm and not 0.5 <= 100 * b.cell_m / b.s_az_cm <= 2:
                warnings.warn(f"{self.name}: ring {b.ring} has cells far from the azimuth spacing", stacklevel=2)
        return self


# The two schedules, the thresholds, the label classes.
SCHEDULES = {
    "5_10_20_40": Schedule("5_10_20_40", (Ring(0, 10, 0.05, 3.5), Ring(1, 25, 0.10, 8.7), Ring(2, 50, 0.20, 17.5), Ring(3, 100, 0.40, 34.9))),
    "5_10_50": Schedule("5_10_50", (Ring(0, 10, 0.05, 3.5), Ring(1, 25, 0.10, 8.7), Ring(2, 100, 0.50, 34.9)), rear_floor_cell_m=0.50),
}
THRESHOLDS = {
    "h_vehicle_cm": 180, "theta_max_deg": 20.0, "s_max_cm": 15, "baseline_m": 0.50, "sigma2_max_m2": 0.0025, "n_min": 3,
    "drivable": [8, 9, 10, 11, 16], "refine": [1, 2, 5, 6, 7, 17, 18],
    "curb_min_cm": 5, "curb_max_cm": 25, "curb_baseline_m": 0.20,
    "hole_min_cm": 8, "hole_max_cm": 50, "rim_m": 0.75, "rim_pairs": 2, "rim_depressed": 0.5, "rim_spread_cm": 8,
    "hit": 4, "miss": -2, "odds_min": -64, "odds_max": 63, "occupied_above": 0, "unknown_below": 1,
    "process_noise_m2_per_s": 1e-4, "frame_dt_s": 0.1, "kappa": 0.0625, "alpha_m2": 0.0,
    "sensor_height_m": 1.73, "phi_min_deg": -24.8, "phi_max_deg": 2.0, "rows": 64, "columns": 512,
    "blind_m": 3.74, "sigma_r_m": 0.02, "sigma_phi_deg": 0.1, "weight_scale": 1024, "weight_max": 1 << 20,
    "z_min_cm": -200, "z_max_cm": 600, "no_ceiling": 32767, "unlabelled": 31,
    "plan_cell_m": 0.25, "w_base": 1.0, "w_roughness": 2.0, "w_class": 3.0, "w_unknown": 4.0, "corridor_tau": 5.0,
    "clear_floor_m": 0.30, "pool_blocks": 512, "block_cells": 16, "track_ttl": 10, "track_gate_m": 2.5, "track_capacity": 256,
}
CLASS_NAMES = [
    "car", "bicycle", "motorcycle", "truck", "other-vehicle", "person", "bicyclist", "motorcyclist", "road", "parking",
    "sidewalk", "other-ground", "building", "fence", "vegetation", "trunk", "terrain", "pole", "traffic-sign", "unlabeled",
]
CLASS_OF = {
    0: -1, 1: -1, 10: 0, 11: 1, 13: 4, 15: 2, 16: 4, 18: 3, 20: 4, 30: 5, 31: 6, 32: 7, 40: 8, 44: 9, 48: 10, 49: 11, 50: 12,
    51: 13, 52: -1, 60: 8, 70: 14, 71: 15, 72: 16, 80: 17, 81: 18, 99: -1, 252: 0, 253: 6, 254: 5, 255: 7, 256: 4, 257: 4,
    258: 3, 259: 4,
}
MOVING = (250, 259)
CLEARANCE, SLOPE, STEP, ROUGHNESS, CLASS, CONFIDENCE = 1, 2, 4, 8, 16, 32
DERIVED, REFINED, BLIND, DYNAMIC = 1, 2, 4, 8
UNKNOWN, FREE, OCCUPIED = 0, 1, 2
VAR_MIN_CM2, VAR_MAX_CM2, MAX_CODE = 1.0 / 12.0, 640000.0, 255

#: Variance of each code of the logarithmic codec.
VARIANCE = [VAR_MAX_CM2 * math.exp(-math.log(VAR_MAX_CM2 / VAR_MIN_CM2) * c / MAX_CODE) for c in range(MAX_CODE + 1)]
LOG_RANGE = math.log(VAR_MAX_CM2 / VAR_MIN_CM2)


def load(name: str) -> Schedule:
    """A schedule by name; slashes count as underscores."""
    return SCHEDULES[name.replace("/", "_")].validate()


def uniform(cell_m: float, half_width_m: float = 100.0) -> Schedule:
    """One ring of equal cells, the baseline of the ablation (LAT20)."""
    return Schedule(f"uniform_{round(100 * cell_m)}cm", (Ring(0, half_width_m, cell_m),), base_cell_m=cell_m, rear_floor_cell_m=cell_m)


def class_ids(names: list[str]) -> list[int]:
    """Ids of class names; an unknown name is an error (FLT9, JN17)."""
    return [CLASS_NAMES.index(n) for n in names]


def unstorable(names: list[str], most: int = 31) -> list[str]:
    """Those of the class names whose id doesn't fit the map's packed class (FLT9, EXT19)."""
    return [n for n, i in zip(names, class_ids(names), strict=True) if not 0 <= i <= most]


def class_weights(named: list[str], weight: float) -> list[float]:
    """A weight for each class (EXT11): that given for the named ones, one for others, none for unlabelled returns."""
    heavy = set(class_ids(named))
    return [0.0 if n == "unlabeled" else weight if i in heavy else 1.0 for i, n in enumerate(CLASS_NAMES)]


def available() -> list[str]:
    """Names of the schedules (EXT6)."""
    return sorted(SCHEDULES)


def legend(s: Schedule) -> str:
    """A schedule's rings as a Markdown table (EXT6)."""
    rows = [f"| {r.ring} | {r.half_width_m:g} | {100 * r.cell_m:g} | {s.cells(r.ring)} |" for r in s.rings]
    return "\n".join(["| ring | half width m | cell cm | cells |", "|---|---|---|---|", *rows])


def digest(thresholds: dict | None = None) -> str:
    """SHA-256 of the thresholds, to refuse results made under others (EXT14)."""
    return hashlib.sha256(json.dumps(thresholds or THRESHOLDS, sort_keys=True).encode()).hexdigest()


def stencil_k(cell_m: float, baseline_m: float) -> int:
    """Cells to either side over which heights are differenced; halves round to even (STN2)."""
    return max(1, round(baseline_m / (2 * cell_m)))


def rim_r(cell_m: float) -> int:
    return max(1, round(THRESHOLDS["rim_m"] / cell_m))
