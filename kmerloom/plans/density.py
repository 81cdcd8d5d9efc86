"""What is decided before a comparison runs: densities, cutoffs and costs, from sizes and the occurrence spectrum (1,024 rows at most)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from kmerloom.model import ANCHOR_BUDGET, DENSITY_BP, EXACT_BP, EXACT_HARD_BP, EXACT_LEAST_BP, OCC_CLASSES, EngineError

#: Where a comparison asks before it goes on, and the sides of a containment grid with its cost limit.
ASK_ANCHORS, ASK_GB = 2e9, 2.0
GRID_SIDES, GRID_LEAST, GRID_MOST, GRID_COST = (1024, 768, 640, 512, 416, 320, 256, 192, 128, 96), 64, 1024, 1.2e9


def pick_density(sample: str | int | None, stride: int, t_len: int, q_len: int, most_bp: int | None = None) -> tuple[int, int]:
    """(stride, q_sample). `off` is exact up to a target's length, else an error; `exact` is exact whatever the length: an index in tasks has no wall; `auto` thins both axes to 48 Mb; a number sets the query's sampling."""
    if sample == "exact":
        return 1, 1
    if sample == "off":
        ceiling = min(EXACT_HARD_BP, max(EXACT_LEAST_BP, most_bp or EXACT_BP))
        if t_len > ceiling:
            raise EngineError(f"Exact mode takes up to {ceiling:,} target bases; this target has {t_len:,}.", {"sample": "auto", "most_bp": min(t_len, EXACT_HARD_BP)} if t_len <= EXACT_HARD_BP else {"sample": "exact"})
        return 1, 1
    auto = max(1, math.ceil(q_len / DENSITY_BP))
    return max(stride, math.ceil(t_len / DENSITY_BP), 1), auto if sample in (None, "auto") else max(1, int(sample))


def histogram(spectrum: DataFrame) -> tuple[dict[int, int], dict[int, float]]:
    rows = spectrum.collect()
    return {r["cls"]: r["occ_count"] for r in rows}, {r["cls"]: r["occ_sumsq"] for r in rows}


def anchor_scale(q_len: int, t_len: int, stride: int, q_sample: int) -> float:
    return q_len * stride / max(t_len, 1) / max(q_sample, 1)


def estimate_anchors(sumsq: dict[int, float], cap: float, scale: float) -> float:
    """Anchors of one strand if k-mers above the cap are left out."""
    return sum(v for o, v in sumsq.items() if o <= cap) * scale


def pick_cutoff(sumsq: dict[int, float], scale: float, cap: float | None, budget: float = ANCHOR_BUDGET) -> float | None:
    """The largest occurrence up to the cap whose anchors, added up, fit the budget; classes up to 4 always do. If all classes fit the cap itself holds, None for none."""
    limit = math.inf if cap is None else max(1, math.floor(cap))
    total, chosen = 0.0, 1
    for o in range(1, int(min(OCC_CLASSES, limit)) + 1):
        total += sumsq.get(o, 0.0) * scale
        if total > budget and o > 4:
            break
        chosen = o
    if chosen == OCC_CLASSES:
        return None if cap is None else limit
    return chosen


def check_volume(anchors: float, t_len: int, q_len: int, confirm: bool = False) -> dict[str, float]:
    """Anchors of both strands and GB of diagonals; an error above the limits unless confirmed."""
    both = 2 * anchors
    gb = min(both / 2, t_len + q_len) * 28 * 8 / 3 / 1e9
    if (both > ASK_ANCHORS or gb > ASK_GB) and not confirm:
        raise EngineError(f"About {both:,.0f} anchors and {gb:.1f} GB of diagonals are expected.", {"sample": "auto", "confirm": True})
    return {"anchors": both, "table_gb": gb}


def grid_side(counts: dict[int, int], asked: int | None = None, most: int = 512) -> int:
    """Tiles on a side of a containment grid: what is asked for within limits, or the finest whose expected cost is in bounds."""
    if asked:
        return max(GRID_LEAST, min(GRID_MOST, asked))
    for n in (x for x in GRID_SIDES if x <= most):
        if sum(c * (n * (1 - math.exp(-o / n))) ** 2 for o, c in counts.items()) <= GRID_COST:
            return n
    return GRID_LEAST
