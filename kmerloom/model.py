"""Schemas of the engine's tables and the options of a comparison.

Coordinates are 0-based and half-open. An axis lays its records end to end; `start` is where a record begins on it, `offset` what its own base 0 is called outside.
"""

from __future__ import annotations

from dataclasses import dataclass

RECORD = "rec long, name string, start long, len long, offset long, seq string"
CATALOG = "rec long, name string, start long, end long, offset long"
SEGMENT = "x long, y long, dx long, dy long, strand int, qrec long, trec long, gap_bases long, identity double"
BED_ITEM = "chrom string, start long, end long, name string, strand string, rgb string"
PAF = "line_no long, qname string, qlen long, qs long, qe long, strand string, tname string, tlen long, ts long, te long, nmatch long, alnlen long, mapq string, tags array<string>"

#: Limits and defaults of the engine.
K_MIN, K_MAX = 4, 26
SEGMENT_WALL, SEGMENT_WALL_HARD = 16_000_000, 64_000_000
OCC_CLASSES = 1024
SATURATION_TILE = 512
ANCHOR_BUDGET = 60_000_000
DENSITY_BP = 48_000_000
EXACT_BP, EXACT_HARD_BP, EXACT_LEAST_BP = 128_000_000, 1_000_000_000, 1_000_000
SKETCH_CAP = 24_000_000
BELONGS_MIN, BELONGS_MAX = 2, 64


class EngineError(ValueError):
    """A request that can't be met; `remedies` lists option changes that would help."""

    def __init__(self, text: str, remedies: dict | None = None):
        super().__init__(text)
        self.remedies = remedies or {}


@dataclass(frozen=True)
class MatchOptions:
    """Options of a comparison. None stands for off: no cap, no budget."""

    k: int = 15
    max_gap: int = 0
    max_occ: int | None = 200
    min_run: int = 0
    stride: int = 1
    q_sample: int = 1
    max_segments: int = SEGMENT_WALL

    def __post_init__(self) -> None:
        if not K_MIN <= self.k <= K_MAX:
            raise EngineError(f"k must be {K_MIN}..{K_MAX} (got {self.k})")
        if self.stride < 1 or self.q_sample < 1:
            raise EngineError("stride and q_sample must be 1 or more")

    @property
    def cap(self) -> int | None:
        """The occurrence cap in entries of a strided index."""
        return None if self.max_occ is None else max(1, self.max_occ // self.stride)

    @property
    def hole(self) -> int:
        """Missing starts between neighbouring samples."""
        return self.q_sample * self.stride - 1

    @property
    def least_run(self) -> int:
        """Sampling raises the least run length."""
        return max(self.min_run, self.k + 3 * self.q_sample * self.stride) if self.hole else self.min_run
