"""Numbers as text, ticks and report layout."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From where on a number is written in the next unit, and the steps of ticks.
UNITS = ((999.5e6, 1e9, "Gb"), (999.5e3, 1e6, "Mb"), (999.5, 1e3, "kb"))
TICK_UNITS = ((1e9, "Gb"), (1e6, "Mb"), (1e3, "kb"), (1.0, "bp"))


def rounded(v: float) -> int:
    """Half up, towards plus infinity."""
    return math.floor(v + 0.5)


def _short(x: float) -> str:
    text = f"{x:.{2 if abs(x) < 10 else 1 if abs(x) < 100 else 0}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def format_bp(v: float) -> str:
    for least, unit, name in UNITS:
        if abs(v) >= least:
            return f"{_short(v / unit)} {name}"
    return f"{rounded(v)} bp"


def format_bp_column(v: Column) -> Column:
    """format_bp for a column of doubles."""

    def fixed(x: Column, decimals: int) -> Column:
        """x with so many decimals, ties away from zero, as the double itself is (not as its shortest decimal form)."""
        scale = 10**decimals
        size = F.abs(x)
        below = F.floor(size * scale)
        # 2 * scale * size without rounding, as a sum: the product and its error.
        split = size * 134217729.0
        high = split - (split - size)
        product = size * (2 * scale)
        error = (high * (2 * scale) - product) + (size - high) * (2 * scale)
        n = below + F.when((product - (2 * below + 1)) + error >= 0, 1).otherwise(0)
        whole = F.floor(n / scale).cast("string")
        digits = F.concat(whole, F.lit("."), F.lpad((n % scale).cast("string"), decimals, "0")) if decimals else whole
        return F.concat(F.when(x < 0, "-").otherwise(""), digits)

    def short(x: Column) -> Column:
        a = F.abs(x)
        text = F.when(a < 10, fixed(x, 2)).when(a < 100, fixed(x, 1)).otherwise(fixed(x, 0))
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)

    out = F.concat(F.floor(v + 0.5).cast("string"), F.lit(" bp"))
    for least, unit, name in reversed(UNITS):
        out = F.when(F.abs(v) >= least, F.concat(short(v / unit), F.lit(f" {name}"))).otherwise(out)
    return out


def format_count(v: float) -> str:
    return f"{_short(v / 1e6)} M" if v >= 1e6 else f"{_short(v / 1e3)} k" if v >= 1e3 else str(rounded(v))


def format_int(v: float) -> str:
    return f"{rounded(v):,}"


def format_tick(v: float, step: float) -> str:
    """A tick's label with as many decimals as the step needs; a place in full where those would be more than three."""
    if v == 0:
        return "0"
    unit, name = next((u, n) for u, n in TICK_UNITS if max(abs(v), step) >= u or u == 1.0)
    decimals = max(0, math.ceil(-math.log10(step / unit) - 1e-9))
    return format_int(v) if decimals > 3 else f"{v / unit:.{decimals}f} {name}"


def format_percent(share: float) -> str:
    """Whole per cent from 9.5 on, else one decimal."""
    p = 100 * share
    return f"{rounded(p)}%" if p >= 9.5 else f"{p:.1f}%"


def record_labels(target: Sequence[str], query: Sequence[str]) -> list[str]:
    """Names of the records of both axes, target first; a name that the other axis has as well gets (x) or (y)."""
    here, there = set(target), set(query)
    return [f"{n} (x)" if n in there else n for n in target] + [f"{n} (y)" if n in here else n for n in query]


def record_region(name: str, offset: int, lo: int, hi: int) -> str:
    """A window of a record, from 1 and with the record's offset."""
    return f"{name}:{offset + lo + 1:,}-{offset + hi:,}"


def nice_step(span: float, most: int) -> float:
    """A step of 1, 2 or 5 times a power of ten that cuts a span into about `most` parts."""
    raw = span / max(1, most)
    power = 10.0 ** math.floor(math.log10(raw))
    ratio = raw / power
    return power * (1 if ratio < 1.5 else 2 if ratio < 3.5 else 5 if ratio < 7.5 else 10)


def ticks(lo: float, hi: float, most: int) -> list[float]:
    step = nice_step(hi - lo, most)
    return [i * step for i in range(math.ceil(lo / step), math.floor(hi / step) + 1)]


def spaced_labels(labels: Sequence[tuple[float, float]], gap: float) -> list[int]:
    """Which labels (start, end; in order) are kept so that each starts more than `gap` after the one kept before."""
    kept, reach = [], -math.inf
    for i, (start, end) in enumerate(labels):
        if start > reach + gap:
            kept.append(i)
            reach = end
    return kept


def flow(panels: Sequence[tuple[float, float]], width: float, gap: float) -> tuple[list[tuple[float, float]], float]:
    """Places of panels (width, height) that flow from left to right and wrap, and the height of all."""
    x = y = row = 0.0
    out = []
    for w, h in panels:
        if x and x + w > width:
            x, y, row = 0.0, y + row + gap, 0.0
        out.append((x, y))
        x, row = x + w + gap, max(row, h)
    return out, y + row


class Camera:
    """A view of both axes: centre and bases to a pixel."""

    def __init__(self, cx: float, cy: float, bp: float, width: float, height: float):
        self.cx, self.cy, self.bp, self.width, self.height = cx, cy, bp, width, height

    @classmethod
    def fit(cls, x0: float, x1: float, y0: float, y1: float, width: float, height: float) -> Camera:
        return cls((x0 + x1) / 2, (y0 + y1) / 2, max((x1 - x0) / width, (y1 - y0) / height), width, height)

    def bounds(self) -> tuple[float, float, float, float]:
        w, h = self.bp * self.width / 2, self.bp * self.height / 2
        return self.cx - w, self.cx + w, self.cy - h, self.cy + h

    def zoom(self, factor: float, px: float, py: float) -> Camera:
        """The point under the pixel stays where it is."""
        wx, wy = self.cx + (px - self.width / 2) * self.bp, self.cy + (py - self.height / 2) * self.bp
        bp = self.bp * factor
        return Camera(wx - (px - self.width / 2) * bp, wy - (py - self.height / 2) * bp, bp, self.width, self.height)

    def pan(self, dx: float, dy: float) -> Camera:
        return Camera(self.cx - dx * self.bp, self.cy - dy * self.bp, self.bp, self.width, self.height)

    def clamp(self, x_total: float, y_total: float) -> Camera:
        return Camera(min(max(self.cx, 0), x_total), min(max(self.cy, 0), y_total), self.bp, self.width, self.height)
