"""Small grammars of a user's text: lengths, regions, lists of regions, options and links. For one request at a time; `parse_bp_column` does lengths for whole tables."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields
from urllib.parse import parse_qs, quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from kmerloom.model import SEGMENT_WALL, SEGMENT_WALL_HARD, EngineError

#: The grammar of lengths, its units, and what parts the ends of a range.
LENGTH = r"^([0-9]*\.?[0-9]+)(bp|k|kb|m|mb|g|gb)?$"
FACTORS = {"": 1, "b": 1, "k": 10**3, "m": 10**6, "g": 10**9}
DASH = re.compile("[-–]")


def parse_bp(text: str) -> float:
    """A number of bases with a unit, commas and blanks ignored; NaN for anything else."""
    found = re.match(LENGTH, re.sub("[, ]", "", text.strip().lower()))
    if found is None:
        return math.nan
    number, unit = found.groups(default="")
    return float(number) * FACTORS[unit[:1]]


def parse_bp_column(text: Column) -> Column:
    """parse_bp for a column; null for what it can't read."""
    bare = F.regexp_replace(F.lower(F.trim(text)), "[, ]", "")
    unit = F.substring(F.regexp_extract(bare, LENGTH, 2), 1, 1)
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.when(bare.rlike(LENGTH), F.regexp_extract(bare, LENGTH, 1).try_cast("double") * factor)


@dataclass(frozen=True)
class Record:
    name: str
    start: int
    end: int
    offset: int = 0


def _find(records: list[Record], name: str) -> Record | None:
    return next((r for r in records if r.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class Place:
    """What a text asks for: a name (None for the whole axis), the text of a range (None for all), and its ends in bases."""

    name: str | None
    span: str | None
    ends: tuple[float, float] | None


def read_place(text: str) -> Place | None:
    """`name:a-b`, `name:` or `a-b` in parts; None for anything else. Whether a name is known is not asked here."""
    name, colon, span = text.rpartition(":")
    if colon and not name or not colon and not span[:1].isdigit():
        return None
    if not span.strip():
        return Place(name.strip(), None, None)
    parts = DASH.split(span)
    numbers = [parse_bp(x) for x in parts]
    if len(numbers) != 2 or not numbers[0] < numbers[1]:
        return None
    return Place(name.strip() if colon else None, "-".join(parts), (numbers[0], numbers[1]))


def resolve_region(text: str, records: list[Record]) -> tuple[float, float, str] | None:
    """Place of `name`, `name:a-b` or `a-b` on an axis, and a label. 0-based. A whole name comes first, even one with a colon; coordinates at or beyond the record's offset are taken as outside ones."""
    text = text.strip()
    whole, asked = _find(records, text), read_place(text)
    if whole or asked is None:
        return (whole.start, whole.end, whole.name) if whole else None
    record = Record("", 0, max((r.end for r in records), default=0)) if asked.name is None else _find(records, asked.name)
    if record is None:
        return None
    if asked.ends is None:
        return record.start, record.end, record.name
    outside = record.offset if 0 < record.offset <= asked.ends[0] else 0
    x0, x1 = (record.start + min(max(end - outside, 0), record.end - record.start) for end in asked.ends)
    label = asked.span if asked.name is None else f"{asked.name}:{asked.span}"
    return (x0, x1, label) if x0 < x1 else None


def parse_browser_region(text: str) -> tuple[str, int | None, int | None, str | None] | None:
    """chrom, first and last base (1-based, inclusive; None for all) and arm (p, q or None)."""
    chrom, colon, span = text.strip().rpartition(":") if ":" in text else (text.strip(), "", "")
    chrom = chrom.strip()
    if not chrom:
        return None
    arm = re.fullmatch(r"(chr[0-9XYM]+)([pq])", chrom, re.IGNORECASE)
    chrom, side = (arm[1], arm[2].lower()) if arm else (chrom, None)
    if not colon:
        return chrom, None, None, side
    ends = [parse_bp(x) for x in DASH.split(span)]
    if len(ends) != 2 or any(math.isnan(x) for x in ends):
        return None
    a, b = (math.floor(x + 0.5) for x in ends)
    return (chrom, a, b, side) if 1 <= a <= b else None


def window_of(region: tuple[str, int | None, int | None, str | None], size: int, arms: tuple[int, int] | None = None) -> tuple[int, int]:
    """0-based window of a browser region: coordinates or an arm, not both. arms: where p ends and q begins."""
    _, a, b, arm = region
    if arm and a is not None:
        raise EngineError("Give an arm or coordinates, not both.")
    if arm:
        if arms is None:
            raise EngineError("The arms of this sequence are not known.")
        return (0, arms[0]) if arm == "p" else (arms[1], size)
    return (0, size) if a is None else (min(a - 1, size), min(b, size))


def split_regions(text: str) -> list[str]:
    """Regions of a list: `;` always parts them, `,` only before a letter or an underscore."""
    return [x.strip() for x in re.split(r";|,(?=\s*[A-Za-z_])", text) if x.strip()]


def regions_label(regions: list[tuple[str, int, int, str | None]]) -> str:
    """Of windows (chrom, start, end, name; 0-based): how many there are, or the one's name, or its coordinates from 1."""
    if len(regions) != 1:
        return f"{len(regions)} regions"
    chrom, start, end, name = regions[0]
    return name or f"{chrom}:{start + 1:,}-{end:,}"


def split_cross(text: str) -> tuple[str, str | None]:
    """Both sides of `a vs b`; without it all is the target."""
    found = re.fullmatch(r"(.*?\S)\s+vs\.?\s+(\S.*)", text.strip(), re.IGNORECASE | re.DOTALL)
    return (found[1].strip(), found[2].strip()) if found else (text.strip(), None)


def parse_sample(text: str) -> tuple[str | int, float | None]:
    """Sampling: auto, off, off with a ceiling (`off 512M`), or a number."""
    text = text.strip().lower()
    if text in ("", "auto"):
        return "auto", None
    if text.startswith("off"):
        most = parse_bp(text[3:]) if text[3:].strip() else math.nan
        return "off", None if math.isnan(most) else most
    number = parse_bp(text)
    return ("auto", None) if math.isnan(number) else (max(1, int(number)), None)


def parse_occurrence(text: str) -> int | None:
    """An occurrence cap; None for off or 0."""
    text = text.strip().lower()
    number = parse_bp(text)
    return None if text == "off" or number == 0 else 200 if math.isnan(number) else int(number)


def parse_budget(text: str) -> float | None:
    """A multiple of the anchor budget, 1 to 64; None for off."""
    text = text.strip().lower().rstrip("×x")
    if text == "off":
        return None
    number = parse_bp(text) if text not in ("", "auto") else 1.0
    return 1.0 if math.isnan(number) else min(64.0, max(1.0, number))


@dataclass(frozen=True)
class Link:
    """Options that a link carries; those at their defaults are left out."""

    k: int = 15
    gap: int = 64
    occ: int | None = 200
    minrun: int = 0
    sample: str | int = "auto"
    exact_bp: float | None = None
    budget: float | None = 1.0
    anitiles: int = 0
    wall: int = 0


def write_link(o: Link) -> dict[str, str]:
    default, out = Link(), {}
    for f in fields(o):
        value = getattr(o, f.name)
        if value == getattr(default, f.name) or f.name == "exact_bp":
            continue
        out[f.name] = "off" if value is None else f"{value / 1e6:.0f}M" if f.name == "wall" else f"{value:g}" if isinstance(value, float) else str(value)
    if o.sample == "off" and o.exact_bp:
        out["sample"] = f"off {o.exact_bp / 1e6:.0f}M"
    return out


def read_link(params: dict[str, str]) -> Link:
    """The inverse, which ignores what it does not know. A wall only raises the default, up to the hard one."""
    number = lambda name, default: default if math.isnan(v := parse_bp(params.get(name, ""))) else int(v)
    sample, exact = parse_sample(params.get("sample", "auto"))
    wall = number("wall", 0)
    return Link(number("k", 15), number("gap", 64), parse_occurrence(params.get("occ", "200")), number("minrun", 0), sample, exact, parse_budget(params.get("budget", "1")), number("anitiles", 0), min(SEGMENT_WALL_HARD, wall) if wall > SEGMENT_WALL else 0)


@dataclass(frozen=True)
class View:
    x0: int
    x1: int
    y0: int
    y1: int
    len: str = "off"
    ident: float = 0.0
    draw: str = "seg"
    col: int = 0
    forward: bool = True
    reverse: bool = True
    auto: bool = False


def write_view(v: View) -> str:
    parts = [f"v={v.x0}-{v.x1}:{v.y0}-{v.y1}"]
    parts += [f"len={quote(v.len)}"] * (v.len not in ("", "off", "0")) + [f"ident={v.ident:.3f}"] * (v.ident > 0) + [f"draw={v.draw}"] * (v.draw in ("heat", "ani")) + [f"col={v.col}"] * (v.col in (1, 2))
    parts += ["str=" + "f" * v.forward + "r" * v.reverse] * (not (v.forward and v.reverse)) + ["auto=1"] * v.auto
    return "#" + "&".join(parts)


def read_view(text: str) -> View | None:
    """None without a viewport that can be read; unknown keys are ignored."""
    q = {k: v[0] for k, v in parse_qs(text.lstrip("#"), keep_blank_values=True).items()}
    found = re.fullmatch(r"(-?\d+)-(-?\d+):(-?\d+)-(-?\d+)", q.get("v", ""))
    if not found:
        return None
    x0, x1, y0, y1 = map(int, found.groups())
    if x1 <= x0 or y1 <= y0:
        return None
    try:
        ident = min(1.0, max(0.0, float(q.get("ident", "0"))))
    except ValueError:
        ident = 0.0
    draw, col, strands = q.get("draw"), q.get("col"), q.get("str", "fr")
    return View(x0, x1, y0, y1, q.get("len", "off"), ident, draw if draw in ("heat", "ani") else "seg", int(col) if col in ("1", "2") else 0, "f" in strands, "r" in strands, q.get("auto") == "1")
