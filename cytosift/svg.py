"""Methylation bias plots as SVG, from the few thousand rows of an aggregate."""

from __future__ import annotations

from dataclasses import dataclass
from html import escape

WIDTH = HEIGHT = 500
MARGIN = 80
COLORS = {1: "#1f5fa8", 2: "#b8442c"}


@dataclass(frozen=True)
class Point:
    read: int
    position: int
    fraction: float
    low: float
    high: float


def steps(low: float, high: float, most: int = 6) -> list[float]:
    """Round tick values within [low, high], at most `most` + 1 of them."""
    span = max(high - low, 1e-9)
    unit = 10.0 ** -6
    while True:
        for k in (1, 2, 5):
            if span / (unit * k) <= most:
                step = unit * k
                first = -(-low // step)
                return [round((first + i) * step, 9) for i in range(int((high + 1e-9) // step - first) + 1)]
        unit *= 10


def plot(points: list[Point], title: str, bounds: dict[int, tuple[int, int]] | None = None) -> str:
    """A plot of one strand: for each read number its fractions, a band for the intervals, and its suggested bounds, dashed."""
    xs = [p.position for p in points] or [1]
    left, right = min(xs), max(max(xs), min(xs) + 1)
    bottom = max(0.0, min((p.low for p in points), default=0.0) - 0.03)
    top = min(1.0, max((p.high for p in points), default=1.0) + 0.03)
    top = max(top, bottom + 0.01)
    x = lambda v: round(MARGIN + (v - left) / (right - left) * WIDTH, 2)
    y = lambda v: round(MARGIN + (top - v) / (top - bottom) * HEIGHT, 2)
    side = WIDTH + 2 * MARGIN
    out = [
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{side}" height="{side}" font-family="sans-serif" font-size="12">',
        f'<rect width="{side}" height="{side}" fill="white"/><text x="{side / 2}" y="{MARGIN / 2}" text-anchor="middle" font-size="16">{escape(title)}</text>',
        f'<rect x="{MARGIN}" y="{MARGIN}" width="{WIDTH}" height="{HEIGHT}" fill="none" stroke="black"/>',
        f'<text x="{side / 2}" y="{side - 25}" text-anchor="middle">Position along the read</text>',
        f'<text x="22" y="{side / 2}" text-anchor="middle" transform="rotate(-90 22 {side / 2})">Methylated fraction</text>',
    ]
    for v in steps(left, right, 10):
        if v == int(v):
            out.append(f'<path d="M{x(v)} {MARGIN + HEIGHT}v6" stroke="black"/><text x="{x(v)}" y="{MARGIN + HEIGHT + 20}" text-anchor="middle">{int(v)}</text>')
    for v in steps(bottom, top):
        out.append(f'<path d="M{MARGIN} {y(v)}h-6" stroke="black"/><text x="{MARGIN - 10}" y="{y(v) + 4}" text-anchor="end">{v:g}</text>')
    for n, read in enumerate(sorted({p.read for p in points})):
        own = sorted((p for p in points if p.read == read), key=lambda p: p.position)
        color = COLORS.get(read, "black")
        band = [f"{x(p.position)},{y(p.high)}" for p in own] + [f"{x(p.position)},{y(p.low)}" for p in reversed(own)]
        out.append(f'<polygon points="{" ".join(band)}" fill="{color}" fill-opacity="0.2"/>')
        out.append(f'<polyline points="{" ".join(f"{x(p.position)},{y(p.fraction)}" for p in own)}" fill="none" stroke="{color}"/>')
        out.append(f'<text x="{side - MARGIN + 8}" y="{MARGIN + 16 + 18 * n}" fill="{color}">read {read}</text>')
        for v in (bounds or {}).get(read, (0, 0)):
            if v:
                out.append(f'<path d="M{x(v)} {MARGIN}v{HEIGHT}" stroke="{color}" stroke-dasharray="5 1"/>')
    return "\n".join([*out, "</svg>", ""])
