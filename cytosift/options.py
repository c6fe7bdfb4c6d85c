"""Options of the commands, validated on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .functions.strand import STRANDS


def bounds(text: str) -> tuple[int, int, int, int]:
    """``a,b,c,d``: four whole numbers that aren't negative."""
    parts = [x.strip() for x in text.split(",")]
    if len(parts) != 4 or not all(re.fullmatch(r"\d+", x) for x in parts):
        raise ValueError(f"bounds are four whole numbers divided by commas, none negative: {text!r}")
    a, b, c, d = map(int, parts)
    return a, b, c, d


def flags(text: str | int) -> int:
    """A flag mask in decimal or, with 0x, in hexadecimal."""
    value = text if isinstance(text, int) else int(text, 0)
    if value < 0:
        raise ValueError(f"a flag mask isn't negative: {text!r}")
    return value


def region(text: str) -> tuple[str, int, int | None]:
    """``chrom``, ``chrom:from`` or ``chrom:from-to``, 1-based and inclusive, commas allowed -> (chrom, start, end or None), 0-based half-open."""
    m = re.fullmatch(r"(.+?)(?::([\d,]+)(?:-([\d,]+))?)?", text)
    if not m:
        raise ValueError(f"not a region: {text!r}")
    chrom, first, last = m.groups()
    start = int(first.replace(",", "")) - 1 if first else 0
    end = int(last.replace(",", "")) if last else None
    if start < 0 or (end is not None and end <= start):
        raise ValueError(f"an empty region: {text!r}")
    return chrom, start, end


@dataclass(frozen=True)
class ReadOptions:
    """Which reads count."""

    min_mapq: int = 10
    min_phred: int = 5
    ignore_flags: int = 0xF00
    require_flags: int = 0
    keep_dupes: bool = False
    keep_singleton: bool = False
    keep_discordant: bool = False
    ignore_nh: bool = False
    min_conversion_efficiency: float = 0.0
    #: (chrom, start, end): calls at these positions only.
    region: tuple[str, int, int | None] | None = None
    keep_strand: bool = False
    #: Inclusion bounds and absolute trims by strand of origin: read 1 from the left, from the right, read 2 likewise.
    bounds: dict[str, tuple[int, int, int, int]] = field(default_factory=dict)
    trims: dict[str, tuple[int, int, int, int]] = field(default_factory=dict)
    mappability_cutoff: float = 0.01
    min_mappable_bases: int = 15

    def __post_init__(self):
        object.__setattr__(self, "min_mapq", max(0, self.min_mapq))
        object.__setattr__(self, "min_phred", max(1, self.min_phred))
        if self.keep_dupes:
            object.__setattr__(self, "ignore_flags", self.ignore_flags & ~0x400)
        for given in (self.bounds, self.trims):
            for name, values in given.items():
                if name not in STRANDS or len(values) != 4 or min(values) < 0:
                    raise ValueError(f"bounds of {name!r}: {values!r}")
        if not 0 <= self.min_conversion_efficiency <= 1:
            raise ValueError("the least conversion efficiency lies between 0 and 1")


FORMATS = ("bedgraph", "fraction", "counts", "logit", "methylkit", "cytosine_report")


@dataclass(frozen=True)
class ExtractOptions(ReadOptions):
    """Which sites are reported, and how."""

    contexts: tuple[str, ...] = ("CpG",)
    min_depth: int = 1
    merge_context: bool = False
    output: str = "bedgraph"
    min_opposite_depth: int = 0
    max_variant_frac: float = 0.0
    #: What a variant does to a merged site: `reference` (a variant G drops the site, a variant C leaves the G alone) or `either` (any drops it).
    variant_merge: str = "reference"

    def __post_init__(self):
        super().__post_init__()
        if not self.contexts or set(self.contexts) - {"CpG", "CHG", "CHH"}:
            raise ValueError(f"contexts are of CpG, CHG and CHH, one at least: {self.contexts!r}")
        if self.output not in FORMATS:
            raise ValueError(f"output is one of {FORMATS}: {self.output!r}")
        if self.min_depth < 1:
            raise ValueError("the least depth is 1 or more")
        if self.merge_context and self.output in ("methylkit", "cytosine_report"):
            raise ValueError(f"{self.output} doesn't go with merging")
        if self.variant_merge not in ("reference", "either"):
            raise ValueError(f"variant_merge: {self.variant_merge!r}")
        if self.min_opposite_depth < 0 or not 0 <= self.max_variant_frac <= 1:
            raise ValueError("the variant filter takes a depth of 0 or more and a fraction between 0 and 1")
