"""Strand of origin: 1 OT, 2 OB, 3 CTOT, 4 CTOB; 0 where a paired read is neither first nor second."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRANDS = ("OT", "OB", "CTOT", "CTOB")


def has(flag: Column, mask: int) -> Column:
    """Whether all bits of the mask are set."""
    return flag.bitwiseAND(F.lit(mask)) == mask


def strand_of_origin(flag: Column, xg: Column) -> Column:
    """From the flag, and from the genome strand that the aligner names in XG where there is one."""
    paired, first, second, reverse = has(flag, 0x1), has(flag, 0x41), has(flag, 0x81), has(flag, 0x10)
    # a paired read's bits are read together with the paired bit
    plain = (
        F.when(paired & has(flag, 0x50), 2).when(paired & has(flag, 0x40), 1).when(paired & has(flag, 0x90), 1).when(paired & has(flag, 0x80), 2).when(paired, 0)
        .when(reverse, 2).otherwise(1)
    )
    ct = F.when(first & ~reverse, 1).when(first, 3).when(second & ~reverse, 3).when(second, 1).when(reverse, 3).otherwise(1)
    ga = F.when(first & ~reverse, 4).when(first, 2).when(second & ~reverse, 2).when(second, 4).when(reverse, 2).otherwise(4)
    letter = F.substring(xg, 1, 1)
    return F.when(letter == "C", ct).when(letter == "G", ga).otherwise(plain)


def strand_name(strand: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STRANDS)), strand)


def is_second(flag: Column) -> Column:
    return has(flag, 0x80)
