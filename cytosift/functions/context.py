"""Cytosine contexts of a stretch of sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXTS = ("CpG", "CHG", "CHH")


def complement(base: Column) -> Column:
    """Of an upper-case base; N for all that isn't one of A, C, G, T."""
    return F.when(base.isin("A", "C", "G", "T"), F.translate(base, "ACGT", "TGCA")).otherwise(F.lit("N"))


def known(base: Column) -> Column:
    return F.when(base.isin("A", "C", "G", "T"), base).otherwise(F.lit("N"))


def context(base: Column, before2: Column, before1: Column, after1: Column, after2: Column) -> Column:
    """CpG, else CHG, else CHH of a C or G by its neighbours on the forward strand; null for other bases.
    A neighbour beyond the contig is any letter that isn't C or G."""
    return (
        F.when(((base == "C") & (after1 == "G")) | ((base == "G") & (before1 == "C")), "CpG")
        .when(((base == "C") & (after2 == "G")) | ((base == "G") & (before2 == "C")), "CHG")
        .when(base.isin("C", "G"), "CHH")
    )


def trinucleotide(base: Column, before2: Column, before1: Column, after1: Column, after2: Column) -> Column:
    """The cytosine and the two bases that follow it on its own strand; N for what isn't known or beyond the contig."""
    return F.when(base == "C", F.concat(F.lit("C"), known(after1), known(after2))).when(base == "G", F.concat(F.lit("C"), complement(before1), complement(before2)))


def report_context(name: Column) -> Column:
    return F.when(name == "CpG", "CG").otherwise(name)
