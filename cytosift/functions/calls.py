"""Base calls and their scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of the 99.9 % Agresti-Coull interval: Z and its square (fixed values).
Z, Z2 = 3.2905267315, 10.8275661707


def odd(strand: Column) -> Column:
    return strand.bitwiseAND(F.lit(1)) == 1


def call(strand: Column, base: Column) -> Column:
    """+1 methylated, -1 unmethylated, 0 neither: C and T on odd strands, G and A on even ones."""
    return F.when(odd(strand), F.when(base == "C", 1).when(base == "T", -1).otherwise(0)).otherwise(F.when(base == "G", 1).when(base == "A", -1).otherwise(0))


def own_strand(strand: Column, ref: Column) -> Column:
    """Whether a read of the strand speaks of methylation at the reference base."""
    return odd(strand) == (ref == "C")


def opposite_variant(strand: Column, base: Column) -> Column:
    """Whether a read of the opposite strand contradicts the cytosine: odd strands should have G there, even ones C; N says nothing."""
    return F.when(odd(strand), ~base.isin("G", "N")).otherwise(~base.isin("C", "N"))


def resolved_quality(first: Column, base: Column, qual: Column, mate_base: Column, mate_qual: Column) -> Column:
    """The quality of a base that its mate covers too, so that a fragment counts once. first: whether this is the first mate."""
    apart = F.when((qual > mate_qual) & (base != "N"), qual - mate_qual).otherwise(0)
    boosted = F.least(F.lit(255), F.floor(qual * 6 / 5).cast("int"))
    wins = F.when(first, qual > mate_qual).otherwise(mate_qual <= qual)
    return F.when(base != mate_base, apart).when(wins, boosted).otherwise(0)


def percent(meth: Column, unmeth: Column) -> Column:
    """Whole percent, truncated; null without calls."""
    return F.when(meth + unmeth > 0, F.floor(meth * 100 / F.nullif(meth + unmeth, F.lit(0)))).cast("int")


def fraction(meth: Column, unmeth: Column) -> Column:
    return F.when(meth + unmeth > 0, meth / F.nullif(meth + unmeth, F.lit(0)))


def logit(meth: Column, unmeth: Column) -> Column:
    """ln p - ln(1 - p) of the fraction, infinite at either end."""
    p = fraction(meth, unmeth)
    return F.when(meth + unmeth == 0, F.lit(None)).when(meth == 0, F.lit(float("-inf"))).when(unmeth == 0, F.lit(float("inf"))).otherwise(F.ln(p) - F.ln(1 - p))


def interval(meth: Column, unmeth: Column) -> tuple[Column, Column]:
    """(lower, upper) end of the Agresti-Coull interval of the methylated fraction, within 0 and 1."""
    n = meth + unmeth + F.lit(Z2)
    p = (meth + F.lit(Z2) / 2) / n
    half = F.lit(Z) * F.sqrt(p * (1 - p) / n)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def conversion_efficiency(meth: Column, unmeth: Column) -> Column:
    """In single precision; 1 without calls."""
    return F.coalesce((unmeth / F.nullif(meth + unmeth, F.lit(0))).cast("float"), F.lit(1.0).cast("float"))


def mappability_value(raw: Column) -> Column:
    """A raw 0 to 1 mappability as a whole percent, rounded half up; NaN is 0."""
    return F.floor(F.nanvl(raw.cast("double"), F.lit(0.0)) * 100 + 0.5).cast("int")


def mappable(value: Column, cutoff: float) -> Column:
    """Against the cutoff in single precision, times 100 in double."""
    return value >= F.lit(cutoff).cast("float").cast("double") * 100


def printf(value: Column, digits: int) -> Column:
    """As C's %.{digits}f does: ties to even, `inf` and `-inf`."""
    return F.when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(F.format_string(f"%.{digits}f", F.bround(value, digits)))
