"""Genome chunks and cytosine sites.

A genome table holds contigs in chunks that carry the sequence with a margin of two bases on either side, so contexts
need neither a window over a contig nor a shuffle. Sites are gathered into bins, one row a bin, for joins with reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.context import context, trinucleotide

MARGIN = 2
SITE_BIN = 128
#: Bases of a genome up to which its sites are broadcast: 32 bytes a site, of which four bases have about one of a context.
BROADCAST_BASES = 4_000_000


def contigs(genome: DataFrame) -> DataFrame:
    return genome.select("tid", "chrom", "length").distinct()


def sites(genome: DataFrame, contexts: tuple[str, ...] = ("CpG", "CHG", "CHH")) -> DataFrame:
    """(tid, chrom, pos, base, context, tnc) of every C and G whose context is asked for. `seq` of a chunk begins MARGIN bases before `start`
    and ends as many after it, filled up with `.` beyond the contig."""

    def at(offset: int) -> Column:
        return F.substring("seq", F.col("i") + (1 + MARGIN + offset), F.lit(1))

    near = [at(-2), at(-1), at(1), at(2)]
    rows = genome.withColumn("seq", F.upper("seq")).withColumn("i", F.explode(F.sequence(F.lit(0), F.length("seq") - (2 * MARGIN + 1))))
    rows = rows.withColumn("base", at(0)).where("base IN ('C', 'G')")
    out = rows.select("tid", "chrom", (F.col("start") + F.col("i")).alias("pos"), "base", context(F.col("base"), *near).alias("context"), trinucleotide(F.col("base"), *near).alias("tnc"))
    return out if len(contexts) == 3 else out.where(F.col("context").isin(*contexts))


def region_span(genome: DataFrame, region: tuple[str, int, int | None] | None) -> tuple[str, int, int | None] | None:
    """The region with its end moved so that a CpG or CHG isn't split: by 2 where its last base is C and the second base after
    it G, else by 1 where the base after it is G. Its start stays. Looks up one chunk."""
    if region is None or region[2] is None:
        return region
    chrom, start, end = region
    chunk = genome.where((F.col("chrom") == chrom) & (F.col("start") <= end - 1) & (F.col("start") + F.length("seq") - 2 * MARGIN > end - 1))
    last = chunk.select(F.upper(F.substring("seq", F.lit(end) - F.col("start") + MARGIN, F.lit(3))).alias("s")).first()
    s = last.s if last else ""
    # s: the region's last base and the two after it
    return chrom, start, end + (2 if s[:1] == "C" and s[2:3] == "G" else 1 if s[1:2] == "G" else 0)


def within(found: DataFrame, span: tuple[str, int, int | None] | None) -> DataFrame:
    """Sites of a span."""
    if span is None:
        return found
    chrom, start, end = span
    found = found.where((F.col("chrom") == chrom) & (F.col("pos") >= start))
    return found if end is None else found.where(F.col("pos") < end)


def binned(found: DataFrame, *more: str) -> DataFrame:
    """(chrom, bin, sites array): the sites of each bin of SITE_BIN positions."""
    site = F.struct("pos", "base", "context", *more)
    return found.groupBy("chrom", F.floor(F.col("pos") / SITE_BIN).alias("bin")).agg(F.collect_list(site).alias("sites"))


def small_genome(genome: DataFrame) -> bool:
    total = genome.agg(F.sum(F.length("seq"))).first()[0] or 0
    return total <= BROADCAST_BASES
