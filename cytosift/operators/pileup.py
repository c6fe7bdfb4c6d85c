"""Reads at sites.

Reads are trimmed, laid along the reference and, where fragments should count once, given their mate's bases, all at one row per
read. They meet the binned sites on (chrom, bin); only then do rows multiply, by the sites of the wanted contexts that a
read covers, not by its bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calls import call, conversion_efficiency, odd, opposite_variant, own_strand, resolved_quality
from ..functions.cigar import GAP, along_reference, let, masked, reference_length
from ..functions.strand import is_second
from ..options import ReadOptions
from .filters import filter_reads, kept_range
from .intervals import mappable_reads, reads_in_regions, strand_matches
from .sites import SITE_BIN, binned, sites, small_genome


def aligned(reads: DataFrame) -> DataFrame:
    return reads.withColumn("ref_end", F.col("pos") + reference_length(F.col("cigar")))


def trimmed(reads: DataFrame, options: ReadOptions) -> DataFrame:
    """Masked read positions get base N and quality 0; they stay, for a mate's sake."""
    if not options.bounds and not options.trims:
        return reads
    out = reads.withColumn("_kept", masked(F.col("seq"), F.col("qual"), *kept_range(options)))
    return out.withColumns({"seq": F.col("_kept.seq"), "qual": F.col("_kept.qual")}).drop("_kept")


def laid(reads: DataFrame, positions: bool = False) -> DataFrame:
    on_ref = let(F.struct("seq", "qual"), lambda r: along_reference(F.col("cigar"), r["seq"], r["qual"], positions))
    return reads.withColumn("on_ref", on_ref).drop("seq", "qual", "cigar")


def may_pair(flag: Column) -> Column:
    """Whether a read is paired, mapped, and has a mapped mate."""
    return (flag.bitwiseAND(F.lit(0x1)) == 1) & (flag.bitwiseAND(F.lit(0xC)) == 0)


def with_mates(reads: DataFrame) -> DataFrame:
    """laid reads with `mate` (pos, bases, quals; null if there is none to compare) and `first_mate`.

    Reads of one name on a contig come and go in order of position. A read that comes is paired with the one that waits, if one does; else it waits,
    until the next comes or any read of the name has gone (ends at or before the next one's start). So two reads are a pair if nothing of
    their name comes or goes in between, and no read is in two. One shuffle of reads by name; those that can't pair have a key each."""
    pairs = may_pair(F.col("flag"))
    comes, goes = F.struct(F.col("pos").alias("at"), F.lit(1).alias("comes")), F.struct(F.col("ref_end").alias("at"), F.lit(0).alias("comes"))
    slim = [c for c in reads.columns if c not in ("read_id", "qname", "chrom")]
    events = reads.withColumn("_event", F.explode(F.when(pairs, F.array(comes, goes)).otherwise(F.array(comes))))
    here = F.col("_event.comes") == 1
    events = events.withColumns({"_name": F.when(pairs, F.col("qname")), "_lone": F.when(~pairs, F.col("read_id"))}).withColumns({c: F.when(here, F.col(c)) for c in slim})
    w = Window.partitionBy("chrom", "_name", "_lone").orderBy("_event.at", "_event.comes", "read_id")
    mate = F.when(here, F.struct("pos", "strand", F.col("on_ref.bases").alias("bases"), F.col("on_ref.quals").alias("quals")))
    out = events.withColumns({"_n": F.row_number().over(w), "_next": F.lead(mate).over(w), "_last": F.lag(mate).over(w)})
    since = F.coalesce(F.max(F.when(~here, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    out = out.withColumn("first_mate", (F.col("_n") - since) % 2 == 1).where(here)
    out = out.withColumn("mate", F.when(F.col("_name").isNull(), F.lit(None)).when(F.col("first_mate"), F.col("_next")).otherwise(F.col("_last")))
    same = (F.col("mate.strand") % 2 == F.col("strand") % 2) & (F.col("mate.pos") < F.col("ref_end")) & (F.col("pos") < F.col("mate.pos") + F.length("mate.bases"))
    return out.withColumn("mate", F.when(same, F.struct("mate.pos", "mate.bases", "mate.quals"))).drop("_next", "_last", "_n", "_event", "_name", "_lone")


def at_sites(reads: DataFrame, wanted: DataFrame, broadcast: bool) -> DataFrame:
    """laid reads x sites: a row for each site that a read has a base at, with `base`, `qual` and, where reads have mates, the resolved quality."""
    bins = F.explode(F.sequence(F.floor(F.col("pos") / SITE_BIN), F.floor(F.greatest(F.col("ref_end") - 1, F.col("pos")) / SITE_BIN)))
    cut = reads.withColumn("bin", bins)
    found = cut.join(F.broadcast(wanted) if broadcast else wanted, ["chrom", "bin"]).drop("bin")
    rows = found.withColumn("site", F.explode(F.filter("sites", lambda s: (s["pos"] >= F.col("pos")) & (s["pos"] < F.col("ref_end"))))).drop("sites")
    offset = (F.col("site.pos") - F.col("pos")).cast("int")
    base, qual = F.substring("on_ref.bases", offset + 1, F.lit(1)), F.get("on_ref.quals", offset)
    rows = rows.withColumns({"base": base, "qual": qual}).where(F.col("base") != GAP)
    if "mate" in reads.columns:
        there = (F.col("site.pos") - F.col("mate.pos")).cast("int")
        other = F.when(there >= 0, F.substring("mate.bases", there + 1, F.lit(1)))
        settled = resolved_quality(F.col("first_mate"), F.col("base"), F.col("qual"), F.col("_mate_base"), F.get("mate.quals", there))
        has_mate = (F.col("_mate_base") != "") & (F.col("_mate_base") != GAP)
        rows = rows.withColumn("_mate_base", other).withColumn("qual", F.when(has_mate, settled).otherwise(F.col("qual"))).drop("_mate_base", "mate", "first_mate")
    return rows


def selected(reads: DataFrame, genome: DataFrame, options: ReadOptions, regions: DataFrame | None = None, mappability: DataFrame | None = None, span: tuple[str, int, int | None] | None = None) -> DataFrame:
    """Reads that pass all filters, trimmed, not yet laid; order: own columns, overlap of a span, regions, mappability, conversion, then trimming."""
    out = aligned(filter_reads(reads, options))
    if span is not None:
        chrom, start, end = span
        out = out.where((F.col("chrom") == chrom) & (F.col("ref_end") > start))
        if end is not None:
            out = out.where(F.col("pos") < end)
    if regions is not None:
        out = reads_in_regions(out, regions)
    if mappability is not None:
        out = mappable_reads(out, mappability, options.mappability_cutoff, options.min_mappable_bases)
    if options.min_conversion_efficiency > 0:
        out = converted(out, genome, options)
    return trimmed(out, options)


def efficiencies(reads: DataFrame, genome: DataFrame, options: ReadOptions) -> DataFrame:
    """(read_id, efficiency) of reads that have calls in CHG or CHH: the unmethylated part of them, in single precision."""
    wanted = binned(sites(genome, ("CHG", "CHH")))
    rows = at_sites(laid(reads.select("read_id", "chrom", "pos", "ref_end", "strand", "cigar", "seq", "qual")), wanted, small_genome(genome))
    called = rows.where(F.col("qual") >= options.min_phred).select("read_id", call(F.col("strand"), F.col("base")).alias("call"))
    sums = called.groupBy("read_id").agg(F.count_if(F.col("call") == 1).alias("meth"), F.count_if(F.col("call") == -1).alias("unmeth"))
    return sums.select("read_id", conversion_efficiency(F.col("meth"), F.col("unmeth")).alias("efficiency"))


def converted(reads: DataFrame, genome: DataFrame, options: ReadOptions) -> DataFrame:
    """Reads of enough conversion efficiency. Only those that fall short are joined back."""
    least = F.lit(options.min_conversion_efficiency).cast("float")
    short = efficiencies(reads, genome, options).where(F.col("efficiency") < least).select("read_id")
    return reads.join(short, "read_id", "left_anti")


def base_calls(reads: DataFrame, genome: DataFrame, options: ReadOptions, contexts: tuple[str, ...], regions: DataFrame | None = None, mappability: DataFrame | None = None, mates: bool = True, positions: bool = False) -> DataFrame:
    """Base calls of enough quality at wanted sites: chrom, pos, ref, context, tnc, strand, read_no, base, own (speaks of methylation), call, variant."""
    from .intervals import region_of_positions
    from .sites import region_span, within

    span = region_span(genome, options.region)
    wanted = within(sites(genome, contexts), span).select("chrom", "pos", "base", "context", "tnc")
    more = ["tnc"]
    if regions is not None:
        wanted = region_of_positions(wanted, regions)
        more.append("region_strand")
    ready = laid(selected(reads, genome, options, regions, mappability, span).select("read_id", "qname", "flag", "chrom", "pos", "ref_end", "strand", "cigar", "seq", "qual"), positions)
    if mates and not reads.where(may_pair(F.col("flag"))).isEmpty():  # reads of single ends are not shuffled
        ready = with_mates(ready)
    rows = at_sites(ready, binned(wanted, *more), small_genome(genome)).where(F.col("qual") >= options.min_phred)
    if regions is not None and options.keep_strand:
        rows = rows.where(strand_matches(F.col("strand"), F.col("site.region_strand")))
    strand, ref = F.col("strand"), F.col("site.base")
    own = own_strand(strand, ref)
    out = {"ref": ref, "context": F.col("site.context"), "tnc": F.col("site.tnc"), "own": own, "call": F.when(own, call(strand, F.col("base"))), "variant": F.when(~own, opposite_variant(strand, F.col("base")))}
    cols = ["chrom", F.col("site.pos").alias("pos"), *[c.alias(k) for k, c in out.items()], "strand", F.when(is_second(F.col("flag")), 2).otherwise(1).alias("read_no"), "base", "read_id"]
    if positions:
        cols.append(F.get("on_ref.qpos", (F.col("site.pos") - F.col("pos")).cast("int")).alias("qpos"))
    return rows.select(*cols)


__all__ = ["aligned", "at_sites", "base_calls", "converted", "efficiencies", "laid", "odd", "selected", "trimmed", "with_mates"]
