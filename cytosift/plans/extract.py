"""`extract`: methylation of each cytosine, or of each CpG or CHG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calls import fraction, logit, percent, printf
from ..functions.context import report_context
from ..operators.aggregate import covered, is_variant, merged, per_site
from ..operators.pileup import base_calls
from ..operators.sites import contigs, region_span, sites, within
from ..options import ExtractOptions


def site_counts(reads: DataFrame, genome: DataFrame, options: ExtractOptions, regions: DataFrame | None = None, mappability: DataFrame | None = None) -> DataFrame:
    """Every site with a base: counts, and `excluded` where the variant filter takes it."""
    calls = base_calls(reads, genome, options, options.contexts, regions, mappability)
    return per_site(calls).withColumn("excluded", is_variant(options))


def extract(reads: DataFrame, genome: DataFrame, options: ExtractOptions = ExtractOptions(), regions: DataFrame | None = None, mappability: DataFrame | None = None) -> DataFrame:
    """The rows of the chosen output, unordered; `ordered` puts them in the order of contigs and positions."""
    found = site_counts(reads, genome, options, regions, mappability)
    if options.output == "cytosine_report":
        return cytosine_report(found, genome, options, regions)
    enough = F.col("n_meth") + F.col("n_unmeth") >= options.min_depth
    if options.merge_context:
        rows = merged(found, options)
    else:
        rows = found.where(~F.col("excluded") & covered()).select("chrom", "context", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "n_meth", "n_unmeth", "ref")
    return project(rows.where(enough), options.output)


def project(rows: DataFrame, output: str) -> DataFrame:
    m, u = F.col("n_meth"), F.col("n_unmeth")
    place = ["chrom", "context", "start", "end"]
    if output == "bedgraph":
        return rows.select(*place, percent(m, u).alias("pct"), "n_meth", "n_unmeth")
    if output == "fraction":
        return rows.select(*place, fraction(m, u).alias("fraction"))
    if output == "counts":
        return rows.select(*place, (m + u).alias("coverage"))
    if output == "logit":
        return rows.select(*place, logit(m, u).alias("logit"))
    at = (F.col("start") + 1).alias("base")
    named = F.concat_ws(".", "chrom", (F.col("start") + 1).cast("string")).alias("chrBase")
    return rows.select("context", named, F.col("chrom").alias("chr"), at, F.when(F.col("ref") == "C", "F").otherwise("R").alias("strand"), (m + u).alias("coverage"), (100.0 * m / (m + u)).alias("freqC"), (100.0 * u / (m + u)).alias("freqT"))


def cytosine_report(found: DataFrame, genome: DataFrame, options: ExtractOptions, regions: DataFrame | None = None) -> DataFrame:
    """Every cytosine of the wanted contexts (within the regions, if any), covered or not; what the variant filter takes counts 0."""
    wanted = within(sites(genome, options.contexts), region_span(genome, options.region))
    if regions is not None:
        from ..operators.intervals import region_of_positions

        wanted = region_of_positions(wanted, regions)
    live = found.where(~F.col("excluded")).select("chrom", "pos", "n_meth", "n_unmeth")
    rows = wanted.join(live, ["chrom", "pos"], "left")
    return rows.select("chrom", (F.col("pos") + 1).alias("pos"), F.when(F.col("base") == "C", "+").otherwise("-").alias("strand"), F.coalesce("n_meth", F.lit(0)).alias("n_meth"), F.coalesce("n_unmeth", F.lit(0)).alias("n_unmeth"), report_context(F.col("context")).alias("context"), "tnc")


def variant_count(reads: DataFrame, genome: DataFrame, options: ExtractOptions, regions: DataFrame | None = None, mappability: DataFrame | None = None) -> DataFrame:
    """One row: how many cytosines the variant filter takes, those without calls of their own included."""
    return site_counts(reads, genome, options, regions, mappability).agg(F.count_if("excluded").alias("n_excluded"))


def ordered(rows: DataFrame, genome: DataFrame, position: str = "start") -> DataFrame:
    """In the order of contigs, then positions: a range-partitioned sort."""
    return rows.join(F.broadcast(contigs(genome).select(F.col("chrom").alias("_chrom"), "tid")), rows["chrom" if "chrom" in rows.columns else "chr"] == F.col("_chrom")).orderBy("tid", position).drop("tid", "_chrom")


def lines(rows: DataFrame, output: str) -> Column:
    """One line of text per row, as the files have it."""
    cols = {
        "bedgraph": ["chrom", "start", "end", "pct", "n_meth", "n_unmeth"], "fraction": ["chrom", "start", "end", printf(F.col("fraction"), 6)] if "fraction" in rows.columns else [],
        "counts": ["chrom", "start", "end", "coverage"], "logit": ["chrom", "start", "end", printf(F.col("logit"), 6)] if "logit" in rows.columns else [],
        "methylkit": ["chrBase", "chr", "base", "strand", "coverage", F.lpad(printf(F.col("freqC"), 2), 6, " "), F.lpad(printf(F.col("freqT"), 2), 6, " ")] if "freqC" in rows.columns else [],
        "cytosine_report": ["chrom", "pos", "strand", "n_meth", "n_unmeth", "context", "tnc"],
    }[output]
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])
