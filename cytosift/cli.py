"""Command line: extract, mbias, perRead, mergeContext, bigWig conversion. Files in, files out.

    python -m cytosift.cli extract genome.fa alignments.bam -o prefix
"""

from __future__ import annotations

import argparse
import sys

from .functions.strand import STRANDS
from .options import ExtractOptions, ReadOptions, bounds, flags, region


def _reads(p: argparse.ArgumentParser, per_read: bool = False, files: str | None = None) -> None:
    p.add_argument("genome", nargs=files, help="FASTA")
    p.add_argument("alignments", nargs=files, help="BAM, or a Parquet folder of the reads schema")
    p.add_argument("-q", type=int, default=10, dest="min_mapq")
    p.add_argument("-p", type=int, default=5, dest="min_phred")
    p.add_argument("-r", type=region, dest="region")
    p.add_argument("-l", dest="bed")
    p.add_argument("--keepStrand", action="store_true", dest="keep_strand")
    p.add_argument("-F", "--ignoreFlags", type=flags, default=0 if per_read else 0xF00, dest="ignore_flags")
    p.add_argument("-R", "--requireFlags", type=flags, default=0, dest="require_flags")
    p.add_argument("--ignoreNH", action="store_true", dest="ignore_nh")
    # accepted, as Spark decides these
    p.add_argument("-@", type=int, default=1, dest="threads", help=argparse.SUPPRESS)
    p.add_argument("--chunkSize", type=int, default=1_000_000, help=argparse.SUPPRESS)
    p.add_argument("-D", type=int, dest="max_depth", help=argparse.SUPPRESS)
    if not per_read:
        for name in ("keepDupes", "keepSingleton", "keepDiscordant"):
            p.add_argument(f"--{name}", action="store_true", dest={"keepDupes": "keep_dupes", "keepSingleton": "keep_singleton", "keepDiscordant": "keep_discordant"}[name])
        p.add_argument("--minConversionEfficiency", type=float, default=0.0, dest="min_conversion_efficiency")
        p.add_argument("--noCpG", action="store_true")
        p.add_argument("--CHG", action="store_true")
        p.add_argument("--CHH", action="store_true")
        for name in STRANDS:
            p.add_argument(f"--n{name}", type=bounds)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cytosift", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("extract", help="methylation of each cytosine")
    _reads(p, files="?")
    for name in STRANDS:
        p.add_argument(f"--{name}", type=bounds)
    p.add_argument("-o", dest="prefix")
    p.add_argument("-d", "--minDepth", type=int, default=1, dest="min_depth")
    p.add_argument("--mergeContext", action="store_true", dest="merge_context")
    kinds = p.add_mutually_exclusive_group()
    for name, value in (("fraction", "fraction"), ("counts", "counts"), ("logit", "logit"), ("methylKit", "methylkit"), ("cytosine_report", "cytosine_report")):
        kinds.add_argument(f"--{name}", action="store_const", const=value, dest="output", default="bedgraph")
    p.add_argument("--minOppositeDepth", type=int, default=0, dest="min_opposite_depth")
    p.add_argument("--maxVariantFrac", type=float, default=0.0, dest="max_variant_frac")
    p.add_argument("--variantMerge", choices=("reference", "either"), default="reference", dest="variant_merge")
    p.add_argument("-M", "--mappability", help="bigWig")
    p.add_argument("-B", "--mappabilityBBM", dest="bbm")
    p.add_argument("-O", "--outputBBMFile", action="store_true", dest="write_bbm", help="write the bigWig as BBM, named like it; without genome and alignments that is all")
    p.add_argument("-N", "--outputBBMFileName", dest="bbm_name", help="the same, by this name, without .bbm")
    p.add_argument("-t", "--mappabilityThreshold", type=float, default=0.01, dest="mappability_cutoff")
    p.add_argument("-b", "--minMappableBases", type=int, default=15, dest="min_mappable_bases")
    p = sub.add_parser("mbias", help="methylation by place in the read")
    _reads(p)
    p.add_argument("prefix", nargs="?")
    p.add_argument("--txt", action="store_true")
    p.add_argument("--noSVG", action="store_true")
    p = sub.add_parser("perRead", help="methylation of each read")
    _reads(p, True)
    p.add_argument("-o", dest="out", help="standard output if not given")
    p = sub.add_parser("mergeContext", help="a bedGraph of cytosines to one of CpGs and CHGs")
    p.add_argument("genome")
    p.add_argument("bedgraph")
    p.add_argument("-o", dest="out", help="standard output if not given")
    p = sub.add_parser("bigWigToBBM", help="a mappability bigWig as BBM")
    p.add_argument("bigwig")
    p.add_argument("-N", dest="out", required=True, help="name, without .bbm")
    return top


def _options(a: argparse.Namespace, kind: type) -> ReadOptions:
    names = [f for f in kind.__dataclass_fields__ if hasattr(a, f)]
    given = {f: getattr(a, f) for f in names}
    given["trims"] = {k: v for k in STRANDS if (v := getattr(a, f"n{k}", None))}
    given["bounds"] = {k: v for k in STRANDS if (v := getattr(a, k, None))}
    if kind is ExtractOptions:
        given["contexts"] = contexts(a)
    return kind(**given)


def contexts(a: argparse.Namespace) -> tuple[str, ...]:
    return tuple(k for k, keep in (("CpG", not a.noCpG), ("CHG", a.CHG), ("CHH", a.CHH)) if keep)


def default_prefix(path: str) -> str:
    """The path without its last extension."""
    stem, dot, end = path.rpartition(".")
    return stem if dot and "/" not in end else path


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    try:
        options = _options(a, ExtractOptions if a.command == "extract" else ReadOptions) if a.command in ("extract", "mbias") else None
    except ValueError as e:
        parser().error(str(e))
    bbm_wanted = a.command == "extract" and (a.write_bbm or a.bbm_name)
    if bbm_wanted and not a.mappability:
        parser().error("a BBM file is written from a bigWig: give -M")
    if a.command == "extract" and not bbm_wanted and not a.alignments:
        parser().error("extract takes a genome and alignments")
    if (getattr(a, "alignments", None) or "").endswith(".cram"):
        parser().error("CRAM is not read; convert it to BAM")
    from pyspark.sql import SparkSession

    from .plans import extract as ex
    from .plans import mbias as mb
    from .plans.merge_context import merge_context
    from .plans.per_read import per_read
    from .sources import bam, fasta, tables, tracks, writers

    spark = spark or SparkSession.builder.appName("cytosift").getOrCreate()
    if a.command == "bigWigToBBM":
        tracks.bigwig_to_bbm(spark, a.bigwig, f"{a.out}.bbm")
        return 0
    if bbm_wanted:
        tracks.bigwig_to_bbm(spark, a.mappability, f"{a.bbm_name or default_prefix(a.mappability)}.bbm")
        if not a.alignments:
            return 0
    genome = fasta.read_fasta(spark, a.genome)
    if a.command == "mergeContext":
        writers.write_merged(merge_context(tables.read_bedgraph(spark, a.bedgraph), genome), genome, a.out)
        return 0
    reads = bam.read_bam(spark, a.alignments) if a.alignments.endswith(".bam") else spark.read.parquet(a.alignments)
    missing = reads.select("chrom").distinct().where("chrom IS NOT NULL").join(genome.select("chrom").distinct(), "chrom", "left_anti").first()
    if missing:
        raise ValueError(f"the genome has no {missing.chrom}")
    regions = tables.read_bed(spark, a.bed, a.keep_strand, genome) if a.bed else None
    prefix = getattr(a, "prefix", None) or default_prefix(a.alignments)
    if a.command == "perRead":
        rows = per_read(reads, genome, a.min_mapq, a.min_phred, a.ignore_flags, a.require_flags, a.region, regions)
        writers.write_per_read(rows, genome, a.out)
    elif a.command == "extract":
        track = tracks.read_bbm(spark, a.bbm) if a.bbm else tracks.as_mappability(tracks.read_bigwig(spark, a.mappability)) if a.mappability else None
        if a.min_opposite_depth > 0:
            print(ex.variant_count(reads, genome, options, regions, track).first().n_excluded, "sites were excluded as variants")
        writers.write_extract(ex.extract(reads, genome, options, regions, track), genome, prefix, options.output, options.contexts, options.merge_context)
    else:
        rows = mb.mbias(reads, genome, options, contexts(a), regions).cache()
        print("Suggested inclusion options:", *mb.suggested(rows), file=sys.stderr)
        if a.txt or a.noSVG:
            print(writers.MBIAS_HEADER)
            for r in writers.mbias_lines(rows).collect():  # a row for each strand, read and place
                print(r.value)
        if not a.noSVG:
            write_svg(rows, prefix, "/".join(contexts(a)))
        rows.unpersist()
    return 0


def write_svg(rows, prefix: str, what: str) -> list[str]:
    """One plot for each strand that has data."""
    from . import svg
    from .plans import mbias as mb
    from .sources.files import create

    points: dict[str, list[svg.Point]] = {}
    for r in mb.with_intervals(rows).collect():
        points.setdefault(r.strand, []).append(svg.Point(r.read, r.position, r.fraction, r.ci_low, r.ci_high))
    limits: dict[str, dict[int, tuple[int, int]]] = {}
    for r in mb.thresholds(rows).collect():
        limits.setdefault(r.strand, {})[r.read] = (r.left, r.right)
    paths = []
    for strand, own in points.items():
        paths.append(f"{prefix}_{strand}.svg")
        with create(paths[-1]) as out:
            out.write(svg.plot(own, f"{strand} strand, {what}", limits.get(strand)).encode())
    return paths


if __name__ == "__main__":
    sys.exit(main())
