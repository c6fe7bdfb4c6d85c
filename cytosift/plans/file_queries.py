"""Queries that write files by the sinks and read them back by the sources, and the SQL for what they must then hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import ExtractOptions
from ..sources import bam, fasta, synth, tables, tracks, writers
from ..sources.files import create, scratch
from . import extract as ex
from . import mbias as mb
from . import oracle as sql
from .merge_context import merge_context
from .per_read import per_read
from .registry import ALL, ORACLE_SQL, _reads, _table, query

_ALL3 = ", ".join(map(repr, ALL))


def _written(spark: SparkSession, sf_dir: str, options: ExtractOptions) -> list[str]:
    """The files of `extract`."""
    genome = synth.genome(spark)
    prefix = scratch(spark, "extract") + "/out"
    return writers.write_extract(ex.extract(_reads(spark, sf_dir), genome, options), genome, prefix, options.output, options.contexts, options.merge_context)


def _tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema, sep="\t", header=header)


def _tracks(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    return [(c, tables.read_bedgraph(spark, path)) for c, path in zip(ALL, _written(spark, sf_dir, ExtractOptions(contexts=ALL)), strict=True)]


@query(f"{sql.counted(_ALL3)} SELECT {sql.ROW}, {sql.PCT}, n_meth, n_unmeth FROM site WHERE n_meth + n_unmeth > 0")
def file_bedgraph(spark, sf_dir):
    found = [rows.withColumn("context", F.lit(c)) for c, rows in _tracks(spark, sf_dir)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(ORACLE_SQL["merge_context_bedgraph"])
def file_merged_bedgraph(spark, sf_dir):
    genome = synth.genome(spark)
    (_, a), (_, b), (_, c) = _tracks(spark, sf_dir)
    path = scratch(spark, "merged") + "/out.bedGraph"
    writers.write_merged(merge_context(a.unionByName(b).unionByName(c), genome), genome, path)
    return tables.read_bedgraph(spark, path, genome)


#: By output: its SQL, column and type.
_VALUES = {
    "fraction": ("printf('%.6f', n_meth / (n_meth + n_unmeth))::DOUBLE", "fraction", "double"),
    "counts": ("n_meth + n_unmeth", "coverage", "long"),
    "logit": ("CASE WHEN n_meth = 0 THEN '-inf'::DOUBLE WHEN n_unmeth = 0 THEN 'inf'::DOUBLE ELSE printf('%.6f', ln(n_meth / (n_meth + n_unmeth)) - ln(1 - n_meth / (n_meth + n_unmeth)))::DOUBLE END", "logit", "double"),
}


def _values(output: str, oracle: str, column: str, kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        (path,) = _written(spark, sf_dir, ExtractOptions(output=output))
        # a cast, unlike the CSV reader, knows `inf`
        return _tsv(spark, path, f"chrom string, start long, end long, {column} string", True).withColumn(column, F.col(column).cast(kind))

    run.__name__ = f"file_{output}"
    query(f'{sql.counted()} SELECT chrom, pos AS start, pos + 1 AS "end", {oracle} AS {column} FROM site WHERE n_meth + n_unmeth > 0')(run)


for _output, _given in _VALUES.items():
    _values(_output, *_given)


@query(f"""{sql.counted()} SELECT chrom || '.' || (pos + 1)::VARCHAR AS chrBase, chrom AS chr, pos + 1 AS base, CASE ref WHEN 'C' THEN 'F' ELSE 'R' END AS strand, n_meth + n_unmeth AS coverage,
    printf('%.2f', 100.0::DOUBLE * n_meth / (n_meth + n_unmeth))::DOUBLE AS freqC, printf('%.2f', 100.0::DOUBLE * n_unmeth / (n_meth + n_unmeth))::DOUBLE AS freqT FROM site WHERE n_meth + n_unmeth > 0""")
def file_methylkit(spark, sf_dir):
    (path,) = _written(spark, sf_dir, ExtractOptions(output="methylkit"))
    fields = [F.trim(F.split("value", "\t")[i]).cast(kind).alias(name) for i, (name, kind) in enumerate((x.split() for x in ("chrBase string", "chr string", "base long", "strand string", "coverage long", "freqC double", "freqT double")))]
    return spark.read.text(path).where(F.col("value") != writers.METHYLKIT_HEADER).select(*fields)


@query(ORACLE_SQL["cytosine_report"])
def file_cytosine_report(spark, sf_dir):
    (path,) = _written(spark, sf_dir, ExtractOptions(contexts=ALL, output="cytosine_report"))
    return _tsv(spark, path, "chrom string, pos long, strand string, n_meth long, n_unmeth long, context string, tnc string")


@query(f"SELECT qname, chrom, pos, printf('%.6f', pct)::DOUBLE AS pct, n_informative FROM ({ORACLE_SQL['per_read']})")
def file_per_read(spark, sf_dir):
    genome = synth.genome(spark)
    path = scratch(spark, "per-read") + "/out.tsv"
    writers.write_per_read(per_read(_reads(spark, sf_dir), genome), genome, path)
    return _tsv(spark, path, "qname string, chrom string, pos long, pct double, n_informative long")


@query(ORACLE_SQL["mbias_counts"])
def file_mbias(spark, sf_dir):
    path = scratch(spark, "mbias") + "/out.tsv"
    writers.write_mbias(mb.mbias(_reads(spark, sf_dir), synth.genome(spark)), path)
    return _tsv(spark, path, "strand string, read int, position long, n_meth long, n_unmeth long", True)


@query(f'WITH {sql.REGIONS} SELECT chrom, start, least("end", {synth.LENGTH + 1}) AS "end", strand::TINYINT AS strand FROM regions')
def file_bed(spark, sf_dir):
    path = scratch(spark, "bed") + "/regions"
    sign = F.element_at(F.array(F.lit("."), F.lit("+"), F.lit("-")), F.col("strand") + 1)
    rows = synth.regions(_table(spark, sf_dir, "part"))
    rows.select(F.concat_ws("\t", "chrom", "start", "end", F.lit("."), F.lit(0), sign).alias("value")).write.option("compression", "gzip").text(path)
    return tables.read_bed(spark, path, True, synth.genome(spark))


@query(f"""WITH {sql.TRACK}, cells AS (SELECT 'chr' || (c + 1)::VARCHAR AS chrom, r * 50 AS start, r * 50 + 50 AS "end" FROM range({synth.CONTIGS}) a(c), range({synth.LENGTH // 50}) b(r)),
    filled AS (SELECT c.chrom, c.start, c."end", coalesce(t.value, 0) AS value FROM cells c LEFT JOIN track t ON t.chrom = c.chrom AND t.start = c.start),
    marked AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY chrom ORDER BY start) = value THEN 0 ELSE 1 END AS new FROM filled),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start) AS island FROM marked)
    SELECT chrom, min(start) AS start, max("end") AS "end", any_value(value)::INT AS value FROM islands GROUP BY chrom, island""")
def file_bbm(spark, sf_dir):
    path = scratch(spark, "track") + "/out.bbm"
    known = synth.genome(spark).select("tid", "chrom", "length").distinct()
    tracks.write_bbm(synth.mappability(_table(spark, sf_dir, "orders")), known, path, 1024)
    return tracks.read_bbm(spark, path)


@query(ORACLE_SQL["extract_merge_cpg"])
def file_bam(spark, sf_dir):
    """Every field of a read decides here: flags, tags, mates, CIGAR, bases and qualities, and its place in the file where mates begin at one position.
    So the file is in the order of positions, then of read_id."""
    path, genome = scratch(spark, "reads") + "/reads.bam", synth.genome(spark)
    bam.write_bam(_reads(spark, sf_dir, ordered=True), genome, path)
    return ex.extract(bam.read_bam(spark, path, 1 << 20), genome, ExtractOptions(contexts=("CpG",), merge_context=True))


@query(ORACLE_SQL["trinuc_context"].replace("SELECT chrom, pos, tnc", "SELECT chrom, pos, tnc, context"))
def file_fasta(spark, sf_dir):
    from ..operators.sites import MARGIN, sites

    path = scratch(spark, "genome") + "/genome.fa"
    body = F.lower(F.substring("seq", F.lit(MARGIN + 1), F.length("seq") - 2 * MARGIN))
    with create(path) as out:
        for r in synth.genome(spark).select("chrom", "start", body.alias("body")).orderBy("tid", "start").toLocalIterator():
            out.write((f">{r.chrom} made\n" if r.start == 0 else "").encode() + r.body.encode() + b"\n")
    return sites(fasta.read_fasta(spark, path, 700)).select("chrom", "pos", "tnc", "context")
