"""Queries by name over the driver's tables, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import filter_reads
from ..operators.intervals import mappable_reads, overlap_join, reads_in_regions, region_of_positions, run_lengths
from ..operators.pileup import aligned, base_calls, efficiencies, laid, trimmed, with_mates
from ..operators.sites import sites
from ..options import ExtractOptions, ReadOptions
from ..sources import synth
from . import extract as ex
from . import mbias as mb
from . import oracle as sql
from .merge_context import merge_context
from .per_read import per_read as per_read_plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ALL = ("CpG", "CHG", "CHH")
BOUNDS = {"OT": (3, 40, 0, 35), "OB": (0, 0, 6, 60)}
TRIMS = {"OT": (2, 3, 5, 0), "CTOB": (100, 1, 0, 4), "OB": (0, 7, 1, 1)}
REGION = ("chr2", 500, 2503)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reads(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    cores = spark.sparkContext.defaultParallelism
    # a table of one small file would be read, and its reads made, by one task
    return synth.reads(lines if lines.rdd.getNumPartitions() >= cores else lines.repartition(cores), ordered)


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _extract(name: str, options: ExtractOptions, oracle: str, after: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return after(ex.extract(_reads(spark, sf_dir), synth.genome(spark), options))

    run.__name__ = name
    query(oracle)(run)


@query(f"WITH {sql.READS} SELECT read_id, flag, strand FROM stranded")
def strand_of_origin(spark, sf_dir):
    from ..functions.strand import strand_of_origin as f

    return _reads(spark, sf_dir).select("read_id", "flag", f(F.col("flag"), F.col("xg")).alias("strand"))


@query(f"WITH {sql.READS}, {sql.kept()} SELECT read_id, flag, strand FROM kept")
def read_filters(spark, sf_dir):
    return filter_reads(_reads(spark, sf_dir), ReadOptions()).select("read_id", "flag", "strand")


@query(f"WITH {sql.READS}, {sql.kept(0, dupes=True, singleton=True, discordant=True, nh=True)} SELECT read_id, CASE WHEN flag & 9 = 1 THEN flag | 2 ELSE flag END AS flag, strand FROM kept")
def read_filters_keep_all(spark, sf_dir):
    options = ReadOptions(min_mapq=0, keep_dupes=True, keep_singleton=True, keep_discordant=True, ignore_nh=True)
    return filter_reads(_reads(spark, sf_dir), options).select("read_id", "flag", "strand")


@query(f"WITH {sql.READS}, {sql.kept(30, ignore=0x10, require=0x3)} SELECT read_id, flag, strand FROM kept")
def read_filters_flags(spark, sf_dir):
    return filter_reads(_reads(spark, sf_dir), ReadOptions(min_mapq=30, ignore_flags=0x10, require_flags=0x3)).select("read_id", "flag", "strand")


@query(f"WITH {sql.GENOME} SELECT chrom, pos, ref AS base, context FROM ctx")
def genome_context(spark, sf_dir):
    return sites(synth.genome(spark)).select("chrom", "pos", "base", "context")


@query(f"WITH {sql.GENOME} SELECT chrom, pos, tnc FROM ctx")
def trinuc_context(spark, sf_dir):
    return sites(synth.genome(spark)).select("chrom", "pos", "tnc")


def _bases(reads: DataFrame, *more: str) -> DataFrame:
    """Every aligned base of laid reads, with more of their columns."""
    rows = reads.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("on_ref.bases") - 1)))
    return rows.select("read_id", "strand", F.get("on_ref.qpos", F.col("i")).cast("long").alias("qpos"), (F.col("pos") + F.col("i")).alias("ref_pos"), F.substring("on_ref.bases", F.col("i") + 1, F.lit(1)).alias("base"), F.get("on_ref.quals", F.col("i")).alias("qual"), F.col("chrom"), *more).where("base <> '-'")


@query(f"WITH {sql.GENOME}, {sql.READS}, {sql.kept()}, {sql.bases()} SELECT ln % 3 AS kind, count(*) AS n, sum(qpos)::BIGINT AS s_qpos, sum(ref_pos)::BIGINT AS s_ref, sum(qpos * ref_pos)::BIGINT AS s_both, sum(qual)::BIGINT AS s_qual FROM bases GROUP BY ALL")
def cigar_explode(spark, sf_dir):
    # read_id tells the line number only of keys as small as its digits; the CIGAR tells it of all: nM, 10M2I.., 5S..
    kind = F.when(F.size("cigar") == 1, 0).when(F.col("cigar")[0]["op"] == "M", 1).otherwise(2).cast("long")
    reads = filter_reads(_reads(spark, sf_dir), ReadOptions()).withColumn("kind", kind)
    rows = _bases(laid(reads, positions=True), "kind")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("qpos").alias("s_qpos"), F.sum("ref_pos").alias("s_ref"), F.sum(F.col("qpos") * F.col("ref_pos")).alias("s_both"), F.sum("qual").alias("s_qual"))


@query(f"WITH {sql.GENOME}, {sql.READS}, {sql.kept()}, {sql.bases()}, {sql.calls('bases', contexts=repr('CpG') + ',' + repr('CHG') + ',' + repr('CHH'))} SELECT chrom, context, own, call, variant, count(*) AS n FROM (SELECT chrom, context, own, CASE WHEN own THEN call ELSE 0 END AS call, NOT own AND variant AS variant FROM calls) GROUP BY ALL")
def base_call_classify(spark, sf_dir):
    rows = base_calls(_reads(spark, sf_dir), synth.genome(spark), ReadOptions(), ALL, mates=False)
    rows = rows.withColumns({"call": F.coalesce("call", F.lit(0)), "variant": F.coalesce("variant", F.lit(False))})
    return rows.groupBy("chrom", "context", "own", "call", "variant").agg(F.count(F.lit(1)).alias("n"))


def _ranges(given: dict, absolute: bool) -> str:
    """SQL of which read positions are masked."""
    parts = []
    for name, (a, b, c, d) in given.items():
        number = ("OT", "OB", "CTOT", "CTOB").index(name) + 1
        for read, low, high in ((1, a, b), (2, c, d)):
            second = f"flag & 128 = {128 if read == 2 else 0}"
            right = f"i >= n - {high}" if absolute else f"i >= {high}" if high else "FALSE"
            parts.append(f"(strand = {number} AND {second} AND (i < {low} OR {right}))")
    return "(" + " OR ".join(parts) + ")"


_MASKED = "SELECT strand, count(*) AS n, count(*) FILTER (base = 'N') AS n_masked, sum(qual)::BIGINT AS s_qual, sum(CASE WHEN base = 'N' THEN qpos ELSE 0 END)::BIGINT AS s_masked FROM bases GROUP BY strand"


def _masked(spark, sf_dir, options):
    rows = _bases(laid(trimmed(filter_reads(_reads(spark, sf_dir), options), options), positions=True))
    n = F.col("base") == "N"
    return rows.groupBy("strand").agg(F.count(F.lit(1)).alias("n"), F.count_if(n).alias("n_masked"), F.sum("qual").alias("s_qual"), F.sum(F.when(n, F.col("qpos")).otherwise(0)).alias("s_masked"))


@query(f"WITH {sql.GENOME}, {sql.READS}, {sql.kept()}, {sql.bases('kept', _ranges(BOUNDS, False))} {_MASKED}")
def trim_bounds(spark, sf_dir):
    return _masked(spark, sf_dir, ReadOptions(bounds=BOUNDS))


@query(f"WITH {sql.GENOME}, {sql.READS}, {sql.kept()}, {sql.bases('kept', _ranges(TRIMS, True))} {_MASKED}")
def trim_absolute(spark, sf_dir):
    return _masked(spark, sf_dir, ReadOptions(trims=TRIMS))


@query(f"WITH {sql.GENOME}, {sql.READS}, {sql.kept()}, {sql.bases()}, {sql.resolved()} SELECT b.chrom, ref_pos, count(*) AS n, sum(qual)::BIGINT AS s_qual, sum(qual * qpos)::BIGINT AS s_place FROM final b JOIN ctx c ON b.chrom = c.chrom AND b.ref_pos = c.pos GROUP BY ALL")
def mate_overlap_resolve(spark, sf_dir):
    from ..operators.pileup import at_sites
    from ..operators.sites import binned

    ready = with_mates(laid(aligned(filter_reads(_reads(spark, sf_dir), ReadOptions())).drop("mate_chrom", "mate_pos", "xg", "nh"), positions=True))
    rows = at_sites(ready, binned(sites(synth.genome(spark))), True)
    place = F.get("on_ref.qpos", (F.col("site.pos") - F.col("pos")).cast("int"))
    return rows.groupBy("chrom", F.col("site.pos").alias("ref_pos")).agg(F.count(F.lit(1)).alias("n"), F.sum("qual").alias("s_qual"), F.sum(F.col("qual") * place).alias("s_place"))


_LIVE = "WHERE n_meth + n_unmeth > 0"
for _c in ALL:
    _extract(f"extract_{_c.lower()}", ExtractOptions(contexts=(_c,)), f"{sql.counted(repr(_c))} SELECT {sql.ROW}, {sql.PCT}, n_meth, n_unmeth FROM site {_LIVE}")
for _c in ("CpG", "CHG"):
    _extract(f"extract_merge_{_c.lower()}", ExtractOptions(contexts=(_c,), merge_context=True), f'{sql.counted(repr(_c))}{sql.merged()} SELECT chrom, context, start, start + width AS "end", {sql.PCT}, n_meth, n_unmeth FROM m')
_extract("extract_fraction", ExtractOptions(output="fraction"), f"{sql.counted()} SELECT {sql.ROW}, n_meth / (n_meth + n_unmeth) AS fraction FROM site {_LIVE}")
_extract("extract_counts", ExtractOptions(output="counts"), f"{sql.counted()} SELECT {sql.ROW}, n_meth + n_unmeth AS coverage FROM site {_LIVE}")
_extract(
    "extract_logit", ExtractOptions(output="logit"),
    f"{sql.counted()} SELECT {sql.ROW}, CASE WHEN n_meth = 0 THEN '-inf'::DOUBLE WHEN n_unmeth = 0 THEN 'inf'::DOUBLE ELSE round(ln(n_meth / (n_meth + n_unmeth)) - ln(1 - n_meth / (n_meth + n_unmeth)), 9) END AS logit FROM site {_LIVE}",
    lambda x: x.withColumn("logit", F.round("logit", 9)),
)
_extract(
    "extract_methylkit", ExtractOptions(output="methylkit"),
    f"{sql.counted()} SELECT context, chrom || '.' || (pos + 1)::VARCHAR AS chrBase, chrom AS chr, pos + 1 AS base, CASE ref WHEN 'C' THEN 'F' ELSE 'R' END AS strand, n_meth + n_unmeth AS coverage, 100.0::DOUBLE * n_meth / (n_meth + n_unmeth) AS freqC, 100.0::DOUBLE * n_unmeth / (n_meth + n_unmeth) AS freqT FROM site {_LIVE}",
)
_extract("extract_min_depth", ExtractOptions(min_depth=20), f"{sql.counted()} SELECT {sql.ROW}, {sql.PCT}, n_meth, n_unmeth FROM site WHERE n_meth + n_unmeth >= 20")
_ALL3 = "'CpG', 'CHG', 'CHH'"
_REPORT = "SELECT c.chrom, c.pos + 1 AS pos, CASE c.ref WHEN 'C' THEN '+' ELSE '-' END AS strand, coalesce(s.n_meth, 0) AS n_meth, coalesce(s.n_unmeth, 0) AS n_unmeth, CASE c.context WHEN 'CpG' THEN 'CG' ELSE c.context END AS context, c.tnc"
_extract("cytosine_report", ExtractOptions(contexts=ALL, output="cytosine_report"), f"{sql.counted(_ALL3)} {_REPORT} FROM ctx c LEFT JOIN site s USING (chrom, pos)")
_VARIANT = "(n_opposite >= 3 AND n_variant / n_opposite >= 0.2)"
_VARIANTS = {"contexts": ALL, "min_opposite_depth": 3, "max_variant_frac": 0.2}
_extract("variant_filter", ExtractOptions(**_VARIANTS), f"{sql.counted(_ALL3)} SELECT {sql.ROW}, {sql.PCT}, n_meth, n_unmeth FROM site {_LIVE} AND NOT {_VARIANT}")
_MERGE_VARIANT = f""", v AS (SELECT * REPLACE (CASE WHEN bad THEN 0 ELSE n_meth END AS n_meth, CASE WHEN bad THEN 0 ELSE n_unmeth END AS n_unmeth) FROM (SELECT *, {_VARIANT} AS bad FROM site)),
m AS (
    SELECT chrom, context, CASE WHEN context = 'CHH' OR ref = 'C' THEN pos WHEN context = 'CpG' THEN pos - 1 ELSE pos - 2 END AS start,
        CASE context WHEN 'CpG' THEN 2 WHEN 'CHG' THEN 3 ELSE 1 END AS width, sum(n_meth)::BIGINT AS n_meth, sum(n_unmeth)::BIGINT AS n_unmeth, bool_or(bad AND {{}}) AS gone
    FROM v GROUP BY ALL)
SELECT chrom, context, start, start + width AS "end", {sql.PCT}, n_meth, n_unmeth FROM m WHERE NOT gone AND n_meth + n_unmeth > 0"""
_extract("variant_merge", ExtractOptions(**_VARIANTS, merge_context=True), f"{sql.counted(_ALL3)}{_MERGE_VARIANT.format(repr('G') + ' = ref')}")
_extract("variant_merge_either", ExtractOptions(**_VARIANTS, merge_context=True, variant_merge="either"), f"{sql.counted(_ALL3)}{_MERGE_VARIANT.format('TRUE')}")


@query(f"{sql.counted(_ALL3)} SELECT count(*) AS n_excluded FROM site WHERE {_VARIANT}")
def variant_count(spark, sf_dir):
    return ex.variant_count(_reads(spark, sf_dir), synth.genome(spark), ExtractOptions(**_VARIANTS))


_EFFICIENCY = """eff AS (
    SELECT read_id, (count(*) FILTER (call = -1) / nullif(count(*) FILTER (call <> 0), 0))::FLOAT AS e
    FROM (SELECT b.read_id, CASE WHEN b.strand % 2 = 1 THEN CASE b.base WHEN 'C' THEN 1 WHEN 'T' THEN -1 ELSE 0 END ELSE CASE b.base WHEN 'G' THEN 1 WHEN 'A' THEN -1 ELSE 0 END END AS call
          FROM e_bases b JOIN ctx c ON b.chrom = c.chrom AND b.ref_pos = c.pos WHERE b.qual >= 5 AND c.context IN ('CHG', 'CHH')) GROUP BY read_id)"""


@query(f"WITH {sql.GENOME}, {sql.READS}, {sql.kept()}, {sql.bases(name='e_bases')}, {_EFFICIENCY} SELECT read_id, coalesce(e, 1)::FLOAT AS efficiency FROM eff")
def conversion_efficiency(spark, sf_dir):
    return efficiencies(aligned(filter_reads(_reads(spark, sf_dir), ReadOptions())), synth.genome(spark), ReadOptions())


_extract(
    "extract_min_conversion", ExtractOptions(min_conversion_efficiency=0.4),
    f"{sql.counted(before=sql.bases(name='e_bases') + ', ' + _EFFICIENCY + ', passed AS (SELECT k.* FROM kept k LEFT JOIN eff USING (read_id) WHERE coalesce(e, 1) >= 0.4::FLOAT)')} SELECT {sql.ROW}, {sql.PCT}, n_meth, n_unmeth FROM site {_LIVE}",
)


def _regions(spark, sf_dir):
    return synth.regions(_table(spark, sf_dir, "part"))


_IN_REGION = "EXISTS (SELECT 1 FROM regions r WHERE r.chrom = k.chrom AND k.pos < r.\"end\" AND r.start < k.ref_end)"


@query(f"WITH {sql.READS}, {sql.kept()}, {sql.REGIONS} SELECT read_id, chrom, pos FROM kept k WHERE {_IN_REGION}")
def bed_read_semijoin(spark, sf_dir):
    return reads_in_regions(aligned(filter_reads(_reads(spark, sf_dir), ReadOptions())), _regions(spark, sf_dir)).select("read_id", "chrom", "pos")


_REGION_OF = """near AS (
    SELECT c.*, (SELECT arg_min(r.strand, (r.start, r."end", r.strand)) FROM regions r WHERE r.chrom = c.chrom AND c.pos >= r.start AND c.pos < r."end") AS region_strand FROM ctx c)"""


@query(f"WITH {sql.GENOME}, {sql.REGIONS}, {_REGION_OF} SELECT chrom, pos, context, region_strand FROM near WHERE region_strand IS NOT NULL")
def bed_position(spark, sf_dir):
    return region_of_positions(sites(synth.genome(spark)), _regions(spark, sf_dir)).select("chrom", "pos", "context", "region_strand")


@query(
    f"{sql.counted(_ALL3, before=f'{sql.REGIONS}, {_REGION_OF}, passed AS (SELECT * FROM kept k WHERE {_IN_REGION})', more='AND EXISTS (SELECT 1 FROM near x WHERE x.chrom = b.chrom AND x.pos = b.ref_pos AND (x.region_strand = 0 OR (x.region_strand = 1) = (b.strand % 2 = 1)))')}"
    f" SELECT {sql.ROW}, {sql.PCT}, n_meth, n_unmeth FROM site {_LIVE}"
)
def bed_stranded(spark, sf_dir):
    return ex.extract(_reads(spark, sf_dir), synth.genome(spark), ExtractOptions(contexts=ALL, keep_strand=True), _regions(spark, sf_dir))


_END = f"(SELECT {REGION[2]} + CASE WHEN l.base = 'C' AND n2.base = 'G' THEN 2 WHEN n1.base = 'G' THEN 1 ELSE 0 END FROM g l, g n1, g n2 WHERE l.chrom = '{REGION[0]}' AND n1.chrom = l.chrom AND n2.chrom = l.chrom AND l.pos = {REGION[2] - 1} AND n1.pos = {REGION[2]} AND n2.pos = {REGION[2] + 1})"
_NEAR = f"passed AS (SELECT * FROM kept WHERE chrom = '{REGION[0]}' AND ref_end > {REGION[1]} AND pos < {_END})"
_extract("region_extract", ExtractOptions(contexts=("CpG", "CHG"), region=REGION), f"{sql.counted(repr('CpG') + ', ' + repr('CHG'), before=_NEAR)} SELECT {sql.ROW}, {sql.PCT}, n_meth, n_unmeth FROM site {_LIVE} AND chrom = '{REGION[0]}' AND pos >= {REGION[1]} AND pos < {_END}")


@query(f"""WITH {sql.READS}, {sql.kept()}, {sql.TRACK},
    spans AS (SELECT read_id, chrom, 0 AS who, pos AS s, pos + n AS e FROM kept UNION ALL SELECT read_id, chrom, 1, mate_pos, mate_pos + n FROM kept WHERE flag & 1 = 1),
    shared AS (SELECT read_id, who, sum(least(e, "end") - greatest(s, start)) AS b FROM spans JOIN track t ON t.chrom = spans.chrom AND s < "end" AND start < e WHERE value >= 0.5::FLOAT::DOUBLE * 100 GROUP BY ALL)
    SELECT read_id FROM kept WHERE read_id IN (SELECT read_id FROM shared WHERE b >= 15)""")
def mappability_filter(spark, sf_dir):
    reads = aligned(filter_reads(_reads(spark, sf_dir), ReadOptions()))
    return mappable_reads(reads, synth.mappability(_table(spark, sf_dir, "orders")), 0.5, 15).select("read_id")


@query(f"""WITH {sql.TRACK},
    c AS (SELECT *, CASE WHEN lag(v) OVER o IS NOT DISTINCT FROM v AND lag("end") OVER o = start THEN 0 ELSE 1 END AS new FROM (SELECT chrom, start, "end", value // 40 AS v FROM track) WINDOW o AS (PARTITION BY chrom ORDER BY start)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start) AS island FROM c),
    r AS (SELECT chrom, min(start) AS s, max("end") AS e, any_value(v) AS value FROM i GROUP BY chrom, island)
    SELECT chrom, cut AS start, least(e, cut + 70) AS "end", value FROM (SELECT *, unnest(range(s, e, 70)) AS cut FROM r)""")
def rle_encode(spark, sf_dir):
    track = synth.mappability(_table(spark, sf_dir, "orders")).withColumn("value", F.expr("value div 40").cast("int"))
    return run_lengths(track, 70)


@query(f"""WITH {sql.READS}, {sql.kept()}, {sql.TRACK} SELECT read_id, count(*) AS n, sum(least(ref_end, "end") - greatest(pos, start))::BIGINT AS bases FROM kept JOIN track t ON t.chrom = kept.chrom AND pos < "end" AND start < ref_end GROUP BY read_id""")
def interval_overlap(spark, sf_dir):
    reads = aligned(filter_reads(_reads(spark, sf_dir), ReadOptions())).select("read_id", "chrom", "pos", "ref_end")
    track = synth.mappability(_table(spark, sf_dir, "orders")).select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    rows = overlap_join(reads, track, "pos", "ref_end")
    return rows.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("ref_end", "r_end") - F.greatest("pos", "r_start")).alias("bases"))


def _bias(spark, sf_dir, options=ReadOptions()):
    return mb.mbias(_reads(spark, sf_dir), synth.genome(spark), options)


@query(f"{sql.bias()} SELECT strand, read, position, n_meth, n_unmeth FROM bias")
def mbias_counts(spark, sf_dir):
    return _bias(spark, sf_dir)


@query(f"{sql.bias(_ranges(TRIMS, True))} SELECT strand, read, position, n_meth, n_unmeth FROM bias")
def mbias_trimmed(spark, sf_dir):
    return _bias(spark, sf_dir, ReadOptions(trims=TRIMS))


@query(f"{sql.bias()} SELECT strand, read, position, round(fraction, 9) AS fraction, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM ci")
def mbias_ci(spark, sf_dir):
    rows = mb.with_intervals(_bias(spark, sf_dir))
    return rows.select("strand", "read", "position", *[F.round(c, 9).alias(c) for c in ("fraction", "ci_low", "ci_high")])


@query(f"""{sql.bias()}, l AS (SELECT strand, max(position) AS n FROM bias GROUP BY strand),
    x AS (SELECT ci.*, l.n, position - 1 AS idx FROM ci JOIN l USING (strand)),
    i AS (SELECT strand, read, avg(fraction) AS mean, min(ci_high) AS min_ci, max(ci_low) AS max_ci FROM x WHERE idx >= floor(n * 0.2::DOUBLE) AND idx <= floor(n * 0.8::DOUBLE) GROUP BY ALL),
    d AS (SELECT x.*, abs(fraction - mean) > 0.05 AND ((ci_high < mean AND fraction < min_ci) OR (ci_low > mean AND fraction > max_ci)) AS far FROM x LEFT JOIN i USING (strand, read))
    SELECT strand, read, coalesce(max(idx + 2) FILTER (far AND idx <= n // 2), 0)::BIGINT AS "left", coalesce(min(idx) FILTER (far AND idx > n // 2), 0)::BIGINT AS "right" FROM d GROUP BY strand, read""")
def mbias_thresholds(spark, sf_dir):
    return mb.thresholds(_bias(spark, sf_dir))


@query(f"""{sql.counted(_ALL3)}{sql.merged()} SELECT chrom, start, start + width AS "end", {sql.PCT}, n_meth, n_unmeth FROM m""")
def merge_context_bedgraph(spark, sf_dir):
    genome = synth.genome(spark)
    single = ex.extract(_reads(spark, sf_dir), genome, ExtractOptions(contexts=ALL))
    return merge_context(single.select("chrom", "start", "end", "pct", "n_meth", "n_unmeth"), genome)


@query(f"""WITH {sql.GENOME}, {sql.READS}, picked AS (SELECT * FROM stranded WHERE mapq >= 10), {sql.bases('picked')}, {sql.calls('bases')},
    s AS (SELECT read_id, count(*) FILTER (call = 1) AS m, count(*) AS k FROM calls WHERE own AND call <> 0 GROUP BY read_id)
    SELECT p.read_id, p.qname, p.chrom, p.pos, coalesce(100.0::DOUBLE * m / k, 0) AS pct, coalesce(k, 0) AS n_informative FROM picked p LEFT JOIN s USING (read_id)""")
def per_read(spark, sf_dir):
    return per_read_plan(_reads(spark, sf_dir), synth.genome(spark))



@query(f"""WITH {sql.GENOME}, {sql.READS}, picked AS (SELECT * FROM stranded WHERE mapq >= 10), {sql.bases('picked')},
    steps AS (SELECT *, coalesce(qual < 5 AND lag(qual) OVER o < 5 AND lag(ref_pos) OVER o = ref_pos - 1, FALSE) AS goes_on FROM bases WINDOW o AS (PARTITION BY read_id ORDER BY ref_pos)),
    runs AS (SELECT *, max(CASE WHEN NOT goes_on THEN nth END) OVER o AS began FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY ref_pos) AS nth FROM steps) WINDOW o AS (PARTITION BY read_id ORDER BY ref_pos)),
    judged AS (SELECT * REPLACE (99 AS qual) FROM runs WHERE qual >= 5 OR (nth - began) % 2 = 1), {sql.calls('judged')},
    s AS (SELECT read_id, count(*) FILTER (call = 1) AS m, count(*) AS k FROM calls WHERE own AND call <> 0 GROUP BY read_id)
    SELECT p.read_id, p.qname, p.chrom, p.pos, coalesce(100.0::DOUBLE * m / k, 0) AS pct, coalesce(k, 0) AS n_informative FROM picked p LEFT JOIN s USING (read_id)""")
def per_read_sequential(spark, sf_dir):
    return per_read_plan(_reads(spark, sf_dir), synth.genome(spark), quality_rule="sequential")
