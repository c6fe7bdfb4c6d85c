"""SQL that the queries are checked against: the same questions asked base by base, without any of the engine's shortcuts."""

from __future__ import annotations

from ..functions.calls import Z, Z2
from ..sources import synth

_G = synth.BASE.format(p="pos", t="tid", div="//")

GENOME = f"""g AS (
    SELECT tid, 'chr' || (tid + 1)::VARCHAR AS chrom, pos, {_G} AS base
    FROM range({synth.CONTIGS}) a(tid), range({synth.LENGTH}) b(pos)),
w AS (
    SELECT *, lag(base, 2) OVER o AS b2, lag(base) OVER o AS b1, lead(base) OVER o AS a1, lead(base, 2) OVER o AS a2
    FROM g WINDOW o AS (PARTITION BY chrom ORDER BY pos)),
ctx AS (
    SELECT tid, chrom, pos, base AS ref,
        CASE WHEN (base = 'C' AND a1 = 'G') OR (base = 'G' AND b1 = 'C') THEN 'CpG'
             WHEN (base = 'C' AND a2 = 'G') OR (base = 'G' AND b2 = 'C') THEN 'CHG' ELSE 'CHH' END AS context,
        CASE WHEN base = 'C' THEN 'C' || coalesce(a1, 'N') || coalesce(a2, 'N')
             ELSE 'C' || coalesce(translate(b1, 'ACGT', 'TGCA'), 'N') || coalesce(translate(b2, 'ACGT', 'TGCA'), 'N') END AS tnc
    FROM w WHERE base IN ('C', 'G'))"""

READS = f"""k AS (SELECT {", ".join(f"{v} AS {n}" for n, v in synth.READ.items())} FROM lineitem),
k2 AS (SELECT *, {synth.POS} AS pos, o % 5 AS tid FROM k),
reads AS (
    SELECT *, ((o*8 + ln)*200003 + pk)*10007 + sk AS read_id, o::VARCHAR AS qname, ({synth.FLAG})::INT AS flag, 'chr' || (tid + 1)::VARCHAR AS chrom,
        (pk % 60)::INT AS mapq, (pos + 20) % 3910 AS mate_pos, {synth.XG} AS xg, {synth.NH} AS nh, pos + CASE WHEN ln % 3 = 0 THEN n ELSE n - 2 END AS ref_end
    FROM k2),
stranded AS (
    SELECT *, CASE
        WHEN substr(xg, 1, 1) = 'C' THEN CASE WHEN flag & 65 = 65 THEN CASE WHEN flag & 16 = 0 THEN 1 ELSE 3 END WHEN flag & 129 = 129 THEN CASE WHEN flag & 16 = 0 THEN 3 ELSE 1 END WHEN flag & 16 = 16 THEN 3 ELSE 1 END
        WHEN substr(xg, 1, 1) = 'G' THEN CASE WHEN flag & 65 = 65 THEN CASE WHEN flag & 16 = 0 THEN 4 ELSE 2 END WHEN flag & 129 = 129 THEN CASE WHEN flag & 16 = 0 THEN 2 ELSE 4 END WHEN flag & 16 = 16 THEN 2 ELSE 4 END
        WHEN flag & 1 = 1 THEN CASE WHEN flag & 80 = 80 THEN 2 WHEN flag & 64 = 64 THEN 1 WHEN flag & 144 = 144 THEN 1 WHEN flag & 128 = 128 THEN 2 ELSE 0 END
        WHEN flag & 16 = 16 THEN 2 ELSE 1 END AS strand
    FROM reads)"""


def kept(mapq: int = 10, ignore: int = 0xF00, require: int = 0, dupes: bool = False, singleton: bool = False, discordant: bool = False, nh: bool = False, more: str = "") -> str:
    keep = [f"flag & 4 = 0 AND mapq >= {mapq} AND flag & {ignore & ~1024 if dupes else ignore} = 0 AND flag & {require} = {require}"]
    keep += [] if dupes else ["flag & 1024 = 0"]
    keep += [] if nh else ["coalesce(nh, 1) <= 1"]
    keep += [] if singleton else ["flag & 9 <> 9"]
    keep += [] if discordant else ["flag & 3 <> 1"]
    return f"kept AS (SELECT * FROM stranded WHERE {' AND '.join(keep)} AND strand > 0 {more})"


_H = "h"
_AT = synth.BASE.format(p="(pos + i)", t="tid", div="//")


def bases(source: str = "kept", mask: str = "FALSE", name: str = "bases") -> str:
    """(read x aligned base) of the reads; masked ones have base N and quality 0."""
    return f"""{name}_i AS (SELECT *, unnest(range(n)) AS i FROM {source}),
{name}_h AS (SELECT *, {synth.HASH.format(i="i")} AS h, {_AT} AS gb, ({synth.QUAL.format(i="i")})::INT AS q0 FROM {name}_i),
{name}_m AS (SELECT *, {synth.LETTER.format(h="h", g="gb")} AS letter FROM {name}_h),
{name} AS (
    SELECT * EXCLUDE (h, gb, q0, letter), i AS qpos, CASE WHEN {mask} THEN 'N' ELSE letter END AS base, CASE WHEN {mask} THEN 0 ELSE q0 END AS qual,
        CASE WHEN ln % 3 = 0 THEN pos + i WHEN ln % 3 = 1 THEN CASE WHEN i < 10 THEN pos + i WHEN i >= 12 THEN pos + i - 2 END ELSE CASE WHEN i BETWEEN 5 AND 14 THEN pos + i - 5 WHEN i >= 15 THEN pos + i - 2 END END AS ref_pos
    FROM {name}_m WHERE ref_pos IS NOT NULL)"""


def resolved(source: str = "kept", name: str = "bases") -> str:
    """Bases with the quality that mates leave: reads of a name come and go in order, two that come with nothing in between are a pair, and both mates' bases at a place are compared."""
    return f"""may AS (SELECT * FROM {source} WHERE flag & 1 = 1 AND flag & 12 = 0),
events AS (SELECT chrom, qname, read_id, pos AS place, 1 AS comes FROM may UNION ALL SELECT chrom, qname, read_id, ref_end, 0 FROM may),
counted_ AS (SELECT *, row_number() OVER o AS k FROM events WINDOW o AS (PARTITION BY chrom, qname ORDER BY place, comes, read_id)),
since AS (SELECT *, coalesce(max(CASE WHEN comes = 0 THEN k END) OVER (PARTITION BY chrom, qname ORDER BY k), 0) AS gone FROM counted_),
pairs AS (SELECT read_id, gone * 1000000 + (k - gone - 1) // 2 AS pair, (k - gone) % 2 AS first FROM since WHERE comes = 1),
both_ AS (SELECT b.*, p.pair, p.first FROM {name} b JOIN pairs p USING (read_id)),
final AS (
    SELECT b.* REPLACE (CASE
        WHEN m.read_id IS NULL OR b.strand % 2 <> m.strand % 2 THEN b.qual
        WHEN b.base <> m.base THEN CASE WHEN b.qual > m.qual AND b.base <> 'N' THEN b.qual - m.qual ELSE 0 END
        WHEN p.first = 1 THEN CASE WHEN b.qual > m.qual THEN b.qual * 6 // 5 ELSE 0 END
        ELSE CASE WHEN m.qual > b.qual THEN 0 ELSE b.qual * 6 // 5 END END AS qual)
    FROM {name} b LEFT JOIN pairs p USING (read_id)
    LEFT JOIN both_ m ON m.chrom = b.chrom AND m.qname = b.qname AND m.pair = p.pair AND m.ref_pos = b.ref_pos AND m.read_id <> b.read_id)"""


def calls(source: str = "final", phred: int = 5, contexts: str = "'CpG'", more: str = "") -> str:
    return f"""calls AS (
    SELECT b.*, c.ref, c.context, c.tnc, (b.strand % 2 = 1) = (c.ref = 'C') AS own,
        CASE WHEN b.strand % 2 = 1 THEN CASE b.base WHEN 'C' THEN 1 WHEN 'T' THEN -1 ELSE 0 END ELSE CASE b.base WHEN 'G' THEN 1 WHEN 'A' THEN -1 ELSE 0 END END AS call,
        CASE WHEN b.strand % 2 = 1 THEN b.base NOT IN ('G', 'N') ELSE b.base NOT IN ('C', 'N') END AS variant
    FROM {source} b JOIN ctx c ON b.chrom = c.chrom AND b.ref_pos = c.pos WHERE b.qual >= {phred} AND c.context IN ({contexts}) {more})"""


SITE = """site AS (
    SELECT chrom, ref_pos AS pos, ref, context, tnc, count(*) FILTER (own AND call = 1) AS n_meth, count(*) FILTER (own AND call = -1) AS n_unmeth,
        count(*) FILTER (NOT own) AS n_opposite, count(*) FILTER (NOT own AND variant) AS n_variant
    FROM calls GROUP BY ALL)"""


def counted(contexts: str = "'CpG'", phred: int = 5, keep: str | None = None, mask: str = "FALSE", more: str = "", before: str = "") -> str:
    """All that stands before a query over `site`."""
    parts = [GENOME, READS, keep or kept(), *([before] if before else []), bases("passed" if before else "kept", mask), resolved("passed" if before else "kept"), calls("final", phred, contexts, more), SITE]
    return "WITH " + ",\n".join(parts)


ROW = 'chrom, context, pos AS start, pos + 1 AS "end"'
PCT = "(100 * n_meth // (n_meth + n_unmeth))::INT AS pct"


def merged(live: str = "n_meth + n_unmeth > 0") -> str:
    return f""", m AS (
    SELECT chrom, context, CASE WHEN context = 'CHH' OR ref = 'C' THEN pos WHEN context = 'CpG' THEN pos - 1 ELSE pos - 2 END AS start,
        CASE context WHEN 'CpG' THEN 2 WHEN 'CHG' THEN 3 ELSE 1 END AS width, sum(n_meth)::BIGINT AS n_meth, sum(n_unmeth)::BIGINT AS n_unmeth
    FROM site WHERE {live} GROUP BY ALL)"""


REGIONS = "regions AS (SELECT " + ", ".join(x.format(text="VARCHAR") for x in synth.REGION) + " FROM part)"
TRACK = f"""track AS (
    SELECT 'chr' || (o_orderkey % 5 + 1)::VARCHAR AS chrom, ((o_orderkey // 5) % {synth.LENGTH // 50}) * 50 AS start, start + 50 AS "end", (sum(o_custkey % 101) % 101)::INT AS value
    FROM orders GROUP BY ALL)"""


def bias(mask: str = "FALSE") -> str:
    return "WITH " + ",\n".join([GENOME, READS, kept(), bases("kept", mask), calls("bases")]) + """,
bias AS (
    SELECT CASE strand WHEN 1 THEN 'OT' WHEN 2 THEN 'OB' WHEN 3 THEN 'CTOT' ELSE 'CTOB' END AS strand, CASE WHEN flag & 128 = 128 THEN 2 ELSE 1 END AS read, qpos + 1 AS position,
        count(*) FILTER (call = 1) AS n_meth, count(*) FILTER (call = -1) AS n_unmeth
    FROM calls WHERE own AND call <> 0 GROUP BY ALL),
ci AS (
    SELECT *, n_meth / (n_meth + n_unmeth) AS fraction, n_meth + n_unmeth + """ + f"{Z2} AS nn, (n_meth + {Z2} / 2) / nn AS pp, {Z} * sqrt(pp * (1 - pp) / nn) AS half, greatest(0.0, pp - half) AS ci_low, least(1.0, pp + half) AS ci_high FROM bias)"
