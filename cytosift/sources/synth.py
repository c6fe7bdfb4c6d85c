"""Alignments, a genome and tracks made from the driver's tables by integer arithmetic, so that SQL can make the same.

Reads are rows of lineitem, regions of part, mappability of orders; the genome is a closed form. The letters of reads are made in
Arrow batches, as a file reader would make them; LETTER and QUAL state the same rule for SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTIGS, LENGTH, CHUNK = 5, 4000, 500
#: The same for Spark and DuckDB; {p} is a position, {t} a contig number, {div} whole division.
BASE = "substr('ACGT', CAST(1 + (({p}*{p}*7 + {p}*31 + ({p} {div} 3)*({p} {div} 7)*5 + {t}*13) % 101) % 4 AS INT), 1)"
READ = {
    "o": "CAST(l_orderkey AS BIGINT)", "ln": "CAST(l_linenumber AS BIGINT)", "pk": "CAST(l_partkey AS BIGINT)", "sk": "CAST(l_suppkey AS BIGINT)", "n": "30 + CAST(l_quantity AS BIGINT)",
}
POS = "(o*37 + ln*11 + pk%7) % 3910"
READ_ID = "((o*8 + ln)*200003 + pk)*10007 + sk"
FLAG = """CASE WHEN pk % 41 = 0 THEN CASE WHEN sk % 2 = 0 THEN 0 ELSE 16 END ELSE
    (CASE WHEN o % 2 = 0 THEN CASE WHEN ln % 2 = 1 THEN 99 ELSE 147 END ELSE CASE WHEN ln % 2 = 1 THEN 83 ELSE 163 END END)
    - CASE WHEN (pk + sk) % 29 = 0 THEN 2 ELSE 0 END + CASE WHEN sk % 19 = 0 THEN 8 ELSE 0 END + CASE WHEN pk % 31 = 0 THEN 4 ELSE 0 END END
    + CASE WHEN pk % 23 = 0 THEN 1024 ELSE 0 END"""
XG = "CASE pk % 17 WHEN 0 THEN 'CT' WHEN 1 THEN 'GA' WHEN 2 THEN 'Z' END"
NH = "CASE sk % 13 WHEN 0 THEN 2 WHEN 1 THEN 1 END"
HASH = "(o*31 + ln*17 + pk*7 + sk*3 + {i}*{i}*5 + {i}*13) % 97"
QUAL = "(o + ln*3 + pk + {i}*7) % 41"
#: {h}: HASH, {g}: BASE at pos + i.
LETTER = """CASE WHEN {h} < 4 THEN 'N' WHEN {h} < 8 THEN substr('ACGT', CAST(1 + {h} % 4 AS INT), 1)
    WHEN o % 2 = 0 AND {g} = 'C' THEN CASE WHEN {h} % 3 = 0 THEN 'C' ELSE 'T' END
    WHEN o % 2 = 1 AND {g} = 'G' THEN CASE WHEN {h} % 3 = 0 THEN 'G' ELSE 'A' END ELSE {g} END"""


def genome(spark: SparkSession) -> DataFrame:
    """The contigs in chunks with a margin of two bases."""
    base = BASE.format(p="p", t="tid", div="div")
    letters = F.expr(f"array_join(transform(sequence(start - 2, least(start + {CHUNK}, {LENGTH}) + 1), p -> CASE WHEN p < 0 OR p >= {LENGTH} THEN '.' ELSE {base} END), '')")
    chunks = spark.range(CONTIGS * (LENGTH // CHUNK)).selectExpr(f"CAST(id div {LENGTH // CHUNK} AS INT) AS tid", f"id % {LENGTH // CHUNK} * {CHUNK} AS start")
    return chunks.select("tid", F.concat(F.lit("chr"), F.col("tid") + 1).alias("chrom"), F.lit(LENGTH).cast("long").alias("length"), "start", letters.alias("seq"))


def _grid(columns: tuple[pa.Array, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(columns as n x 1, read positions as 1 x longest, which of the grid's cells are in a read)."""
    cols = [np.asarray(c).astype(np.int64)[:, None] for c in columns]
    n = cols[4]
    i = np.arange(int(n.max()) if len(n) else 0)[None, :]
    return cols, i, i < n


def _letters(o: pa.Array, ln: pa.Array, pk: pa.Array, sk: pa.Array, n: pa.Array, pos: pa.Array, tid: pa.Array) -> pa.Array:
    """LETTER of every read position, by batch."""
    (o, ln, pk, sk, n, pos, tid), i, there = _grid((o, ln, pk, sk, n, pos, tid))
    acgt = np.frombuffer(b"ACGT", np.uint8)
    h = (o * 31 + ln * 17 + pk * 7 + sk * 3 + i * i * 5 + i * 13) % 97
    p = pos + i
    g = acgt[(p * p * 7 + p * 31 + (p // 3) * (p // 7) * 5 + tid * 13) % 101 % 4]
    kept, even = h % 3 == 0, o % 2 == 0
    out = np.where(even & (g == ord("C")) & ~kept, ord("T"), np.where(~even & (g == ord("G")) & ~kept, ord("A"), g))
    out = np.where(h < 4, ord("N"), np.where(h < 8, acgt[h % 4], out)).astype(np.uint8)
    ends = np.concatenate(([0], np.cumsum(n.ravel()))).astype(np.int32)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(ends), pa.py_buffer(out[there].tobytes()))


def _quals(o: pa.Array, ln: pa.Array, pk: pa.Array, sk: pa.Array, n: pa.Array, pos: pa.Array, tid: pa.Array) -> pa.Array:
    """QUAL of every read position, by batch."""
    (o, ln, pk, sk, n, pos, tid), i, there = _grid((o, ln, pk, sk, n, pos, tid))
    ends = np.concatenate(([0], np.cumsum(n.ravel()))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(((o + ln * 3 + pk + i * 7) % 41)[there].astype(np.int32)))


def reads(lineitem: DataFrame, ordered: bool = False) -> DataFrame:
    """One alignment per row: the CIGAR is nM, 10M2I(n-12)M or 5S10M3D(n-15)M by line number. Where the order of contigs' names, positions and
    read_id is asked for, the keys are sorted, before letters are made of them."""
    keys = lineitem.selectExpr(*[f"{v} AS {k}" for k, v in READ.items()])
    keys = keys.selectExpr("*", f"{POS} AS pos", "o % 5 AS tid")
    if ordered:
        keys = keys.orderBy(F.expr("concat('chr', tid + 1)"), "pos", F.expr(READ_ID))
    ops: dict[int, list[tuple[str, str]]] = {0: [("M", "n")], 1: [("M", "10"), ("I", "2"), ("M", "n - 12")], 2: [("S", "5"), ("M", "10"), ("D", "3"), ("M", "n - 15")]}

    def cigar(parts: list[tuple[str, str]]) -> str:
        return "array(" + ", ".join(f"named_struct('op', '{op}', 'len', CAST({n} AS INT))" for op, n in parts) + ")"

    chosen = f"CASE ln % 3 WHEN 0 THEN {cigar(ops[0])} WHEN 1 THEN {cigar(ops[1])} ELSE {cigar(ops[2])} END"
    made = keys.selectExpr(
        f"{READ_ID} AS read_id", "CAST(o AS STRING) AS qname", f"CAST({FLAG} AS INT) AS flag", "concat('chr', tid + 1) AS chrom", "pos",
        "CAST(pk % 60 AS INT) AS mapq", f"{chosen} AS cigar", "concat('chr', tid + 1) AS mate_chrom", "(pos + 20) % 3910 AS mate_pos", f"{XG} AS xg", f"CAST({NH} AS INT) AS nh",
        "o", "ln", "pk", "sk", "n", "tid",
    )
    keys = [F.col(c) for c in ("o", "ln", "pk", "sk", "n", "pos", "tid")]
    made = made.withColumns({"seq": F.arrow_udf(_letters, "string")(*keys), "qual": F.arrow_udf(_quals, "array<int>")(*keys)})
    return made.select("read_id", "qname", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual", "mate_chrom", "mate_pos", "xg", "nh")


#: Of every part, on every contig. Starts lie in the first 600 of each 1,000 positions, so that gaps stay whatever the number of parts.
START = "CAST((p_partkey*53) % 3900 - (p_partkey*53) % 3900 % 1000 + (p_partkey*53) % 3900 % 1000 % 600 AS BIGINT)"
REGION = ["concat('chr', CAST(p_partkey % 5 + 1 AS {text})) AS chrom", f"{START} AS start", f'{START} + 20 + p_size AS "end"', "CAST(p_partkey % 3 AS INT) AS strand"]


def regions(part: DataFrame) -> DataFrame:
    return part.selectExpr(*[x.format(text="STRING").replace('"end"', "end") for x in REGION])


def mappability(orders: DataFrame) -> DataFrame:
    """Runs of 50 positions, each with a value from the orders that fall on it."""
    keys = orders.selectExpr("CAST(o_orderkey % 5 + 1 AS STRING) AS c", f"(o_orderkey div 5) % {LENGTH // 50} AS run", "CAST(o_custkey % 101 AS INT) AS v")
    sums = keys.groupBy("c", "run").agg((F.sum("v") % 101).cast("int").alias("value"))
    return sums.select(F.concat(F.lit("chr"), "c").alias("chrom"), (F.col("run") * 50).alias("start"), (F.col("run") * 50 + 50).alias("end"), "value")


