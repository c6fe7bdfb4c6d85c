"""Column functions against literal fixtures and row-at-a-time Python."""

import math
import random

import pytest
from cytosift.functions import calls, cigar, strand
from cytosift.functions.context import context, trinucleotide
from cytosift.options import ExtractOptions, ReadOptions, bounds, flags, region
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("xg", "want"),
    [(None, {99: 1, 83: 2, 163: 2, 147: 1, 0: 1, 16: 2, 1: 0}), ("CT", {99: 1, 83: 3, 163: 3, 147: 1, 0: 1, 16: 3}), ("GA", {99: 4, 83: 2, 163: 2, 147: 4, 0: 4, 16: 2}), ("Z", {99: 1, 83: 2, 163: 2, 147: 1, 0: 1, 16: 2, 1: 0})],
)
def test_strand(spark, xg, want):
    rows = spark.createDataFrame([(f, xg) for f in want], "flag int, xg string")
    assert {r.flag: r.s for r in rows.select("flag", strand.strand_of_origin(F.col("flag"), F.col("xg")).alias("s")).collect()} == want


MATES = [("C", 20, "C", 15, 24, 0), ("C", 15, "C", 20, 0, 24), ("C", 20, "C", 20, 0, 24), ("C", 20, "T", 15, 5, 0), ("C", 20, "T", 20, 0, 0), ("N", 20, "C", 15, 0, 0), ("C", 15, "N", 20, 0, 0), ("N", 0, "C", 30, 0, 30), ("C", 250, "C", 9, 255, 0)]


@pytest.mark.parametrize(("a", "qa", "b", "qb", "wa", "wb"), MATES)
def test_mate_quality(spark, a, qa, b, qb, wa, wb):
    row = spark.createDataFrame([(a, qa, b, qb)], "a string, qa int, b string, qb int")
    got = row.select(calls.resolved_quality(F.lit(True), F.col("a"), F.col("qa"), F.col("b"), F.col("qb")), calls.resolved_quality(F.lit(False), F.col("b"), F.col("qb"), F.col("a"), F.col("qa"))).first()
    assert tuple(got) == (wa, wb)


def walk(ops, seq, qual):
    bases, quals, qpos, q = "", [], [], 0
    for op, n in ops:
        if op in "M=X":
            bases, quals, qpos, q = bases + seq[q : q + n], quals + qual[q : q + n], qpos + list(range(q, q + n)), q + n
        elif op in "DN":
            bases, quals, qpos = bases + "-" * n, quals + [-1] * n, qpos + [-1] * n
        elif op in "IS":
            q += n
    return bases, quals, qpos


def test_alignments_along_the_reference(spark):
    r = random.Random(0)
    rows = [(0, [("S", 2), ("M", 3), ("I", 1), ("M", 2), ("D", 2), ("M", 3)], "ACGTACGTACG", list(range(11)))]
    for i in range(1, 120):
        ops = [(r.choice("MIDNSHP=X"), r.randint(1, 5)) for _ in range(r.randint(1, 6))]
        n = sum(k for op, k in ops if op in "MIS=X")
        rows.append((i, ops, "".join(r.choice("ACGTN") for _ in range(n)), [r.randint(0, 40) for _ in range(n)]))
    frame = spark.createDataFrame(rows, "i int, cigar array<struct<op:string,len:int>>, seq string, qual array<int>")
    got = frame.select("i", cigar.along_reference(F.col("cigar"), F.col("seq"), F.col("qual"), True).alias("x"), cigar.reference_length(F.col("cigar")).alias("n")).collect()
    for g in got:
        _, ops, seq, qual = rows[g.i]
        want = walk(ops, seq, qual)
        assert (g.x.bases, list(g.x.quals), list(g.x.qpos)) == want and g.n == len(want[0])


@pytest.mark.parametrize(("low", "high", "want"), [(2, 8, {0, 1, 8, 9}), (2, 7, {0, 1, 7, 8, 9}), (100, -190, set(range(10))), (0, 10, set())])
def test_masks(spark, low, high, want):
    row = spark.createDataFrame([("ACGTACGTAC", [9] * 10)], "seq string, qual array<int>")
    m = row.select(cigar.masked(F.col("seq"), F.col("qual"), F.lit(low), F.lit(high)).alias("m")).first().m
    assert {i for i, b in enumerate(m.seq) if b == "N"} == want == {i for i, q in enumerate(m.qual) if q == 0}


def contexts_of(seq):
    out = {}
    for i, b in enumerate(seq):
        at = lambda k: seq[k] if 0 <= k < len(seq) else "."  # noqa: B023, E731
        if b not in "CG":
            continue
        d = 1 if b == "C" else -1
        other = "G" if b == "C" else "C"
        name = "CpG" if at(i + d) == other else "CHG" if at(i + 2 * d) == other else "CHH"
        comp = dict(zip("ACGT", "ACGT" if b == "C" else "TGCA", strict=True))
        out[i] = name, "C" + comp.get(at(i + d), "N") + comp.get(at(i + 2 * d), "N")
    return out


def test_contexts(spark):
    from cytosift.sources.fasta import chunked

    r = random.Random(1)
    seqs = {"cg": "CG" * 49 + "CA", "ct": "CT" * 50, "ccgg": "CCGG", "edge": "GNCNGTCNCC", **{f"r{i}": "".join(r.choice("ACGTNcg") for _ in range(r.randint(1, 60))) for i in range(40)}}
    from cytosift.operators.sites import sites

    for size in (7, 1000):
        genome = chunked(spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(seqs.items())], "tid int, chrom string, seq string"), size)
        got = {}
        for x in sites(genome).collect():
            got.setdefault(x.chrom, {})[x.pos] = (x.context, x.tnc)
        assert got == {k: v for k, s in seqs.items() if (v := contexts_of(s.upper()))}
    assert {p: c for p, (c, _) in got["ccgg"].items()} == {0: "CHG", 1: "CpG", 2: "CpG", 3: "CHG"}
    assert context and trinucleotide


@pytest.mark.parametrize(("m", "u", "pct", "text"), [(2, 1, 66, "0.666667"), (5, 1, 83, "0.833333"), (3, 0, 100, "1.000000"), (0, 3, 0, "0.000000"), (1, 127, 0, "0.007812")])
def test_fractions(spark, m, u, pct, text):
    row = spark.createDataFrame([(m, u)], "m long, u long")
    m_, u_ = F.col("m"), F.col("u")
    got = row.select(calls.percent(m_, u_), calls.printf(calls.fraction(m_, u_), 6), calls.printf(calls.logit(m_, u_), 6), calls.printf(100.0 * m_ / (m_ + u_), 2)).first()
    assert got[0] == pct and got[1] == text and got[3] == f"{100 * m / (m + u):.2f}"
    assert got[2] == ("inf" if u == 0 else "-inf" if m == 0 else f"{math.log(m / (m + u)) - math.log(1 - m / (m + u)):.6f}")


@pytest.mark.parametrize(("u", "m", "low", "high"), [(0, 10, 0.423829, 1), (10, 0, 0, 0.576171), (5, 5, 0.139491, 0.860509), (50, 50, 0.343717, 0.656283), (10, 90, 0.752764, 0.969078)])
def test_interval(spark, u, m, low, high):
    got = spark.range(1).select(*calls.interval(F.lit(m), F.lit(u))).first()
    assert abs(got[0] - low) < 1e-6 and abs(got[1] - high) < 1e-6


def test_efficiency_and_mappability(spark):
    got = spark.range(1).select(calls.conversion_efficiency(F.lit(0), F.lit(0)), calls.conversion_efficiency(F.lit(1), F.lit(9)) >= F.lit(0.9).cast("float"), calls.mappable(F.lit(1), 0.01), calls.mappable(F.lit(5), 0.05), calls.mappability_value(F.lit(float("nan"))), calls.mappability_value(F.lit(0.125))).first()
    assert list(got) == [1.0, True, True, False, 0, 13]


def test_options():
    assert bounds(" 1,2,3,4") == (1, 2, 3, 4) and flags("0xD00") == 0xD00 and flags("12") == 12
    assert region("chr1:1,001-2,000") == ("chr1", 1000, 2000) and region("chr1") == ("chr1", 0, None) and region("chr1:5") == ("chr1", 4, None)
    for bad in ("1,2,3", "1,2,3,-4", "a,b,c,d"):
        with pytest.raises(ValueError):
            bounds(bad)
    for bad in ("chr1:0-5", "chr1:9-5"):
        with pytest.raises(ValueError):
            region(bad)
    assert ReadOptions(keep_dupes=True).ignore_flags == 0xB00 and ReadOptions(min_mapq=-3, min_phred=0) == ReadOptions(min_mapq=0, min_phred=1)
    for bad in ({"contexts": ()}, {"min_depth": 0}, {"output": "x"}, {"merge_context": True, "output": "methylkit"}, {"merge_context": True, "output": "cytosine_report"}, {"variant_merge": "x"}, {"bounds": {"XX": (0, 0, 0, 0)}}):
        with pytest.raises(ValueError):
            ExtractOptions(**bad)
