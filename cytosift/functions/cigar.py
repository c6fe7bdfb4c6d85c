"""Alignments laid along the reference.

The CIGAR is folded once per read into strings and arrays indexed by reference offset, so that what aligns at a position is one
lookup and bases need not be exploded before they are filtered. A gap (deletion or skip) is `-` with quality and read position -1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = "-"


def reference_length(cigar: Column) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda n, c: n + F.when(c["op"].isin("M", "=", "X", "D", "N"), c["len"]).otherwise(0))


def along_reference(cigar: Column, seq: Column, qual: Column, positions: bool = False) -> Column:
    """struct(bases string, quals array<int>[, qpos array<int>]) indexed by offset from the alignment's start."""
    ints = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("q"), F.lit("").alias("bases"), ints.alias("quals"), *[ints.alias("qpos")] * positions)

    def step(acc: Column, c: Column) -> Column:
        op, n = c["op"], c["len"]
        match, gap = op.isin("M", "=", "X"), op.isin("D", "N")
        parts = [
            (acc["q"] + F.when(match | op.isin("I", "S"), n).otherwise(0)).alias("q"),
            F.when(match, F.concat(acc["bases"], F.substring(seq, acc["q"] + 1, n))).when(gap, F.concat(acc["bases"], F.repeat(F.lit(GAP), n))).otherwise(acc["bases"]).alias("bases"),
            F.when(match, F.concat(acc["quals"], F.slice(qual, acc["q"] + 1, n))).when(gap, F.concat(acc["quals"], F.array_repeat(F.lit(-1), n))).otherwise(acc["quals"]).alias("quals"),
        ]
        if positions:
            parts.append(F.when(match & (n > 0), F.concat(acc["qpos"], F.sequence(acc["q"], acc["q"] + F.greatest(n, F.lit(1)) - 1))).when(gap, F.concat(acc["qpos"], F.array_repeat(F.lit(-1), n))).otherwise(acc["qpos"]).alias("qpos"))
        return F.struct(*parts)

    return F.aggregate(cigar, start, step)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def masked(seq: Column, qual: Column, low: Column, high: Column) -> Column:
    """struct(seq, qual) with base N and quality 0 at read positions below low and from high on."""

    def cut(x: Column) -> Column:
        n, a, b = x["n"], x["a"], x["b"]
        return F.struct(
            F.concat(F.repeat(F.lit("N"), a), F.substring(seq, a + 1, b - a), F.repeat(F.lit("N"), n - b)).alias("seq"),
            F.concat(F.array_repeat(F.lit(0), a), F.slice(qual, a + 1, b - a), F.array_repeat(F.lit(0), n - b)).alias("qual"),
        )

    def within(x: Column) -> Column:
        a = F.least(F.greatest(x["low"], F.lit(0)), x["n"])
        return let(F.struct(x["n"].alias("n"), a.alias("a"), F.greatest(F.least(x["high"], x["n"]), a).alias("b")), cut)

    return let(F.struct(F.length(seq).alias("n"), low.alias("low"), high.alias("high")), within)
