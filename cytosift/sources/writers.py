"""Writers of the text outputs. A file that must be one file in order is streamed through the driver, partition by partition."""

from __future__ import annotations

import sys
from contextlib import nullcontext

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calls import printf
from ..plans.extract import lines, ordered
from .files import create

SUFFIX = {"bedgraph": "bedGraph", "fraction": "meth.bedGraph", "counts": "counts.bedGraph", "logit": "logit.bedGraph", "methylkit": "methylKit"}
LEVELS = {"bedgraph": "methylation levels", "fraction": "methylation fractions", "counts": "methylation counts", "logit": "logit transformed methylation fractions"}
MERGED_HEADER = 'track type="bedGraph" description="merged Methylation metrics"'
METHYLKIT_HEADER = "chrBase\tchr\tbase\tstrand\tcoverage\tfreqC\tfreqT"
MBIAS_HEADER = "Strand\tRead\tPosition\tnMethylated\tnUnmethylated"


def track_line(name: str, context: str, output: str, merged: bool) -> str:
    return f'track type="bedGraph" description="{name} {context}{" merged" if merged else ""} {LEVELS[output]}"'


def write_lines(rows: DataFrame, path: str | None, header: str | None = None) -> int:
    """The column `value` of rows, in their order, as one file, or to standard output where path is None; returns how many."""
    n = 0
    with nullcontext(sys.stdout.buffer) if path is None else create(path) as out:
        if header is not None:
            out.write(header.encode() + b"\n")
        for r in rows.toLocalIterator(prefetchPartitions=True):
            out.write(r.value.encode() + b"\n")
            n += 1
        out.flush()
    return n


def write_extract(rows: DataFrame, genome: DataFrame, prefix: str, output: str, contexts: tuple[str, ...], merged: bool = False) -> list[str]:
    """The files of `extract`: one per context, or the cytosine report; returns their paths. Rows are computed once and kept on the executors'
    disks: each file's sort reads them twice, for its bounds and for its rows."""
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        return _write_extract(rows, genome, prefix, output, contexts, merged)
    finally:
        rows.unpersist()


def _write_extract(rows: DataFrame, genome: DataFrame, prefix: str, output: str, contexts: tuple[str, ...], merged: bool) -> list[str]:
    if output == "cytosine_report":
        path = f"{prefix}.cytosine_report.txt"
        write_lines(ordered(rows, genome, "pos").select(lines(rows, output).alias("value")), path)
        return [path]
    paths = []
    for context in contexts:
        path = f"{prefix}_{context}.{SUFFIX[output]}"
        own = ordered(rows.where(F.col("context") == context), genome, "base" if output == "methylkit" else "start")
        write_lines(own.select(lines(own, output).alias("value")), path, METHYLKIT_HEADER if output == "methylkit" else track_line(prefix, context, output, merged))
        paths.append(path)
    return paths


def write_merged(rows: DataFrame, genome: DataFrame, path: str | None) -> None:
    own = ordered(rows, genome)
    write_lines(own.select(lines(own, "bedgraph").alias("value")), path, MERGED_HEADER)


def write_per_read(rows: DataFrame, genome: DataFrame, path: str | None) -> None:
    own = ordered(rows, genome, "pos")
    pct = F.when(F.col("n_informative") == 0, "0.0").otherwise(printf(F.col("pct"), 6))
    write_lines(own.select(F.concat_ws("\t", "qname", "chrom", "pos", pct, "n_informative").alias("value")), path)


def mbias_lines(rows: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, ("OT", "OB", "CTOT", "CTOB"))), F.col("strand"))
    return rows.orderBy(order, "position", "read").select(F.concat_ws("\t", "strand", "read", "position", "n_meth", "n_unmeth").alias("value"))


def write_mbias(rows: DataFrame, path: str) -> None:
    write_lines(mbias_lines(rows), path, MBIAS_HEADER)
