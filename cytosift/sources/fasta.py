"""FASTA to genome chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sites import MARGIN
from ..schemas import GENOME

CHUNK = 1 << 16


def chunked(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(tid, chrom, seq) of whole contigs -> the chunks of a genome table, upper case, with a margin that is `.` beyond the contig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, chrom, seq in zip(*(batch.column(c).to_pylist() for c in ("tid", "chrom", "seq")), strict=True):
                whole = "." * MARGIN + seq.upper() + "." * MARGIN
                starts = list(range(0, len(seq), chunk))
                for i in range(0, len(starts), 64):
                    own = starts[i : i + 64]
                    parts = [whole[s : min(s + chunk, len(seq)) + 2 * MARGIN] for s in own]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([tid] * n, pa.int32()), pa.array([chrom] * n), pa.array([len(seq)] * n, pa.int64()), pa.array(own, pa.int64()), pa.array(parts)], ["tid", "chrom", "length", "start", "seq"])

    return sequences.select("tid", "chrom", "seq").mapInArrow(run, GENOME)


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """A genome table of the contigs of a FASTA file, plain or gzipped; contigs are numbered in the file's order."""
    records = spark.read.text(path, lineSep=">").where("trim(value) <> ''").withColumn("id", F.monotonically_increasing_id())
    head = F.substring_index("value", "\n", 1)
    named = records.select("id", F.split(head, r"\s+")[0].alias("chrom"), F.regexp_replace(F.substring("value", F.length(head) + 1, F.length("value")), r"\s", "").alias("seq"))
    order = [r.chrom for r in named.select("id", "chrom").orderBy("id").collect()]  # one row a contig
    numbers = spark.createDataFrame(list(enumerate(order)), "tid int, chrom string")
    return chunked(named.join(F.broadcast(numbers), "chrom"), chunk)
