"""Exact dedup with a heavy-hitter split.

One pass over the texts writes a slim table (key, digest). Misra-Gries summaries, one a partition and of at most
COUNTERS digests each, are merged; the CANDIDATES largest are counted exactly, which verifies them and finds their winners.
That table of at most CANDIDATES rows is broadcast and resolves frequent digests on the map side, so no group of copies
goes to one task. The rest, of which no digest is frequent, is grouped by an ordinary shuffle with partial aggregates.

Cases: null text counts as empty; of equal texts the largest key stays, a null key only where all are null; of rows
repeated with the same key exactly one stays; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, by_batches, keyed, materialize

COUNTERS = 512
CANDIDATES = 512


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest binary): SHA-256 of each text with A-Z in lower case."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # bytes.lower() changes A-Z alone
            out = [hashlib.sha256((x.as_buffer().to_pybytes() if x.is_valid else b"").lower()).digest() for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "digest"])

    return by_batches(docs.select(docs[key].alias("key"), docs[text].alias("text"))).mapInArrow(run, f"key {kind}, digest binary")


class MisraGries:
    """At most k counters; an item seen over n / (k + 1) times among n keeps one."""

    def __init__(self, k: int):
        self.k, self.counts = k, Counter()

    def add(self, items: Counter) -> None:
        self.counts.update(items)
        if len(self.counts) > self.k:
            # the batch form: all counters go down by the (k + 1)-th largest
            less = sorted(self.counts.values(), reverse=True)[self.k]
            self.counts = Counter({x: n - less for x, n in self.counts.items() if n > less})


def frequent(slim: DataFrame, counters: int = COUNTERS, candidates: int = CANDIDATES) -> DataFrame:
    """At most `candidates` digests with the largest merged Misra-Gries counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(counters)
        for batch in batches:
            summary.add(Counter(batch.column("digest").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(summary.counts), pa.binary()), pa.array(list(summary.counts.values()), pa.int64())], ["digest", "n"])

    # each digest's counts add up over the partitions; what occurs once in one summary is not worth a broadcast row
    return slim.select("digest").mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "digest").limit(candidates).select("digest")


def resolve(slim: DataFrame) -> DataFrame:
    """slim (key, digest, row: unique) with keep_id, group_size and kept."""
    stats = (F.count(F.lit(1)).alias("group_size"), F.max(F.struct("key", "row")).alias("best"))
    spark = slim.sparkSession
    # at most CANDIDATES rows, so their broadcasts have a proven bound
    found = spark.createDataFrame(frequent(slim).collect(), "digest binary")
    winners = slim.join(F.broadcast(found), "digest").groupBy("digest").agg(*stats)
    winners = F.broadcast(spark.createDataFrame(winners.collect(), winners.schema))
    heavy = slim.join(winners, "digest")
    rest = slim.join(F.broadcast(found), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(*stats)
    both = heavy.unionByName(rest.join(groups, "digest"))
    return both.select("key", "row", F.col("best.key").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), "digest")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256."""
    slim = materialize(digests(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "digests")
    return resolve(slim).select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their columns as they are."""
    docs, row, added = keyed(docs, key)
    if added:  # the winner is chosen by the key, the row number tells equal rows apart
        hashed = digests(docs.select(docs[row].alias("r"), docs[text].alias("t")), "r", "t").withColumnRenamed("key", "row")
        slim = materialize(hashed.join(docs.select(docs[row].alias("row"), docs[key].alias("key")), "row"), "digests")
    else:
        slim = materialize(digests(docs, key, text).withColumn("row", F.col("key")), "digests")
    gone = materialize(resolve(slim).where("NOT kept").select(F.col("row").alias(row)), "copies")
    kept = docs.join(bounded_broadcast(gone, gone.count()), row, "left_anti")
    return kept.drop(row) if added else kept
