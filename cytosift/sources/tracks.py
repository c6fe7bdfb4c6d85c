"""Mappability tracks: the run-length binary format (BBM, version 1) and bigWig."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.calls import mappability_value
from ..operators.intervals import RUN_CHUNK, run_lengths
from ..schemas import MAPPABILITY
from .files import create, open_bytes

#: Fixed values of the format: version, what a short run's length byte is over the length, longest short run, long-run mark, longest run.
VERSION, OFFSET, SHORT, LONG, LONGEST = 1, 99, 155, 255, 65_535


def encode_runs(runs: Iterator[tuple[int, int]]) -> bytes:
    """(length, value) runs as bytes."""
    out = bytearray()
    for length, value in runs:
        if not 0 <= value <= 100:
            raise ValueError(f"a value lies between 0 and 100: {value}")
        while length:
            n = min(length, LONGEST)
            out += bytes((value,)) if n == 1 else bytes((n + OFFSET, value)) if n <= SHORT else struct.pack("<BHB", LONG, n, value)
            length -= n
    return bytes(out)


def decode_file(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(chrom, start, end, value) of every run."""
    if not data or data[0] != VERSION:
        raise ValueError("not a BBM file of version 1")
    count, at = struct.unpack_from("<I", data, 1)[0], 5
    for _ in range(count):
        n = struct.unpack_from("<H", data, at)[0]
        chrom = data[at + 2 : at + 2 + n].decode("ascii")
        if data[at + 2 + n] != 0:
            raise ValueError(f"the name {chrom!r} has no end")
        length, pos, at = struct.unpack_from("<I", data, at + 3 + n)[0], 0, at + 7 + n
        while pos < length:
            mark = data[at]
            if mark == LONG:
                run, value, used = struct.unpack_from("<H", data, at + 1)[0], data[at + 3], 4
            elif mark > 100:
                run, value, used = mark - OFFSET, data[at + 1], 2
            else:
                run, value, used = 1, mark, 1
            yield chrom, pos, pos + run, value
            pos, at = pos + run, at + used


def read_bbm(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow as pa

    names = ["chrom", "start", "end", "value"]

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                held = []
                for row in decode_file(content):
                    held.append(row)
                    if len(held) == 50_000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, MAPPABILITY)


def write_bbm(track: DataFrame, contigs: DataFrame, path: str, chunk: int = RUN_CHUNK) -> None:
    """track (chrom, start, end, value) as one file, contigs in their order; what the track leaves out is 0.

    Runs are encoded by chunks of a contig on the executors; the driver streams one chunk's bytes at a time into the file."""
    known = contigs.select("tid", "chrom", F.col("length").cast("long").alias("length"))
    cuts = track.select("chrom", "start", "end", "value").where("start < end")
    filled = run_lengths(_filled(cuts, known, chunk), LONGEST, chunk).withColumn("chunk", F.floor(F.col("start") / chunk))

    def one(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("start")
        runs = zip((pdf["end"] - pdf["start"]).tolist(), pdf["value"].tolist(), strict=True)
        return pd.DataFrame({"chrom": [key[0]], "chunk": [key[1]], "data": [encode_runs(runs)]})

    data = filled.groupBy("chrom", "chunk").applyInPandas(one, "chrom string, chunk long, data binary")
    total, last = known.count(), None
    with create(path) as out:
        out.write(struct.pack("<BI", VERSION, total))
        for r in known.join(data, "chrom", "left").orderBy("tid", "chunk").toLocalIterator():
            if r.tid != last:
                name = r.chrom.encode("ascii")
                out.write(struct.pack("<H", len(name)) + name + b"\0" + struct.pack("<I", r.length))
            out.write(bytes(r.data or b""))
            last = r.tid


def _filled(track: DataFrame, contigs: DataFrame, chunk: int) -> DataFrame:
    """The track, cut at chunks of a contig, with rows of value 0 for what lies between, before and after its rows. No task sees more than a chunk."""
    from pyspark.sql import Window

    rows = track.join(F.broadcast(contigs.select("chrom", "length")), "chrom").withColumn("end", F.least("end", "length")).where("start < end")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))))
    rows = rows.select("chrom", "chunk", F.greatest("start", F.col("chunk") * chunk).alias("start"), F.least("end", (F.col("chunk") + 1) * chunk).alias("end"), "value")
    last = F.coalesce(F.lag("end").over(Window.partitionBy("chrom", "chunk").orderBy("start")), F.col("chunk") * chunk)
    before = rows.select("chrom", last.alias("start"), F.col("start").alias("end"), F.lit(0).alias("value"))
    every = contigs.where("length > 0").select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / chunk))).alias("chunk"))
    ends = every.join(rows.groupBy("chrom", "chunk").agg(F.max("end").alias("last")), ["chrom", "chunk"], "left")
    ends = ends.select("chrom", F.coalesce("last", F.col("chunk") * chunk).alias("start"), F.least("length", (F.col("chunk") + 1) * chunk).alias("end"), F.lit(0).alias("value"))
    return rows.select("chrom", "start", "end", "value").union(before).union(ends).where("start < end")


#: Of the bigWig format (fixed values): magic numbers of the file, its name tree and its index.
BIGWIG, NAMES, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0


def bigwig_layout(path: str) -> tuple[list[tuple[str, int]], list[tuple[int, int]], bool]:
    """(contigs by number, (offset, size) of every data block, whether blocks are compressed)."""
    with open_bytes(path) as data:
        head = data.read(64)
        magic, _, _, names_at, _, index_at = struct.unpack_from("<IHHQQQ", head)
        if magic != BIGWIG:
            raise ValueError(f"{path}: not a little-endian bigWig file")
        compressed = struct.unpack_from("<I", head, 52)[0] > 0

        def read(at: int, n: int) -> bytes:
            data.seek(at)
            return data.read(n)

        magic, _, key, _, _ = struct.unpack("<IIIIQ", read(names_at, 24))
        if magic != NAMES:
            raise ValueError(f"{path}: no table of contigs")
        found: dict[int, tuple[str, int]] = {}
        todo = [names_at + 32]
        while todo:
            at = todo.pop()
            leaf, _, n = struct.unpack("<BBH", read(at, 4))
            body = read(at + 4, n * (key + 8))
            for i in range(n):
                name = body[i * (key + 8) : i * (key + 8) + key].rstrip(b"\0").decode()
                if leaf:
                    number, length = struct.unpack_from("<II", body, i * (key + 8) + key)
                    found[number] = (name, length)
                else:
                    todo.append(struct.unpack_from("<Q", body, i * (key + 8) + key)[0])
        if struct.unpack("<I", read(index_at, 4))[0] != INDEX:
            raise ValueError(f"{path}: no index")
        spots, todo = [], [index_at + 48]
        while todo:
            at = todo.pop()
            leaf, _, n = struct.unpack("<BBH", read(at, 4))
            width = 32 if leaf else 24
            body = read(at + 4, n * width)
            for i in range(n):
                if leaf:
                    spots.append(struct.unpack_from("<QQ", body, i * width + 16))
                else:
                    todo.append(struct.unpack_from("<Q", body, i * width + 16)[0])
    return [found[i] for i in sorted(found)], sorted(spots), compressed


def bigwig_block(block: bytes) -> Iterator[tuple[int, int, int, float]]:
    """(contig number, start, end, value) of a data block: bedGraph, variable or fixed steps."""
    tid, start, _, step, span, kind, _, n = struct.unpack_from("<IIIIIBBH", block)
    for i in range(n):
        if kind == 1:
            a, b, v = struct.unpack_from("<IIf", block, 24 + 12 * i)
        elif kind == 2:
            a, v = struct.unpack_from("<If", block, 24 + 8 * i)
            b = a + span
        else:
            a, v = start + i * step, struct.unpack_from("<f", block, 24 + 4 * i)[0]
            b = a + span
        yield tid, a, b, v


class _Spots(InputPartition):
    def __init__(self, spots):
        self.spots = spots


class BigWigReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per = options["path"], int(options.get("blocks", 2000))

    def partitions(self):
        spots = bigwig_layout(self.path)[1]
        return [_Spots(spots[i : i + self.per]) for i in range(0, len(spots), self.per)] or [_Spots([])]

    def read(self, part):
        contigs, _, compressed = bigwig_layout(self.path)
        with open_bytes(self.path) as data:
            for at, n in part.spots:
                data.seek(at)
                block = data.read(n)
                for tid, a, b, v in bigwig_block(zlib.decompress(block) if compressed else block):
                    yield contigs[tid][0], a, b, v


class BigWigSource(DataSource):
    @classmethod
    def name(cls):
        return "bigwig"

    def schema(self):
        return "chrom string, start long, end long, value double"

    def reader(self, schema):
        return BigWigReader(self.options)


def read_bigwig(spark: SparkSession, path: str, blocks: int = 2000) -> DataFrame:
    """chrom, start, end, value (raw)."""
    spark.dataSource.register(BigWigSource)
    return spark.read.format("bigwig").option("blocks", blocks).load(path)


def bigwig_contigs(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(bigwig_layout(path)[0])], "tid int, chrom string, length long")


def as_mappability(raw: DataFrame) -> DataFrame:
    """Raw values between 0 and 1 as whole percents."""
    return raw.select("chrom", "start", "end", mappability_value(F.col("value")).alias("value"))


def bigwig_to_bbm(spark: SparkSession, source: str, to: str) -> None:
    write_bbm(as_mappability(read_bigwig(spark, source)), bigwig_contigs(spark, source), to)
