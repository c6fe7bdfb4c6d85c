"""Interval joins without a theta join: both sides meet on (chrom, width, bin).

An interval of the left side has one row, in the bin of its start, of the least of WIDTHS that is no shorter than it. A region has a row in every
bin of every width that it touches, and in the one before, from which an interval may reach into it. So a pair meets once, and
the left side is neither multiplied nor made distinct, however long its intervals are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strand import STRANDS

WIDTHS = tuple(256 << 4 * k for k in range(6))
BIN = WIDTHS[0]
#: Rows that a region table has when cut into bins, up to which it is broadcast.
BROADCAST_ROWS = 500_000
#: Positions of a contig of which the regions that start there are put in order in one task.
START_CHUNK = 1 << 22


def in_bins(regions: DataFrame, widths: tuple[int, ...] = WIDTHS, before: int = 1) -> DataFrame:
    """regions (r_start, r_end, ...) with a row for each (_width, _bin) as the module says; broadcast if these rows are few enough, else
    surely not (Spark's own estimate knows nothing of the rows that the cut adds)."""
    regions = regions.where("r_start < r_end")
    first = {w: F.floor(F.col("r_start") / w) - before for w in widths}
    last = {w: F.floor((F.col("r_end") - 1) / w) for w in widths}
    rows = sum((last[w] - first[w] + 1 for w in widths), F.lit(0))

    def of(w: int) -> Column:
        return F.transform(F.sequence(first[w], last[w]), lambda b: F.struct(F.lit(w).alias("_width"), b.alias("_bin")))

    cut = F.concat(*map(of, widths))
    found = regions.withColumn("_cut", F.explode(cut)).withColumns({"_width": F.col("_cut._width"), "_bin": F.col("_cut._bin")}).drop("_cut")
    return F.broadcast(found) if (regions.agg(F.sum(rows)).first()[0] or 0) <= BROADCAST_ROWS else found.hint("merge")


def united(regions: DataFrame) -> DataFrame:
    """(chrom, r_start, r_end) that the same intervals overlap as the regions, however often these overlap each other: those that share a position
    are one, within chunks of a contig. Those that only touch stay two, as an empty interval between them overlaps neither."""
    longest = regions.where("r_start < r_end").groupBy("chrom", "r_start").agg(F.max("r_end").alias("r_end")).withColumn("_chunk", F.floor(F.col("r_start") / START_CHUNK))
    w = Window.partitionBy("chrom", "_chunk").orderBy("r_start")
    apart = F.coalesce(F.col("r_start") >= F.max("r_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = F.sum(F.col("_apart").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return longest.withColumn("_apart", apart).withColumn("_island", island).groupBy("chrom", "_chunk", "_island").agg(F.min("r_start").alias("r_start"), F.max("r_end").alias("r_end")).drop("_chunk", "_island")


def placed(left: DataFrame, start: Column, end: Column) -> DataFrame:
    """left with the (_width, _bin) of [start, end)."""
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        width = F.when(end - start <= w, F.lit(w)).otherwise(width)
    return left.withColumn("_width", width).withColumn("_bin", F.floor(start / F.col("_width")))


def overlap_join(left: DataFrame, right: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of left with every row of right (chrom, r_start, r_end, ...) that it overlaps by a base or more."""
    meet = (F.col(start) < F.col("r_end")) & (F.col("r_start") < F.col(end))
    return placed(left.where(F.col(start) < F.col(end)), F.col(start), F.col(end)).join(in_bins(right), ["chrom", "_width", "_bin"]).where(meet).drop("_width", "_bin")


def reads_in_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads whose span [pos, ref_end) overlaps any region: a semi join with the united regions, to which a read comes with one row."""
    r = in_bins(united(regions.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end")))).withColumnRenamed("chrom", "r_chrom")
    r = r.select("r_chrom", F.col("_width").alias("r_width"), F.col("_bin").alias("r_bin"), "r_start", "r_end")
    meet = (F.col("chrom") == F.col("r_chrom")) & (F.col("_width") == F.col("r_width")) & (F.col("_bin") == F.col("r_bin")) & (F.col("pos") < F.col("r_end")) & (F.col("r_start") < F.col("ref_end"))
    return placed(reads, F.col("pos"), F.col("ref_end")).join(r, meet, "left_semi").drop("_width", "_bin")


def firsts(regions: DataFrame) -> DataFrame:
    """regions (chrom, r_start, r_end, r_strand) cut to the positions at which each is the first by (start, end, strand), so that no position is in two.

    A region is the first from where those before it have all ended. They are put in order within chunks of a contig; how far earlier chunks
    reach comes with a row a chunk."""
    least = regions.where("r_start < r_end").groupBy("chrom", "r_start", "r_end").agg(F.min("r_strand").alias("r_strand")).withColumn("_chunk", F.floor(F.col("r_start") / START_CHUNK))
    chunks = Window.partitionBy("chrom").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    reach = least.groupBy("chrom", "_chunk").agg(F.max("r_end").alias("_end")).select("chrom", "_chunk", F.max("_end").over(chunks).alias("_reach"))
    w = Window.partitionBy("chrom", "_chunk").orderBy("r_start", "r_end").rowsBetween(Window.unboundedPreceding, -1)
    cut = least.withColumn("_seen", F.max("r_end").over(w)).join(F.broadcast(reach), ["chrom", "_chunk"])
    return cut.withColumn("r_start", F.greatest("r_start", "_seen", "_reach")).where("r_start < r_end").select("chrom", "r_start", "r_end", "r_strand")


def region_of_positions(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """sites within a region, with `region_strand` of the first such region by (start, end, strand)."""
    r = in_bins(firsts(regions.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("strand").alias("r_strand"))), (BIN,), before=0).drop("_width")
    hit = sites.withColumn("_bin", F.floor(F.col("pos") / BIN)).join(r, ["chrom", "_bin"]).where("pos >= r_start AND pos < r_end")
    return hit.select(*sites.columns, F.col("r_strand").alias("region_strand"))


def strand_matches(strand: Column, region_strand: Column) -> Column:
    """Region strand 1 (+) takes OT and CTOT, 2 (-) OB and CTOB, 0 all."""
    return (region_strand == 0) | ((region_strand == 1) == (strand % 2 == 1))


def mappable_reads(reads: DataFrame, mappability: DataFrame, cutoff: float, least: int) -> DataFrame:
    """Reads of which, or of whose mate, `least` bases or more are mappable.

    Spans are as long as the read, for the mate too, and the mate's is looked up on the read's own contig; a read that is
    not paired has no mate."""
    from ..functions.calls import mappable
    from ..functions.strand import has

    n = F.length("seq").cast("long")
    spans = F.array(F.struct(F.lit(0).alias("who"), F.col("pos").alias("start"), (F.col("pos") + n).alias("end")), F.when(has(F.col("flag"), 0x1) & F.col("mate_pos").isNotNull(), F.struct(F.lit(1).alias("who"), F.col("mate_pos").alias("start"), (F.col("mate_pos") + n).alias("end"))))
    cut = reads.select("read_id", "chrom", F.explode(spans).alias("span")).where("span IS NOT NULL").select("read_id", "chrom", "span.*")
    good = mappability.where(mappable(F.col("value"), cutoff)).select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    kept = overlap_join(cut, good, "start", "end").groupBy("read_id", "who").agg(F.sum(shared).alias("n")).where(F.col("n") >= least).select("read_id")
    return reads if least <= 0 else reads.join(kept, "read_id", "left_semi")


#: Positions of a contig whose runs are found in one task.
RUN_CHUNK = 1 << 22


def run_lengths(values: DataFrame, longest: int = 65_535, chunk: int = RUN_CHUNK) -> DataFrame:
    """values (chrom, start, end, value) laid end to end -> runs of one value, none longer than `longest`.

    Islands are found by a running count of changes, within chunks of a contig. Then the first and the last run of every chunk, two rows
    a chunk, are joined in the same way along their contig; no task sees more of it."""
    def joined(rows: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("start")
        changed = (F.lag("value").over(w).eqNullSafe(F.col("value")) & (F.lag("end").over(w) == F.col("start"))).cast("int")
        island = F.sum(1 - F.coalesce(changed, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value"))

    runs = joined(values.withColumn("chunk", F.floor(F.col("start") / chunk)), "chrom", "chunk")
    most = F.max("island").over(Window.partitionBy("chrom", "chunk"))
    runs = runs.withColumn("edge", (F.col("island") == 1) | (F.col("island") == most))
    whole = runs.where("NOT edge").select("chrom", "start", "end", "value").union(joined(runs.where("edge").select("chrom", "start", "end", "value"), "chrom").drop("island").select("chrom", "start", "end", "value"))
    cuts = F.sequence(F.col("start"), F.col("end") - 1, F.lit(longest).cast("long"))
    return whole.withColumn("cut", F.explode(cuts)).select("chrom", F.col("cut").alias("start"), F.least("end", F.col("cut") + longest).alias("end"), "value")


__all__ = ["BIN", "STRANDS", "WIDTHS", "in_bins", "mappable_reads", "overlap_join", "placed", "reads_in_regions", "region_of_positions", "run_lengths", "strand_matches"]
