"""Read filters. Cheap predicates come first, and all are plain columns, so they reach a Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strand import STRANDS, has, is_second, strand_of_origin
from ..options import ReadOptions


def read_filter(options: ReadOptions) -> Column:
    """What a read must meet, of its own columns: mapped, mapping quality, flags, duplicates, one alignment, pairs."""
    flag = F.col("flag")
    keep = ~has(flag, 0x4) & F.col("chrom").isNotNull() & (F.col("mapq") >= options.min_mapq)
    keep &= flag.bitwiseAND(F.lit(options.ignore_flags)) == 0
    keep &= flag.bitwiseAND(F.lit(options.require_flags)) == options.require_flags
    if not options.keep_dupes:
        keep &= ~has(flag, 0x400)
    if not options.ignore_nh:
        keep &= F.coalesce("nh", F.lit(1)) <= 1
    if not options.keep_singleton:
        keep &= ~has(flag, 0x9)
    if not options.keep_discordant:
        keep &= flag.bitwiseAND(F.lit(0x3)) != 0x1
    return keep


def filter_reads(reads: DataFrame, options: ReadOptions) -> DataFrame:
    """Reads that pass, with `strand`; paired reads whose mate is mapped get the proper-pair bit. A paired read that is neither first nor second is dropped."""
    flag = F.col("flag")
    # strand > 0, said of the flag itself, which a scan can test
    stranded = ~has(flag, 0x1) | (flag.bitwiseAND(F.lit(0xC0)) != 0) | F.coalesce(F.substring("xg", 1, 1).isin("C", "G"), F.lit(False))
    out = reads.where(read_filter(options) & stranded).withColumn("strand", strand_of_origin(flag, F.col("xg")))
    return out.withColumn("flag", F.when(flag.bitwiseAND(F.lit(0x9)) == 0x1, flag.bitwiseOR(F.lit(0x2))).otherwise(flag))


def kept_range(options: ReadOptions) -> tuple[Column, Column]:
    """(low, high): the read positions that inclusion bounds and absolute trims leave, by strand and read number."""
    n, second = F.length("seq"), is_second(F.col("flag"))

    def of(given: dict[str, tuple[int, int, int, int]], side: int) -> Column:
        """The value of the read's strand and number; 0 where none is given."""
        out = F.lit(0)
        for number, name in enumerate(STRANDS, 1):
            if name in given:
                out = F.when(F.col("strand") == number, F.when(second, given[name][side + 2]).otherwise(given[name][side])).otherwise(out)
        return out

    right = of(options.bounds, 1)
    low = F.greatest(of(options.bounds, 0), F.least(of(options.trims, 0), n))
    return low, F.least(F.when(right > 0, right).otherwise(n), n - F.least(of(options.trims, 1), n))
