"""Methylation counts over a stream of alignments.

Counts are sums, so an update query keeps them per site or per place in the read. Mates are not resolved here: that takes both at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import bias, per_site
from ..operators.pileup import base_calls
from ..options import ExtractOptions, ReadOptions


def site_counts(reads: DataFrame, genome: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """Streaming reads -> running counts per cytosine, for output mode update or complete."""
    if options.min_conversion_efficiency > 0:
        raise ValueError("the conversion filter needs an aggregate of its own; run it as a batch")
    return per_site(base_calls(reads, genome, options, options.contexts, mates=False)).where(F.col("n_meth") + F.col("n_unmeth") >= options.min_depth)


def bias_counts(reads: DataFrame, genome: DataFrame, options: ReadOptions = ReadOptions(), contexts: tuple[str, ...] = ("CpG",)) -> DataFrame:
    return bias(base_calls(reads, genome, options, contexts, mates=False, positions=True))
