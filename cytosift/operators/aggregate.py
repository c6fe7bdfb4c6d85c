"""Aggregations of base calls. All are sums by key, so partial sums are made before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strand import strand_name
from ..options import ExtractOptions

SITE = ["chrom", "pos", "ref", "context", "tnc"]


def per_site(calls: DataFrame) -> DataFrame:
    """One row per cytosine: n_meth, n_unmeth, n_opposite, n_variant."""
    return calls.groupBy(*SITE).agg(
        F.count_if(F.col("call") == 1).alias("n_meth"), F.count_if(F.col("call") == -1).alias("n_unmeth"),
        F.count_if(~F.col("own")).alias("n_opposite"), F.count_if(F.col("variant")).alias("n_variant"),
    )


def is_variant(options: ExtractOptions) -> Column:
    """Whether enough of the opposite strand's reads contradict the cytosine; off at a depth of 0."""
    if options.min_opposite_depth <= 0:
        return F.lit(False)
    share = F.col("n_variant") / F.nullif("n_opposite", F.lit(0))
    return F.coalesce((F.col("n_opposite") >= options.min_opposite_depth) & (share >= options.max_variant_frac), F.lit(False))


def covered() -> Column:
    return F.col("n_meth") + F.col("n_unmeth") > 0


def merged(sites: DataFrame, options: ExtractOptions) -> DataFrame:
    """Per CpG or CHG: both strands' counts at the place of the C; CHH as it is.

    Takes sites with `excluded` (a variant). By the rule `reference` a variant G drops the site and a variant C only its own
    counts; by `either` any variant drops the site. Of width 2, 3 or 1."""
    width = F.when(F.col("context") == "CpG", 2).when(F.col("context") == "CHG", 3).otherwise(1)
    back = F.when(F.col("ref") == "G", width - 1).otherwise(0)
    dropped = F.max(F.col("excluded") & (F.lit(options.variant_merge == "either") | (F.col("ref") == "G")))
    live = ~F.col("excluded")
    keyed = sites.withColumns({"start": F.when(F.col("context") == "CHH", F.col("pos")).otherwise(F.col("pos") - back), "width": width})
    sums = keyed.groupBy("chrom", "context", "start", "width").agg(F.sum(F.when(live, F.col("n_meth")).otherwise(0)).alias("n_meth"), F.sum(F.when(live, F.col("n_unmeth")).otherwise(0)).alias("n_unmeth"), dropped.alias("dropped"))
    return sums.where(~F.col("dropped") & covered()).select("chrom", "context", "start", (F.col("start") + F.col("width")).alias("end"), "n_meth", "n_unmeth")


def bias(calls: DataFrame) -> DataFrame:
    """(strand, read, position, n_meth, n_unmeth): calls by place in the read, from 1, in the order of the alignment."""
    own = calls.where("own AND call <> 0")
    sums = own.groupBy("strand", "read_no", "qpos").agg(F.count_if(F.col("call") == 1).alias("n_meth"), F.count_if(F.col("call") == -1).alias("n_unmeth"))
    return sums.select(strand_name(F.col("strand")).alias("strand"), F.col("read_no").alias("read"), (F.col("qpos") + 1).cast("long").alias("position"), "n_meth", "n_unmeth")
