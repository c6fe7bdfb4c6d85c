"""`mbias`: methylation by place in the read, its confidence intervals, and suggested bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calls import interval
from ..operators.aggregate import bias
from ..operators.pileup import base_calls
from ..options import ReadOptions


def mbias(reads: DataFrame, genome: DataFrame, options: ReadOptions = ReadOptions(), contexts: tuple[str, ...] = ("CpG",), regions: DataFrame | None = None) -> DataFrame:
    """Mates both count; nothing is resolved between them."""
    return bias(base_calls(reads, genome, options, contexts, regions, mates=False, positions=True))


def with_intervals(rows: DataFrame) -> DataFrame:
    low, high = interval(F.col("n_meth"), F.col("n_unmeth"))
    return rows.withColumns({"fraction": F.col("n_meth") / (F.col("n_meth") + F.col("n_unmeth")), "ci_low": low, "ci_high": high})


def thresholds(rows: DataFrame) -> DataFrame:
    """(strand, read, left, right): the last place from the middle outwards that departs from the middle's mean; 0: none.

    The middle is the places int(0.2 L) to int(0.8 L) of a strand's L, of both reads. A place departs if it differs from the
    mean of the middle by over 0.05, its interval excludes the mean, and it lies beyond the middle's intervals. Left is
    the first place, from 1, to keep, right the last."""
    at = F.col("position") - 1
    size = rows.groupBy("strand").agg(F.max("position").alias("n"))
    ci = with_intervals(rows).join(F.broadcast(size), "strand")  # four strands
    middle = (at >= F.floor(F.col("n") * 0.2)) & (at <= F.floor(F.col("n") * 0.8))
    inner = ci.where(middle).groupBy("strand", "read").agg(F.avg("fraction").alias("mean"), F.min("ci_high").alias("min_ci"), F.max("ci_low").alias("max_ci"))
    joined = ci.join(F.broadcast(inner), ["strand", "read"], "left")
    far = F.abs(F.col("fraction") - F.col("mean")) > 0.05
    departs = far & (((F.col("ci_high") < F.col("mean")) & (F.col("fraction") < F.col("min_ci"))) | ((F.col("ci_low") > F.col("mean")) & (F.col("fraction") > F.col("max_ci"))))
    half = F.floor(F.col("n") / 2)
    out = joined.groupBy("strand", "read").agg(F.max(F.when(departs & (at <= half), at + 2)).alias("left"), F.min(F.when(departs & (at > half), at)).alias("right"))
    return out.select("strand", "read", F.coalesce("left", F.lit(0)).cast("long").alias("left"), F.coalesce("right", F.lit(0)).cast("long").alias("right"))


def suggested(rows: DataFrame) -> list[str]:
    """Options that would apply the suggestions, by strand: `--OT a,b,c,d`."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in thresholds(rows).collect():  # eight rows
        by.setdefault(r.strand, {})[r.read] = (r.left, r.right)
    return [f"--{k} {','.join(str(x) for n in (1, 2) for x in by[k].get(n, (0, 0)))}" for k in ("OT", "OB", "CTOT", "CTOB") if k in by]
