"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt into shards by the upper levels of a KD-tree: median splits of the widest side, whose places come from a sample of
SAMPLE vectors at most; equal values are dealt to both sides by a hash, so that one very common vector is spread. Every shard's tight
box is then taken from all its vectors, so results don't depend on the sample. Within a shard a tree splits at the median of
the widest side and keeps the tight box of every node; the bound of a query and a box is the sum of the larger product at each
side. The search goes best bound first and ends when no open box can better the kth result. In the first round each query searches
its home shard; the kth result found there is propagated: a query goes on to those shards only whose root box can better
it, and prunes their boxes from the start. Queries go to the shards in blocks, so a task holds one shard and one block; only k
rows a query and shard come back.

Cases: a vector that is null or holds a null or non-finite component takes no part, nor does one with a component that 256-fold isn't finite; an
empty vector has score 0 with all; missing components of shorter vectors count as 0; a null id is no query and no candidate; rows with the query's id are its
own; of repeated rows each is a candidate and the least vector is the query; ties go to the smaller id; numbers of any size are
scored exactly, and scores beyond a long count as the nearest, plus or minus 2^63 - 1; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD_ROWS = 16_384
#: Shards at most, which bounds the table of root boxes that is broadcast; beyond it shards grow.
SHARDS = 4096
SAMPLE = 20_000
BLOCK_QUERIES = 4096
LEAF = 256
MOST = 2**63 - 1


class KDTree:
    """Median splits; nodes in arrays; node 2i + 1 and 2i + 2 lie below node i."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF, exact: np.ndarray | None = None):
        """exact: the points as whole numbers of Python, where float64 can't hold their products."""
        depth = 0
        while len(points) >> depth > leaf:
            depth += 1
        n = 2 ** (depth + 1) - 1
        self.first_leaf = 2**depth - 1
        self.low, self.high, self.least_id = np.zeros((n, points.shape[1])), np.zeros((n, points.shape[1])), np.zeros(n, np.int64)
        self.exact = exact is not None
        self.leaves: list[tuple[np.ndarray, np.ndarray]] = []
        rows = [np.arange(len(points))]
        for i in range(n):
            own = rows[i]
            rows[i] = None
            box = points[own]
            self.low[i], self.high[i], self.least_id[i] = box.min(0), box.max(0), ids[own].min()
            if i < self.first_leaf:
                side = int((self.high[i] - self.low[i]).argmax())
                half = np.argpartition(box[:, side], len(own) // 2)  # by place, so equal values split too
                rows += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
            else:
                self.leaves.append((exact[own] if self.exact else box, ids[own]))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that each query (row) can score with a point in each node's box (column)."""
        return most_scores(queries, self.low, self.high, self.exact)

    def search(self, query: np.ndarray, bound: np.ndarray, own: int, k: int, kth: tuple[int, int] | None) -> list[tuple[int, int]]:
        """The k best (-score, id) that are better than kth, the last of k results that the query has elsewhere."""
        best: list[tuple[int, int]] = []
        heap = [(-bound[0], 0)]
        while heap:
            negative, i = heapq.heappop(heap)
            if kth is not None and (negative, self.least_id[i]) > kth:
                if negative > kth[0]:
                    break
                continue
            if i < self.first_leaf:
                heapq.heappush(heap, (-bound[2 * i + 1], 2 * i + 1))
                heapq.heappush(heap, (-bound[2 * i + 2], 2 * i + 2))
                continue
            points, ids = self.leaves[i - self.first_leaf]
            score = -(points @ query)
            if self.exact:
                score = np.array([max(-MOST, min(MOST, x)) for x in score], np.int64)
            near = ids != own
            if kth is not None:
                near &= score <= kth[0]
            if not near.any():
                continue
            score, ids = score[near], ids[near]
            if len(ids) > k:
                order = np.lexsort((ids, score))[:k]
                score, ids = score[order], ids[order]
            best = sorted([*best, *zip(score.tolist(), ids.tolist(), strict=True)])[:k]
            if len(best) == k and (kth is None or best[-1] < kth):
                kth = best[-1]
        return best


def most_scores(queries: np.ndarray, low: np.ndarray, high: np.ndarray, inexact: bool) -> np.ndarray:
    """The most that each query (row) can score with a point in each box (column); if inexact, with more than any rounding added."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        if inexact:
            most = most + (abs(queries) @ np.maximum(abs(low), abs(high)).T) * 2.0**-40
            most[np.isnan(most)] = np.inf
    return most


def inexact(*arrays: np.ndarray) -> bool:
    """Whether inner products of such numbers may not be exact in float64, which holds whole numbers below 2^53."""
    return max((abs(x).max() for x in arrays if x.size), default=0.0) ** 2 * max(x.shape[1] for x in arrays) >= 2**51


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component x as double, a whole number held as double; null for a vector that takes no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(float("inf"))))

    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)  # from 2^53 on a double is whole

    return F.when(good, F.transform(vector, whole))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.list_flatten(column).to_numpy()
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.list_value_length(column).to_numpy()
    out = np.zeros((len(column), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def _whole(matrix: np.ndarray) -> np.ndarray:
    return np.array([[int(y) for y in x] for x in matrix.tolist()], object).reshape(matrix.shape)


def coarse_splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(side, place) of the 2^depth - 1 inner nodes of a tree of median splits of the widest sides."""
    side, place = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    rows = [np.arange(len(sample))]
    for i in range(len(side)):
        own, rows[i] = rows[i], None
        if len(own):
            box = sample[own]
            side[i] = (box.max(0) - box.min(0)).argmax()
            order = own[np.argsort(box[:, side[i]], kind="stable")]
            place[i] = sample[order[len(order) // 2], side[i]]
            rows += [order[: len(order) // 2], order[len(order) // 2 :]]
        else:
            rows += [own, own]
    return side, place


def _dealt(vectors: DataFrame, n: int, width: int, depth: int, sample: int) -> DataFrame:
    """n vectors with `shard`, a table."""
    if not depth:
        return materialize(vectors.withColumn("shard", F.lit(0)), "vectors")
    some = vectors.where(F.shiftrightunsigned(F.xxhash64("vec_id"), 11) / F.lit(float(2**53)) < F.lit(min(1.0, sample / n))) if n > sample else vectors
    side, place = coarse_splits(_matrix(some.select("v").limit(2 * sample).toArrow().column("v"), width), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, ids = _matrix(batch.column("v"), width), batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.uint64)
            coin, node, every = ids * np.uint64(0x9E3779B97F4A7C15), np.zeros(len(points), np.int64), np.arange(len(points))
            coin ^= coin >> np.uint64(29)
            for level in range(depth):
                x, at = points[every, side[node]], place[node]
                right = np.where(x == at, (coin >> np.uint64(level)) & np.uint64(1) == 1, x > at)
                node = 2 * node + 1 + right
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node - (2**depth - 1), pa.int32())], [*batch.schema.names, "shard"])

    return materialize(vectors.mapInArrow(run, "vec_id long, v array<double>, asked boolean, shard int").repartition(2**depth, "shard"), "vectors")


def _boxes(dealt: DataFrame, width: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, low, high) of every shard that has vectors: at most a row a shard and task, as a shard lies in few files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for batch in batches:
            points, shard = _matrix(batch.column("v"), width), batch.column("shard").to_numpy(zero_copy_only=False)
            for k in np.unique(shard).tolist():
                own = points[shard == k]
                low[k] = np.minimum(low.get(k, np.inf), own.min(0))
                high[k] = np.maximum(high.get(k, -np.inf), own.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array(list(low.values()), pa.list_(pa.float64())), pa.array(list(high.values()), pa.list_(pa.float64()))], ["shard", "low", "high"])

    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, low, high in dealt.select("shard", "v").mapInArrow(run, "shard int, low array<double>, high array<double>").collect():
        a, b = found.get(k, (np.inf, -np.inf))
        found[k] = np.minimum(a, low), np.maximum(b, high)
    return [(k, *found[k]) for k in sorted(found)]


def _away(queries: DataFrame, boxes: list[tuple[int, np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """queries with `shard`, once for every shard but their home whose root box can better their kth result."""
    number = np.array([k for k, *_ in boxes])
    low, high = np.array([x for _, x, _ in boxes]).reshape(-1, width), np.array([x for *_, x in boxes]).reshape(-1, width)
    shared = queries.sparkSession.sparkContext.broadcast((number, low, high))  # SHARDS boxes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, low, high = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                wanted = _matrix(part.column("v"), width)
                kth = np.array([-np.inf if x is None else float(x) for x in part.column("kth_score").to_pylist()])
                home = part.column("home").to_numpy(zero_copy_only=False)
                rough = inexact(wanted, low, high)
                least = np.where(np.isfinite(kth) & (abs(kth) >= 2.0**53), kth - abs(kth) * 2.0**-50, kth)  # as a float may be rounded up
                i, j = np.nonzero((most_scores(wanted, low, high, rough) >= least[:, None]) & (number[None, :] != home[:, None]))
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(i)).columns, pa.array(number[j], pa.int32())], [*part.schema.names, "shard"])

    return queries.mapInArrow(run, "query_id long, v array<double>, home int, kth_score long, kth_id long, shard int")


def _round(vectors: DataFrame, queries: DataFrame, k: int, leaf: int) -> DataFrame:
    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        names, rows = ["query_id", "vec_id", "score"], ([], [], [])
        if points.num_rows and asked.num_rows:
            width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (points, asked))
            matrix, wanted = _matrix(points.column("v"), width), _matrix(asked.column("v"), width)
            rough = width > 0 and inexact(matrix, wanted)
            tree = KDTree(matrix, points.column("vec_id").to_numpy(), leaf, _whole(matrix) if rough else None)
            own, score, last = (asked.column(c).to_pylist() for c in ("query_id", "kth_score", "kth_id"))
            for at in range(0, len(own), 256):
                bounds = tree.bounds(wanted[at : at + 256])
                exact = _whole(wanted[at : at + 256]) if rough else wanted[at : at + 256]
                for i in range(at, min(at + 256, len(own))):
                    kth = None if score[i] is None else (-score[i], last[i])
                    best = tree.search(exact[i - at], bounds[i - at], own[i], k, kth)
                    rows[0].extend([own[i]] * len(best))
                    rows[1].extend(v for _, v in best)
                    rows[2].extend(-int(s) for s, _ in best)
        return pa.table([pa.array(x, pa.int64()) for x in rows], names)

    # both come from one table: columns named anew keep the two apart
    vectors = vectors.select(*[F.col(c).alias(c) for c in ("shard", "block", "vec_id", "v")])
    queries = queries.select(*[F.col(c).alias(c) for c in ("shard", "block", "query_id", "v", "kth_score", "kth_id")])
    return vectors.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(table: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row where is_query holds, against all rows."""
    vectors = table.select(table[key].cast("long").alias("vec_id"), quantized(table[vector]).alias("v"), is_query.alias("asked")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    n, asked, width = vectors.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(F.size("v"))).first()
    depth = max(0, min(SHARDS, -(-n // shard_rows)) - 1).bit_length()
    blocks, width = max(1, -(-(asked or 0) // block_queries)), width or 0
    vectors = _dealt(vectors, n, width, depth, sample)
    queries = vectors.where("asked").groupBy("vec_id").agg(F.min(F.struct("v", "shard")).alias("least")).select(F.col("vec_id").alias("query_id"), "least.v", F.col("least.shard").alias("home"))
    none = F.lit(None).cast("long")
    home = queries.select("query_id", "v", F.col("home").alias("shard"), F.lit(0).alias("block"), none.alias("kth_score"), none.alias("kth_id"))
    first = _round(vectors.withColumn("block", F.lit(0)), home, k, leaf)
    if not depth:
        return _ranked(first, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    first = materialize(first, "home")
    kth = _ranked(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
    away = _away(queries.join(kth, "query_id", "left").select("query_id", "v", "home", "kth_score", "kth_id"), _boxes(vectors, width), width)
    away = away.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    second = _round(vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), away, k, leaf)
    return _ranked(first.unionByName(second), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
