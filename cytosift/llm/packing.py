"""Best-fit packing by patterns.

Documents are tokenised once; those longer than a sequence are cut so that only the first piece may be shorter. All planning is done on
the histogram of piece lengths (at most `capacity` counters, whatever the size of the corpus): all patterns of two and three
lengths that fill a sequence as far as a last length can are enumerated, repeat counts are fitted to the histogram by non-negative least squares and
rounded down, and the residual lengths are packed best-fit decreasing. The plan is a bounded table of runs: the pieces of
length L with ranks a to b go to sequences s, s + 1, ... at offset o. Ranks are numbered in tasks of bounded size, however
many pieces have one length; a piece that fills a sequence needs none.

Cases: a null or empty text is the end id alone (length 1); a text of any length is cut, never truncated, runs of white space of
any length too (see ``tokens``); pieces of one length are interchangeable, so ties don't matter; repeated rows and null keys
are packed each on its own; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, materialize, numbered, slices
from .tokens import tokens

CAPACITY = 1024
ROUNDS = 300
#: Runs of one length that are looked through together.
STEP = 16


def pieces(docs: DataFrame, vocabulary: str, pattern: str, end: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """(key, piece, start, length, ids_crc32 and, if asked for, ids array<int>) of every row's pieces. Strings of added tokens get their ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(vocabulary, pattern, added)
        for part in slices(batches):
            rows: list[tuple] = []
            for i, x in enumerate(part.column("text").to_pylist()):
                ids = np.append(encode(x or "").astype("<u4"), np.uint32(end))
                cut = len(ids) % capacity or min(capacity, len(ids))
                bounds = [0, *range(cut, len(ids) + 1, capacity)]
                for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((i, n, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if with_ids else None))
            cols = list(zip(*rows, strict=True))
            out = [part.column("key").take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:5])]
            yield pa.RecordBatch.from_arrays(out + [pa.array(cols[5], pa.list_(pa.int32()))] * with_ids, ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"key {kind}, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return by_batches(docs.select(docs[key].alias("key"), docs[text].alias("text"))).mapInArrow(run, schema)


def patterns(have: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0: none) of those that occur: each length, and each pair of lengths with room for a third, with the largest that still fits."""
    lengths = np.flatnonzero(have)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros((0, 3), np.int64)
    a = lengths
    fit = np.searchsorted(lengths, capacity - a, "right") - 1
    two = np.stack([a, np.where(fit >= 0, lengths[fit], 0), 0 * a], 1)[fit >= 0]
    i, j = np.triu_indices(len(lengths))
    room = capacity - lengths[i] - lengths[j]
    ok = room >= lengths[0]
    i, j, room = i[ok], j[ok], room[ok]
    three = np.stack([lengths[i], lengths[j], lengths[np.searchsorted(lengths, room, "right") - 1]], 1)
    found = np.sort(np.concatenate([two, three]), 1)
    name = np.unique((found[:, 2] * (capacity + 1) + found[:, 1]) * (capacity + 1) + found[:, 0])
    return np.stack([name // (capacity + 1) ** 2, name // (capacity + 1) % (capacity + 1), name % (capacity + 1)], 1)


def repeats(found: np.ndarray, have: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that brings the patterns' use of each length closest to the histogram (least squares, by multiplicative steps)."""
    if not len(found):
        return np.zeros(0)
    n = len(have)
    flat, used = found.ravel(), (found.ravel() > 0).astype(float)
    weight = 1 / np.maximum(have, 1)  # relative to each count, else rare lengths are left over
    target = (have * weight)[flat].reshape(found.shape) * (found > 0)
    up = (target * weight[found]).sum(1)
    x = np.full(len(found), have.sum() / max(1, 3 * len(found)))
    for _ in range(rounds):
        use = np.bincount(flat, np.repeat(x, found.shape[1]) * used, n) * weight**2
        down = (use[flat].reshape(found.shape) * (found > 0)).sum(1)
        x = x * up / np.maximum(down, 1e-12)
    return x


def plan(have: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) that place have[L] pieces of every length L."""
    left = have.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros(len(have), np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def use(lengths: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length in lengths:
            runs.append((length, int(taken[length]), times, sequence, offset))
            taken[length] += times
            left[length] -= times
            offset += length
        sequence += times

    if left[capacity]:
        use([capacity], int(left[capacity]))
    found = patterns(left, capacity)
    fitted = np.floor(repeats(found, left)).astype(np.int64)
    for k in np.argsort(-fitted, kind="stable"):
        lengths = [int(x) for x in found[k] if x]
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(fitted[k]), *(int(left[x]) // n for x, n in need.items()))
        if fitted[k] <= 0:
            break
        if times > 0:
            use(lengths, times)
    # residual: best-fit decreasing on the histogram; a filling is repeated while its lengths last
    while (rest := np.flatnonzero(left)).size:
        filling, room, spare = [], capacity, left.copy()
        while (k := int(np.searchsorted(rest, room, "right"))) > 0:
            fits = rest[:k][spare[rest[:k]] > 0]
            if not len(fits):
                break
            best = int(fits[-1])
            # two that fill the room exactly are better than the largest that leaves a gap
            if best != room and len(fits) > 1:
                other = room - fits
                good = (other > 0) & (other < len(spare)) & (spare[np.clip(other, 0, len(spare) - 1)] > (other == fits))
                if good.any() and filling:
                    best = int(fits[good][-1])
            filling.append(best)
            spare[best] -= 1
            room -= best
        use(filling, min(int(left[x]) // filling.count(x) for x in set(filling)))
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; `cut` must be a table, as it is read three times, and its column `row` unique."""
    spark = cut.sparkSession
    have = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").agg(F.count(F.lit(1))).collect():  # capacity rows at most
        have[length] = n
    # a piece of full length is a sequence of its own, numbered after all others by its row
    have[capacity] = 0
    runs = plan(have, capacity)
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("row") + max((s + n for _, _, n, s, _ in runs), default=0), "offset": F.lit(0).cast("long")})
    own: dict[int, list[tuple]] = {}
    for length, first, n, sequence, offset in runs:
        own.setdefault(length, []).append((first, first + n, sequence, offset))
    # one row a length: its runs in order of rank, STEP at a time; the plan's size follows the capacity, not the corpus
    kind = "struct<first:long,last:long,runs:array<struct<first:long,last:long,sequence:long,offset:long>>>"
    listed = [(k, [(v[i][0], v[min(i + STEP, len(v)) - 1][1], v[i : i + STEP]) for i in range(0, len(v), STEP)]) for k, v in ((k, sorted(v)) for k, v in own.items())]
    listed = F.broadcast(spark.createDataFrame(listed, f"length long, steps array<{kind}>"))
    ranked = numbered(cut.where(F.col("length") < capacity), "length", {int(k): int(have[k]) for k in np.flatnonzero(have)}, "row")
    step = F.expr("filter(steps, s -> rank >= s.first AND rank < s.last)[0].runs")
    placed = ranked.join(listed, "length").withColumn("run", step).withColumn("run", F.expr("filter(run, r -> rank >= r.first AND rank < r.last)[0]"))
    placed = placed.withColumns({"sequence_id": F.expr("run.sequence + rank - run.first"), "offset": F.col("run.offset")}).select(*full.columns)
    return full.union(placed).drop("row")


def packed_documents(docs: DataFrame, vocabulary: str, pattern: str, end: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    cut = pieces(docs, vocabulary, pattern, end, capacity, key, text, with_ids, added)
    return pack(materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity).withColumnRenamed("key", key)
