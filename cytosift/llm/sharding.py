"""Sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots, whose number never changes. Bytes are summed per slot, and a versioned
map from slot to shard, a small table, is edited when loads are uneven or shards are added: only the slots moved change. Where the
map's folder holds a version already, the latest one is read, edited and stored as the next, if the edit changes it at all; a version
once stored is never written again.

The law is `bytes`. Equal texts are not held together: a group of copies may hold a third of all bytes, which no law of near
equal sizes could then meet; so slots are those of (key, text).

Cases: a null key or text is hashed as such; a null text has no bytes (size 8); texts of any length are hashed whole and never cut, so a shard
is uneven by what one text exceeds its fair share; rows equal in key and text share a virtual slot, and are numbered in tasks of bounded size; an empty
table gives an empty one and a map of slots dealt in turn; slots of equal size are taken in order of their number; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, numbered

VIRTUAL_SLOTS = 8192
PASSES = 16


@dataclass(frozen=True)
class SlotMap:
    """shard[s] is the shard of virtual slot s. Edits return a map of the next version."""

    shard: tuple[int, ...]
    shards: int
    version: int = 0

    @classmethod
    def initial(cls, slots: int, shards: int) -> SlotMap:
        return cls(tuple(s % shards for s in range(slots)), shards)

    def rebalanced(self, size: np.ndarray) -> SlotMap:
        """Moves slots from the fullest to the emptiest shard, or swaps a pair of theirs, while that brings the two closer."""
        owner, size = np.array(self.shard, np.int64), np.asarray(size, np.int64)
        load = np.bincount(owner, size, self.shards).astype(np.int64)
        own = [np.flatnonzero((owner == k) & (size > 0)) for k in range(self.shards)]
        active = np.ones(self.shards, bool)  # a shard from which nothing can be moved to any use is left as it is
        for _ in range(64 * len(owner)):
            high, low = int(np.where(active, load, -1).argmax()), int(load.argmin())
            gap = load[high] - load[low]
            a, b = own[high], own[low]
            if not active[high] or gap < 2:
                break
            if not len(a):
                active[high] = False
                continue
            # what to move over: a slot of the fullest, less a slot of the emptiest or nothing
            back = np.concatenate(([-1], b))
            less = np.concatenate(([0], size[b]))
            order = np.argsort(less, kind="stable")
            want = size[a] - gap // 2
            at = np.searchsorted(less[order], want).clip(0, len(order) - 1)
            at = np.where((at > 0) & (abs(less[order][at - 1] - want) < abs(less[order][at] - want)), at - 1, at)
            moved = size[a] - less[order][at]
            i = int(abs(2 * moved - gap).argmin())
            if not 0 < moved[i] < gap:
                active[high] = False
                continue
            x, y = a[i], back[order][at[i]]
            owner[x] = low
            own[high], own[low] = a[a != x], np.append(b[b != y], x)
            if y >= 0:
                owner[y] = high
                own[high] = np.append(own[high], y)
            load[high] -= moved[i]
            load[low] += moved[i]
        return replace(self, shard=tuple(owner.tolist()), version=self.version + 1)

    def grown(self, size: np.ndarray) -> SlotMap:
        """One more shard, which takes slots, an equal part of the bytes, and no other slot moves."""
        owner, size = np.array(self.shard, np.int64), np.asarray(size, np.int64)
        n = self.shards + 1
        load = np.append(np.bincount(owner, size, self.shards).astype(np.int64), 0)
        share = int(size.sum()) // n
        for s in np.argsort(-size, kind="stable"):
            k = owner[s]
            if load[-1] + size[s] <= share and load[k] - size[s] >= share - size[s] // 2 and size[s]:
                owner[s], load[k], load[-1] = n - 1, load[k] - size[s], load[-1] + size[s]
        return SlotMap(tuple(owner.tolist()), n, self.version + 1)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, s, k) for s, k in enumerate(self.shard)], "version int, virtual_slot int, shard int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Adds this version as a folder of its own; earlier versions stay, and one that is there already is an error."""
        self.table(spark).select("virtual_slot", "shard", F.lit(self.shards).alias("shards")).coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @classmethod
    def versions(cls, spark: SparkSession, path: str) -> list[int]:
        """The versions stored at path whole (a write that was cut short leaves no _SUCCESS)."""
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
        found = top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(top)
        return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found or [])

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        version = cls.versions(spark, path)[-1] if version is None else version
        rows = sorted(tuple(r) for r in spark.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard", "shards").collect())
        return cls(tuple(shard for _, shard, _ in rows), rows[0][2], version)

    @classmethod
    def edited(cls, spark: SparkSession, path: str, slots: int, shards: int, size: np.ndarray) -> SlotMap:
        """The map at path, grown to `shards` and rebalanced for these sizes, each edit stored as a version; a first one if there is none."""
        if not cls.versions(spark, path):
            cls.initial(slots, shards).store(spark, path)
        current = cls.load(spark, path)
        if len(current.shard) != slots or current.shards > shards:
            raise ValueError(f"the map at {path} has {len(current.shard)} slots and {current.shards} shards; slots are fixed and shards are never taken away")
        while current.shards < shards:
            current = current.grown(size)
            current.store(spark, path)
        even = current
        for _ in range(PASSES):  # to where another edit changes nothing, so that a second run on the same records leaves the map alone
            before, even = even, replace(even.rebalanced(size), version=current.version + 1)
            if even.shard == before.shard:
                break
        if even.shard == current.shard:
            return current
        even.store(spark, path)
        return even


def slotted(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """(key, size, text_crc32, virtual_slot, row: a unique number)."""
    crc = F.coalesce(F.crc32(docs[text]), F.lit(0).cast("long"))
    return docs.select(docs[key].alias("key"), (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 8).cast("long").alias("size"), crc.alias("text_crc32")).withColumn("virtual_slot", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(slots)).cast("int")).withColumn("row", F.monotonically_increasing_id())


def totals(slim: DataFrame, slots: int = VIRTUAL_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rows) of each virtual slot: at most `slots` rows to the driver."""
    size, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for s, b, n in slim.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        size[s], rows[s] = b, n
    return size, rows


def shard_by_slots(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = VIRTUAL_SLOTS, store: str | None = None) -> DataFrame:
    """Every row's shard (law `bytes`: shard sizes near equal) and its place there, gapless from 0. store: the folder of the map, in which later
    runs find it; without one the map is kept with the intermediate tables, and serves this run only."""
    spark = docs.sparkSession
    slim = materialize(slotted(docs, key, text, slots), "slotted")
    size, rows = totals(slim, slots)
    current = SlotMap.edited(spark, store or new_path(spark, "slot_map"), slots, shards, size)
    # places are numbered within a virtual slot, and slots follow one another within their shard, so no task sees a whole shard
    base, filled = [0] * slots, [0] * shards
    for s, k in enumerate(current.shard):
        base[s], filled[k] = filled[k], filled[k] + int(rows[s])
    placed = spark.createDataFrame([(s, k, base[s]) for s, k in enumerate(current.shard)], "virtual_slot int, shard int, base long")
    return (
        numbered(slim, "virtual_slot", {int(s): int(rows[s]) for s in np.flatnonzero(rows)}, "row", "place")
        .join(F.broadcast(placed), "virtual_slot")  # as many rows as virtual slots
        .select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("virtual_slot").cast("int").alias("virtual_slot"), F.lit(current.version).alias("map_version"))
    )
