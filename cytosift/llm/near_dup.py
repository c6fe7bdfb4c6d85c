"""MinHash near-dedup with an LSH forest.

1. One pass over the texts makes each document's set of hashed word shingles, its digest, and a signature of HASHES minima.
   Documents with one set form a class, of which one represents all.
2. The forest has TREES sorted orders of the signatures: order t is that of the signature rotated by t * DEPTH positions.
   A region of an order is a run with a common prefix of at least DEPTH values, and is sorted by that order. Its neighbours, which
   have the longest common prefixes, are compared by signature first, then the runs of linked neighbours among each other.
   A region of over REGION members is divided by prefixes doubled until its parts are small enough; what of it these
   parts don't join into one component is then peeled (below), so that depth loses no pair. What comes out is a
   spanning forest of the candidate graph (signatures agree in AGREE positions at least), not its pairs.
3. The components of the candidate graph are the clusters. Each cluster's texts are read once more, and every pair of its
   members that is not yet in one component is decided on full sets. Clusters over CLUSTER members or
   CLUSTER_SHINGLES shingles are peeled too.

Peeling: the members of a large group are dealt into blocks, and a few leaders are compared with all of every block, which joins most
near copies into one component. Leaders of what is left follow, for PEELS rounds at most. Then the rest, the members outside
the largest component, is compared in blocks with all members. Each round has as many rows as members, and
so has the end where the rest fits one block; no pair within the largest component is looked at again.

With 24 orders of depth 4 a pair of similarity 0.8 shares no region with probability (1 - 0.8^4)^24 = 3e-6, and has
signatures that agree in under 60 of 96 places with probability 2.2e-5.

Cases: null texts and texts without words have an empty set and no link; texts of fewer words than a shingle have one
shingle, the whole sequence; long texts are taken whole; repeated rows fall in one class; keys may be null or repeated
(rows are then numbered); an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, by_batches, keyed, materialize
from .components import connected_components

HASHES, TREES, DEPTH = 96, 24, 4
AGREE = 60
REGION = 2048
CLUSTER = 4096
#: Shingles of one unit of exact comparison, which bounds its memory whatever the length of the texts.
CLUSTER_SHINGLES = 4_000_000
LEADERS, PEELS = 16, 3
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 2**31, HASHES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)
_WORD = _rng.integers(1, 2**62, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z in lower case."""
    found = text.lower().split()  # of bytes: at 0x20 and 0x09-0x0D alone
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    k = min(words, n)
    out = np.full(n - k + 1, k * 0x9E3779B1, np.uint64)
    for i in range(k):
        out += hashed[i : n - k + 1 + i] * _WORD[i]
    out ^= out >> np.uint64(31)
    out *= _WORD[-1]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> bytes:
    low = found.astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 2048):
        least = np.minimum(least, (low[i : i + 2048, None] * _A + _B).min(0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def _sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = [], [], []
            for x in batch.column("text").cast(pa.binary()):
                own = shingles(x.as_buffer().to_pybytes() if x.is_valid else b"", words)
                n.append(len(own))
                digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sig.append(signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["row", "n", "digest", "sig"])

    return by_batches(docs.select(docs[key].alias("row"), docs[text].alias("text"))).mapInArrow(run, f"row {kind}, n long, digest binary, sig binary")


def _turned():
    """Each tree's rotated signature."""
    return F.concat(F.expr(f"substring(sig, 1 + {2 * DEPTH} * tree)"), F.expr(f"substring(sig, 1, {2 * DEPTH} * tree)"))


def _prefix(depth: int):
    """The hashed prefix of each tree's rotated signature."""
    return F.xxhash64("tree", F.lit(depth), _turned().substr(1, 2 * depth))


def _members(reps: DataFrame, region: int) -> tuple[DataFrame, DataFrame | None]:
    """(unit, row, tree) of regions of 2 to `region` rows, each at the least depth that makes it so small; and
    (unit, row, tree, m) of the larger regions of depth DEPTH, if there are any."""
    level = reps.select("row", "sig", F.explode(F.expr(f"sequence(0Y, {TREES - 1}Y)")).alias("tree"))
    keys = level.select("row", "tree", _prefix(DEPTH).alias("unit"))
    counts = materialize(keys.groupBy("unit").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "regions")
    members = keys.join(counts, "unit")
    out = members.where(F.col("m") <= region).select("unit", "row", "tree")
    dense = counts.where(F.col("m") > region)
    depth = DEPTH
    if dense.isEmpty():
        return out, None
    tied = members.where(F.col("m") > region).select("unit", "row", "tree", "m")
    large = tied
    while not dense.isEmpty() and depth < HASHES:
        depth = min(2 * depth, HASHES)
        tied = materialize(tied.select("row", "tree").join(reps.select("row", "sig"), "row").select("row", "tree", _prefix(depth).alias("unit")), "deeper")
        counts = tied.groupBy("unit").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        deeper = tied.join(counts, "unit")
        out = out.union(deeper.where(F.col("m") <= region).select("unit", "row", "tree"))
        tied = deeper.where(F.col("m") > region)
        dense = counts.where(F.col("m") > region)
    return out, large


def _opened(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the units that the components found so far (node, root) leave open: members with `known`, a member's component, and the unit's
    `largest`, `m` members, and `r` of them outside the largest; and a row for each such unit."""
    known = members.join(found.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("known", F.xxhash64(F.coalesce("root", "row"))).drop("root")
    sizes = known.groupBy("unit", "known").agg(F.count(F.lit(1)).alias("n"))
    units = sizes.groupBy("unit").agg(F.max(F.struct("n", "known")).alias("best"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    units = materialize(units.select("unit", F.col("best.known").alias("largest"), "m", (F.col("m") - F.col("best.n")).alias("r")), "open")
    return materialize(known.join(bounded_broadcast(units, units.count()), "unit"), "left"), units


def _of_blocks(rows: DataFrame, blocks: Column | str) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("row", "unit"), F.greatest(F.lit(1), F.ceil(blocks))).cast("int"))


def peeled(members: DataFrame, found: DataFrame, link: Callable[[DataFrame], DataFrame], rounds: int = PEELS) -> DataFrame:
    """members (unit, row, blocks, ...) of large units, and the components found so far (node, root) -> components that `link`'s links of all
    pairs within a unit would give. link takes (unit, row, known, ...) of small units; a unit's block count is `blocks`."""

    def joined(found: DataFrame, units: DataFrame) -> DataFrame:
        return connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(link(units)))

    def spread(rows: DataFrame, blocks: Column) -> DataFrame:
        return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(blocks)).cast("int") - 1)))

    for number in range(rounds):
        left, units = _opened(members, found)
        if not left.where(F.col("r") * F.col("blocks") > F.col("m")).head(1):
            break
        rest = left.where("known <> largest")
        rank = F.row_number().over(Window.partitionBy("unit").orderBy(F.xxhash64("row", F.lit(number))))
        leaders = materialize(rest.withColumn("rank", rank).where(F.col("rank") <= LEADERS).drop("rank"), "leaders")
        few = bounded_broadcast(leaders.select("unit", "row"), leaders.count())
        others = _of_blocks(left.join(few, ["unit", "row"], "left_anti"), "blocks")
        everywhere = spread(leaders, F.col("blocks")).withColumnRenamed("other", "block")
        found = joined(found, others.unionByName(everywhere).withColumn("unit", F.xxhash64("unit", "block")).drop("block", "blocks", "largest", "m", "r"))
    else:
        left, units = _opened(members, found)
    if units.isEmpty():
        return found
    # the rest in blocks of its own, in pairs with each other and with the blocks of the largest component
    share = F.col("blocks") * F.col("r") / F.col("m")
    rest, body = _of_blocks(left.where("known <> largest"), share), _of_blocks(left.where("known = largest"), F.col("blocks") - share)
    within = spread(rest, share).withColumn("unit", F.xxhash64("unit", F.lit(0), F.least("block", "other"), F.greatest("block", "other")))
    to_body = spread(rest, F.col("blocks") - share).withColumn("unit", F.xxhash64("unit", F.lit(1), "block", "other"))
    of_body = spread(body, share).withColumn("unit", F.xxhash64("unit", F.lit(1), "other", "block"))
    return joined(found, within.union(to_body).union(of_body).drop("block", "other", "blocks", "largest", "m", "r"))


def _ordered(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(unit, row, sig[, known]): units whole, each in the order of its tree's rotated signature, which sig is."""
    joined = members.join(reps.select("row", "sig"), "row").withColumn("sig", _turned())
    joined = joined.select("unit", "row", "sig", *(["known"] if "known" in members.columns else []))
    return joined.repartition("unit").sortWithinPartitions("unit", "sig")


def _forest_links(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): in each unit, a spanning forest of the pairs whose signatures agree, without what `known` has linked."""
    kind = reps.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows, sig, known in _whole_units(batches):
            near = (unit[1:] == unit[:-1]) & ((sig[1:] == sig[:-1]).sum(1) >= AGREE)
            starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            a = [np.flatnonzero(near)]
            b = [a[0] + 1]
            for s, n in zip(starts, np.diff(np.append(starts, len(unit))), strict=True):
                if n > 2 and not near[s : s + n - 1].all():
                    for x, y in spanning(sig[s : s + n], near[s : s + n - 1], None if known is None else known[s : s + n]):
                        a.append(np.full(len(y), s + x))
                        b.append(s + y)
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(a)), rows.take(pa.array(b))], ["a", "b"])

    return _ordered(members, reps).mapInArrow(run, f"a {kind}, b {kind}").distinct()


def spanning(sig: np.ndarray, near: np.ndarray, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(x, one y of each group found from x): breadth-first over the rows whose signatures agree. The groups to begin with are the runs of
    linked neighbours (near: whether a row is linked with the next), joined where known is equal; each is found once."""
    group = np.concatenate(([0], np.cumsum(~near)))
    if known is not None:
        run, (_, own) = group, np.unique(known, return_inverse=True)
        while True:  # the least group of a run, then of a component, until none changes
            before = group
            for key in (own, run):
                least = np.full(key.max() + 1, len(sig))
                np.minimum.at(least, key, group)
                group = least[key]
            if (group == before).all():
                break
    left = np.arange(len(sig))
    queue: list[int] = []
    at = 0
    while len(left):
        if at == len(queue):
            first = group[left] == group[left[0]]
            queue, at = left[first].tolist(), 0
            left = left[~first]
            continue
        x = queue[at]
        at += 1
        hit = left[(sig[left] == sig[x]).sum(1) >= AGREE]
        if len(hit):
            groups, once = np.unique(group[hit], return_index=True)
            yield x, hit[once]
            found = np.isin(group[left], groups)
            queue.extend(left[found].tolist())
            left = left[~found]


def _candidates(reps: DataFrame, region: int) -> DataFrame:
    """(a, b): links whose components are those of the candidate graph."""
    members, large = _members(reps, region)
    links = _forest_links(members, reps)
    if large is None:
        return links
    large = large.withColumn("blocks", F.ceil(F.col("m") / F.lit(max(1, region // 2)))).drop("m")
    found = peeled(large, connected_components(links), lambda units: _forest_links(units, reps))
    return found.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray | None]]:
    """Sorted batches cut anew where a unit ends: (unit, row, signatures, known or None)."""
    held: list[pa.RecordBatch] = []

    def arrays(part: pa.RecordBatch):
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
        known = part.column("known").to_numpy(zero_copy_only=False) if "known" in part.schema.names else None
        return part.column("unit").to_numpy(zero_copy_only=False), part.column("row"), sig, known

    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column("unit").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(unit, unit[-1]))
        if cut or (held and held[-1].column("unit")[-1].as_py() != unit[0]):
            yield arrays(pa.concat_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield arrays(pa.concat_batches(held))


def exact_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component numbers of sorted distinct sets, linked where 100 * intersection >= percent * union."""
    m = len(sets)
    label = np.arange(m)
    size = np.fromiter(map(len, sets), np.int64, m)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * both >= percent * (size.sum() - both):
            label[1] = 0
        return label
    distinct, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(label, size)
    common = np.bincount(inverse, minlength=len(distinct)) > 1
    # what no other member has cannot be in an intersection; a member with too much of it has no link
    shared = np.bincount(owner, common[inverse], m)
    able = 100 * shared >= percent * size
    keep = common[inverse] & able[owner]
    inverse, owner = inverse[keep], owner[keep]
    start = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=m))))
    open_ = able.copy()
    mark = np.zeros(len(distinct), bool)
    live_item, live_owner, since = inverse, owner, 0
    for seed in np.flatnonzero(able):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue, at = [seed], 0
        while at < len(queue) and open_.any():
            x = queue[at]
            at += 1
            own = inverse[start[x] : start[x + 1]]
            mark[own] = True
            both = np.bincount(live_owner[mark[live_item]], minlength=m)
            mark[own] = False
            hit = np.flatnonzero(open_ & (100 * both >= percent * (size[x] + size - both)))
            label[hit] = seed
            open_[hit] = False
            queue.extend(hit.tolist())
            since += len(hit)
            if since > 32:  # members already placed need no more counting
                alive = open_[live_owner]
                live_item, live_owner, since = live_item[alive], live_owner[alive], 0
    return label


def _exact_links(units: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int, broadcast: bool) -> DataFrame:
    """(row, root): within each unit every member that has links, with one member of its component."""
    kind = docs.schema[key].dataType.simpleString()
    if broadcast:
        units = F.broadcast(units)
    joined = docs.select(docs[key].alias("row"), docs[text].alias("text")).join(units, "row").repartition("unit").sortWithinPartitions("unit", "row").select("unit", "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, sets = None, [], []

        def solved():
            label = exact_components(sets, percent)
            moved = [i for i in range(len(rows)) if label[i] != i]
            return pa.RecordBatch.from_arrays([pa.array([rows[i] for i in moved], kind_), pa.array([rows[label[i]] for i in moved], kind_)], ["a", "b"])

        for batch in batches:
            kind_ = batch.column("row").type
            for u, r, x in zip(batch.column("unit").to_pylist(), batch.column("row").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                if u != unit:
                    if len(rows) > 1:
                        yield solved()
                    unit, rows, sets = u, [], []
                rows.append(r)
                sets.append(shingles(x.as_buffer().to_pybytes(), words))
        if len(rows) > 1:
            yield solved()

    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, region: int = REGION, cluster: int = CLUSTER) -> tuple[DataFrame, DataFrame, str]:
    """(table of row, n, root, docs with a row column, its name): root is one row of each document's component."""
    docs, row, _ = keyed(docs, key)
    sketch = materialize(_sketches(docs, row, text, words), "sketch")
    classes = sketch.where("n > 0").groupBy("digest").agg(F.min("row").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = materialize(classes, "classes")
    reps = classes.select(F.col("rep").alias("row"), "sig")
    clusters = connected_components(_candidates(reps, region))
    clusters = clusters.union(clusters.select(F.col("root").alias("node"), "root").distinct()).select(F.xxhash64("root").alias("unit"), F.col("node").alias("row"))
    clusters = materialize(clusters.join(classes.select(F.col("rep").alias("row"), "n"), "row").select("unit", "row", "n"), "clusters")
    sizes = clusters.groupBy("unit").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(2 * F.col("m") / F.lit(cluster)), F.ceil(2 * F.col("shingles") / F.lit(CLUSTER_SHINGLES))).cast("int")
    large = materialize(sizes.where((F.col("m") > cluster) | (F.col("shingles") > CLUSTER_SHINGLES)).select("unit", blocks.alias("blocks")), "large")

    def link(units: DataFrame) -> DataFrame:
        units = materialize(units.select("unit", "row"), "units")
        return _exact_links(units, docs, row, text, words, percent, bounded_broadcast(units, units.count()) is not units)

    few = bounded_broadcast(large, large.count())
    if large.isEmpty():
        labels = materialize(link(clusters), "exact").select(F.col("a").alias("rep"), F.col("b").alias("root"))
    else:
        found = connected_components(link(clusters.join(few.select("unit"), "unit", "left_anti")))
        members = materialize(clusters.join(few, "unit").select("unit", "row", "blocks"), "large_clusters")
        labels = found.union(peeled(members, found.limit(0), link)).select(F.col("node").alias("rep"), "root")
    rooted = classes.select("digest", "rep").join(labels, "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    bare = sketch.where("n = 0").select("row", "n", F.col("row").alias("root"))  # else all of them would meet at one null digest
    rooted = sketch.where("n > 0").select("row", "n", "digest").join(rooted, "digest").select("row", "n", "root").union(bare)
    return rooted, docs, row


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, region: int = REGION, cluster: int = CLUSTER) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the least key of its component), kept (key = component_id)."""
    rooted, docs, row = near_components(docs, key, text, words, percent, region, cluster)
    if row != key:
        rooted = rooted.join(docs.select(docs[row].alias("row"), docs[key].alias("key")), "row")
    else:
        rooted = rooted.withColumn("key", F.col("row"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("key").alias("component_id"), F.count(F.lit(1)).alias("members")).where("members > 1")
    least = materialize(least.select("root", "component_id"), "components")  # a table, so that the join can split a hot root
    whole = rooted.join(bounded_broadcast(least, least.count()), "root", "left").withColumn("component_id", F.coalesce("component_id", "key"))
    return whole.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.equal_null("key", "component_id").alias("kept"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component (that of the least key, of repeated ones the first row), with their columns as they are."""
    rooted, docs, row = near_components(docs, key, text, words, percent)
    if row != key:
        rooted = rooted.join(docs.select(docs[row].alias("row"), docs[key].alias("key")), "row")
    else:
        rooted = rooted.withColumn("key", F.col("row"))
    rooted = materialize(rooted, "rooted")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("best"), F.count(F.lit(1)).alias("members")).where("members > 1")
    best = materialize(best, "components")
    gone = rooted.join(bounded_broadcast(best, best.count()), "root").where(F.col("best.row") != F.col("row")).select(F.col("row").alias(row))
    gone = materialize(gone, "near_copies")
    kept = docs.join(bounded_broadcast(gone, gone.count()), row, "left_anti")
    return kept.drop(row) if row != key else kept
