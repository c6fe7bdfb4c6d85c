"""The forest's sorted orders: neighbours of the rotated signature first, and blocks only for what depth leaves open."""

import numpy as np
from cytosift.llm import near_dup
from pyspark.sql import functions as F


def signatures(spark, rows):
    return spark.createDataFrame([(i, bytearray(x.astype("<u2").tobytes())) for i, x in enumerate(rows)], "row long, sig binary")


def test_units_lie_in_their_trees_order(spark):
    rows = np.random.default_rng(0).integers(0, 3, (60, near_dup.HASHES))
    members = spark.range(60).select(F.col("id").alias("row")).withColumn("tree", F.explode(F.array(F.lit(0), F.lit(5), F.lit(23)))).withColumn("unit", F.col("tree").cast("long"))
    got = near_dup._ordered(members, signatures(spark, rows)).collect()
    for tree in (0, 5, 23):
        turned = [np.roll(x, -near_dup.DEPTH * tree).astype("<u2").tobytes() for x in rows]
        assert [r.row for r in got if r.unit == tree] == sorted(range(60), key=lambda i: turned[i])


def test_spanning_joins_what_brute_force_joins():
    r = np.random.default_rng(1)
    for trial in range(30):
        base = r.integers(0, 60000, (6, near_dup.HASHES))
        sig = base[r.integers(0, 6, 40)]
        sig = np.where(r.random(sig.shape) < r.choice([0.05, 0.2, 0.25], (40, 1)), r.integers(0, 60000, sig.shape), sig)
        sig = sig[np.lexsort(sig.T[::-1])]
        agree = (sig[:, None] == sig[None]).sum(2) >= near_dup.AGREE
        near = agree[np.arange(39), np.arange(1, 40)]
        known = np.arange(40) if trial % 2 else np.where(r.random(40) < 0.3, 0, np.arange(40))

        def components(pairs):
            label = np.arange(40)
            for a, b in [*pairs, *((i, j) for i in range(40) for j in range(i) if known[i] == known[j])]:
                label[label == label[a]] = label[b]
            return label[:, None] == label[None]

        links = [(i, i + 1) for i in np.flatnonzero(near)] + [(x, y) for x, ys in near_dup.spanning(sig, near, known) for y in ys]
        assert all(agree[a, b] for a, b in links)
        assert (components(links) == components(np.argwhere(agree))).all()


def test_only_what_depth_leaves_open_is_peeled(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 60000, near_dup.HASHES)
    rows = np.repeat(base[None], 60, 0)
    rows[:, 60:] = r.integers(0, 60000, (60, 36))  # each shares 60 values with all others: trees 0 to 14 have one region of 60
    reps = signatures(spark, rows)
    members, large = near_dup._members(reps, 8)
    assert large.count() >= 60 * 12
    one = reps.select(F.col("row").alias("node"), F.lit(0).cast("long").alias("root"))
    assert near_dup._opened(large.drop("m"), one)[1].count() == 0
    left, units = near_dup._opened(large.drop("m"), one.where("node < 59"))
    assert left.select("row").distinct().count() == 60 and {(x.m, x.r) for x in units.collect()} == {(60, 1)}
    found = near_dup.connected_components(near_dup._candidates(reps, 8)).collect()
    assert len(found) == 59 and {x.root for x in found} == {0}


def test_a_large_group_is_peeled_in_rows_linear_in_it(spark):
    m, limit, alone = 200_000, 2048, 40_000
    members = spark.range(m).select(F.lit(7).cast("long").alias("unit"), F.col("id").alias("row"), F.lit(-(-m // (limit // 2))).alias("blocks"))
    seen = []

    def link(units):  # all near copies of one another, but for every 40,000th row
        sizes = units.groupBy("unit").count()
        seen.append((units.count(), sizes.agg(F.max("count")).first()[0]))
        least = F.min(F.when(F.col("row") % alone != 0, F.col("row"))).over(near_dup.Window.partitionBy("unit"))
        return units.withColumn("least", least).where((F.col("row") % alone != 0) & (F.col("row") != F.col("least"))).select(F.col("row").alias("a"), F.col("least").alias("b"))

    none = spark.createDataFrame([], "node long, root long")
    got = near_dup.peeled(members, none, link)
    assert got.count() == m - 1 - m // alone and {r.root for r in got.select("root").distinct().collect()} == {1}
    assert sum(n for n, _ in seen) < 3 * m and max(x for _, x in seen) < 1.2 * limit


def test_pairs_of_every_part_of_a_large_group_meet(spark):
    members = spark.range(300).select((F.col("id") % 2).alias("unit"), F.col("id").alias("row"), F.lit(30).alias("blocks"))
    pairs = set()

    def link(units):
        rows = {}
        for r in units.collect():
            rows.setdefault(r.unit, []).append(r.row)
        assert all(len(v) == len(set(v)) for v in rows.values())
        pairs.update((a, b) for v in rows.values() for a in v for b in v if a < b)
        return spark.createDataFrame([(10, 12), (20, 12)], "a long, b long")

    near_dup.peeled(members, spark.createDataFrame([(i, 1) for i in range(3, 60, 2)], "node long, root long"), link, rounds=1)
    one = {1, *range(3, 60, 2)}
    assert all((a, b) in pairs for a in range(300) for b in range(a + 2, 300, 2) if not {a, b} <= one and not {a, b} <= {10, 12, 20})
