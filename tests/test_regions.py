"""Interval joins over regions of every part row, against brute force: on all contigs, with gaps."""

import os
import random

import pytest
from cytosift.operators import intervals
from cytosift.operators.intervals import overlap_join, reads_in_regions, region_of_positions, run_lengths
from cytosift.plans import registry
from cytosift.sources import synth
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_regions_of_every_part(spark):
    part = spark.createDataFrame([(k, 1 + k % 50) for k in range(1, 2001)], "p_partkey long, p_size int")
    rows = synth.regions(part).collect()
    assert len(rows) == 2000 and {(r.chrom, r.strand) for r in rows} == {(f"chr{c}", s) for c in range(1, 6) for s in range(3)}
    for c in range(1, 6):
        covered = {p for r in rows if r.chrom == f"chr{c}" for p in range(r.start, r.end)}
        assert all(covered & set(range(k, k + 600)) for k in range(0, 4000, 1000)) and not covered & {p for p in range(4000) if p % 1000 >= 670}


def test_joins_keep_contigs_apart(spark):
    regions = synth.regions(spark.createDataFrame([(k, k) for k in range(1, 41)], "p_partkey long, p_size int"))
    all_regions = [tuple(r) for r in regions.select("chrom", "start", "end", "strand").collect()]
    reads = [(i, f"chr{i % 5 + 1}", p := i * 17 % 3910, p + 40) for i in range(400)]
    got = reads_in_regions(spark.createDataFrame(reads, "read_id long, chrom string, pos long, ref_end long"), regions).collect()
    want = {r[0] for r in reads if any(c == r[1] and r[2] < e and s < r[3] for c, s, e, _ in all_regions)}
    assert sorted(r.read_id for r in got) == sorted(want) and {r.chrom for r in got} == {f"chr{c}" for c in range(1, 6)} and len(want) < 400
    at = [(f"chr{c}", p) for c in range(1, 6) for p in range(0, 4000, 3)]
    found = region_of_positions(spark.createDataFrame(at, "chrom string, pos long"), regions).collect()
    first = {(c, p): min(((s, e, k) for x, s, e, k in all_regions if x == c and s <= p < e), default=None) for c, p in at}
    assert sorted(map(tuple, found)) == sorted((c, p, x[2]) for (c, p), x in first.items() if x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["bed_read_semijoin", "bed_position", "bed_stranded"])
def test_queries_reach_every_contig(spark, name):
    assert {r.chrom for r in registry.QUERIES[name](spark, SF).select("chrom").distinct().collect()} == {f"chr{c}" for c in range(1, 6)}


LENGTHS = (1, 40, 255, 256, 257, 3000, 5000, 70_000, 2_000_000)


def mixed(seed, n):
    r = random.Random(seed)
    return [(i % (n - 20), f"chr{r.randint(1, 2)}", p := r.randint(0, 300_000), p + r.choice(LENGTHS)) for i in range(n)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_intervals_of_any_length_meet_once(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(intervals, "BROADCAST_ROWS", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = mixed(1, 300), mixed(2, 80)
        reads = spark.createDataFrame(left, "read_id long, chrom string, pos long, ref_end long")  # some ids twice
        regions = spark.createDataFrame([(c, s, e, i % 3) for i, c, s, e in right], "chrom string, start long, end long, strand int")
        hits = reads_in_regions(reads, regions)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == broadcast and "SortAggregate" not in plan and "NestedLoop" not in plan
        over = lambda a, b: a[1] == b[1] and a[2] < b[3] and b[2] < a[3]
        assert sorted(map(tuple, hits.collect())) == sorted(x for x in left if any(over(x, y) for y in right))
        pairs = overlap_join(reads, regions.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end")), "pos", "ref_end")
        assert sorted((r.read_id, r.pos, r.ref_end, r.r_start, r.r_end) for r in pairs.collect()) == sorted((a[0], a[2], a[3], b[2], b[3]) for a in left for b in right if over(a, b))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_regions_of_whole_contigs_are_not_broadcast(spark):
    rows = spark.createDataFrame([(f"chr{c}", 0, 100_000_000) for c in range(25)], "chrom string, r_start long, r_end long")
    assert "broadcast" not in intervals.in_bins(rows)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in intervals.in_bins(rows.limit(1).withColumn("r_end", F.col("r_start") + 900))._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("chunk", [100, 1000, 1 << 22])
def test_run_lengths_over_chunk_edges(spark, chunk):
    r = random.Random(chunk)
    rows, want = [], []
    for c in ("a", "b"):
        at = 0
        while at < 5000:
            n, v = r.choice((1, 30, 90, 600)), r.randint(0, 1)
            if r.random() < 0.1:
                at += 7  # a gap
            rows.append((c, at, at + n, v))
            at += n
        runs = []
        for _, s, e, v in [x for x in rows if x[0] == c]:
            if runs and runs[-1][2] == s and runs[-1][3] == v:
                runs[-1][2] = e
            else:
                runs.append([c, s, e, v])
        want += [(c, k, min(e, k + 70), v) for c, s, e, v in runs for k in range(s, e, 70)]
    got = run_lengths(spark.createDataFrame(rows, "chrom string, start long, end long, value int").repartition(3), 70, chunk)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("chunk", [64, 1 << 22])
def test_reads_meet_united_regions(spark, monkeypatch, chunk):
    """Nested, repeated and touching regions, also over edges of chunks, and reads of no length; what is joined is no longer a row for each region."""
    monkeypatch.setattr(intervals, "START_CHUNK", chunk)
    r = random.Random(chunk)
    spans = [(f"chr{r.randint(1, 2)}", s := r.randint(0, 900), s + r.choice((1, 5, 40, 130))) for _ in range(60)] + [("chr3", 10, 20), ("chr3", 20, 30), ("chr3", 25, 25)]
    regions = spark.createDataFrame(spans * 30, "chrom string, start long, end long")
    reads = [(i, f"chr{r.randint(1, 3)}", p := r.randint(0, 1000), p + r.choice((0, 1, 30))) for i in range(500)] + [(500, "chr3", 20, 20), (501, "chr3", 15, 15)]
    got = reads_in_regions(spark.createDataFrame(reads, "read_id long, chrom string, pos long, ref_end long"), regions)
    want = {i for i, c, p, e in reads if any(c == x and p < b and a < e for x, a, b in spans if a < b)}
    assert sorted(x.read_id for x in got.collect()) == sorted(want) and 501 in want and 500 not in want
    found = intervals.united(regions.selectExpr("chrom", "start AS r_start", "end AS r_end")).collect()
    assert len(found) < 60 and {("chr3", 10, 20), ("chr3", 20, 30)} <= set(map(tuple, found))


def test_large_region_tables_are_not_broadcast_by_estimate(spark, monkeypatch, tmp_path):
    """Spark takes a table of regions for as small as its file, which the cut into bins makes many times larger."""
    spark.createDataFrame([("chr1", 10 * i, 10 * i + 5) for i in range(50)], "chrom string, start long, end long").write.parquet(str(tmp_path / "regions"))
    reads = spark.createDataFrame([(1, "chr1", 3, 8)], "read_id long, chrom string, pos long, ref_end long")
    monkeypatch.setattr(intervals, "BROADCAST_ROWS", 100)
    hits = reads_in_regions(reads, spark.read.parquet(str(tmp_path / "regions")))
    assert [x.read_id for x in hits.collect()] == [1] and "BroadcastHashJoin" not in hits._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [64, 1 << 22])
def test_positions_meet_first_regions(spark, monkeypatch, chunk):
    """No position is in two of the regions that are joined, however many overlap, and its strand is that of the first, also from earlier chunks."""
    monkeypatch.setattr(intervals, "START_CHUNK", chunk)
    r = random.Random(chunk)
    spans = [(f"chr{r.randint(1, 2)}", s := r.randint(0, 900), s + r.choice((1, 5, 40, 300)), r.randint(0, 2)) for _ in range(200)] + [("chr3", 5, 5, 1), ("chr1", 0, 700, 2), ("chr1", 0, 700, 1)]
    regions = spark.createDataFrame(spans * 4, "chrom string, start long, end long, strand int")
    at = [(f"chr{c}", p) for c in range(1, 4) for p in range(0, 1250)]
    want = {(c, p): min(x)[2] for c, p in at if (x := [(s, e, k) for d, s, e, k in spans if d == c and s <= p < e])}
    found = region_of_positions(spark.createDataFrame(at, "chrom string, pos long"), regions)
    assert sorted(map(tuple, found.collect())) == sorted((c, p, k) for (c, p), k in want.items())
    cut = intervals.firsts(regions.selectExpr("chrom", "start AS r_start", "end AS r_end", "strand AS r_strand")).collect()
    held = [(x.chrom, p) for x in cut for p in range(x.r_start, x.r_end)]
    assert len(held) == len(set(held)) and set(held) == set(want)
