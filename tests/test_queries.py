"""Every query of the engine against its SQL on the smallest tables, and what plans should look like."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from cytosift.operators.sites import binned, sites
from cytosift.options import ExtractOptions, ReadOptions
from cytosift.plans import extract as ex
from cytosift.plans import file_queries, registry  # noqa: F401
from cytosift.sources import synth
from cytosift.streaming import site_counts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def tidy(row):
    return tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM want").fetchall()
    assert sorted(map(repr, map(tidy, got.select(*cols).collect()))) == sorted(map(repr, map(tidy, rows)))


def test_cigar_explode_on_large_keys(spark, tmp_path):
    """Part and supplier keys beyond the digits that read_id gives them."""
    con = duckdb.connect()
    shifted = "l_orderkey + 8850000 AS l_orderkey, l_partkey + 1180000 AS l_partkey, l_suppkey + 59000 AS l_suppkey"
    con.sql(f"COPY (SELECT * REPLACE ({shifted}) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = registry.QUERIES["cigar_explode"](spark, str(tmp_path))
    assert got.columns == (want := con.sql(registry.ORACLE_SQL["cigar_explode"])).columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_partitions_do_not_matter(spark):
    reads, genome = synth.reads(spark.read.parquet(f"{SF}/lineitem.parquet")), synth.genome(spark)
    options = ExtractOptions(contexts=("CpG", "CHG"), merge_context=True)
    first = sorted(map(tuple, ex.extract(reads, genome, options).collect()))
    again = sorted(map(tuple, ex.extract(reads.repartition(7, "mapq"), genome.repartition(3), options).collect()))
    assert first == again and first


def test_no_read_filter_is_left_above_the_scan(spark, tmp_path):
    reads = synth.reads(spark.read.parquet(f"{SF}/lineitem.parquet"))
    reads.write.parquet(str(tmp_path / "reads"))
    plan = ex.extract(spark.read.parquet(str(tmp_path / "reads")), synth.genome(spark), ExtractOptions())._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x and "mapq" in x)
    assert "GreaterThanOrEqual(mapq,10)" in scan and "mate_pos" not in scan.split("ReadSchema")[1]
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_no_theta_join_for_intervals(spark):
    for name in ("bed_read_semijoin", "bed_position", "mappability_filter", "interval_overlap"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_conflicting_region_bins(spark):
    found = binned(sites(synth.genome(spark), ("CpG",)))
    assert found.groupBy("chrom", "bin").count().where("count > 1").count() == 0


def test_streamed_counts(spark, tmp_path):
    reads = synth.reads(spark.read.parquet(f"{SF}/lineitem.parquet"))
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    genome = synth.genome(spark)
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = site_counts(stream, genome).writeStream.outputMode("complete").format("memory").queryName("sites").start()
    query.processAllAvailable()
    query.stop()
    want = site_counts(reads, genome)
    assert sorted(map(tuple, spark.table("sites").collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        site_counts(stream, genome, ExtractOptions(min_conversion_efficiency=0.5))


@pytest.mark.parametrize(("single", "discordant", "kept"), [(False, False, 1), (True, False, 1), (True, True, 3), (False, True, 2)])
def test_lone_reads(spark, single, discordant, kept):
    from cytosift.operators.filters import filter_reads

    rows = [(1, "a", 0x63, "c", 1, 60, None, None), (2, "b", 0x69, "c", 1, 60, None, None), (3, "c", 0x61, "c", 1, 60, None, None)]
    reads = spark.createDataFrame(rows, "read_id long, qname string, flag int, chrom string, pos long, mapq int, xg string, nh int")
    got = filter_reads(reads, ReadOptions(keep_singleton=single, keep_discordant=discordant)).collect()
    assert len(got) == kept and {r.qname: r.flag for r in got} == {k: v for k, v in {"a": 0x63, "b": 0x69, "c": 0x63}.items() if k in {r.qname for r in got}}


def test_mates_are_those_that_meet_in_the_pileup(spark):
    """Against the events themselves: a read that comes meets the one that waits; any read of the name that goes clears the place."""
    import random

    from cytosift.operators.pileup import with_mates

    r = random.Random(4)
    rows = []
    for name in range(120):
        for _ in range(r.randint(1, 7)):
            pos, n = r.randint(0, 60), r.choice((5, 20, 40))
            rows.append((len(rows), f"q{name}", r.choice((0x63, 0x63, 0x63, 0x93, 0x0, 0x69)), "c", pos, pos + n, 1, "A" * n, [30] * n))
    want = {}
    for name in range(120):
        own = [x for x in rows if x[1] == f"q{name}" and x[2] & 1 and not x[2] & 12]
        events = sorted([(x[4], 1, x[0]) for x in own] + [(x[5], 0, x[0]) for x in own])
        waits = None
        for _, comes, i in events:
            if not comes:
                waits = None
            elif waits is None:
                waits = i
            else:
                want[i], want[waits], waits = waits, i, None
    reads = spark.createDataFrame(rows, "read_id long, qname string, flag int, chrom string, pos long, ref_end long, strand int, bases string, quals array<int>")
    reads = reads.withColumn("on_ref", F.struct("bases", "quals")).drop("bases", "quals")
    got = with_mates(reads).collect()
    assert len(got) == len(rows) and len(want) > 100
    for x in got:
        mate = rows[want[x.read_id]] if x.read_id in want else None
        if mate is not None and not (mate[4] < x.ref_end and x.pos < mate[5]):
            mate = None
        assert (x.mate and (x.mate.pos, len(x.mate.bases))) == (mate and (mate[4], mate[5] - mate[4]))
        if mate is not None:
            assert x.first_mate == ((x.pos, x.read_id) < (mate[4], mate[0]))


def test_low_quality_in_sequence(spark):
    """A skipped base is followed by one that is judged whatever its quality."""
    import random

    from cytosift.plans.per_read import per_read

    r = random.Random(6)
    n, dna = 60, "ACG" * 20
    genome = spark.createDataFrame([(0, "c", 60, 0, ".." + dna + "..")], "tid int, chrom string, length long, start long, seq string")
    rows, want = [], {}
    for i in range(60):
        seq, qual = "".join(r.choice("CT") if x == "C" else x for x in dna), [r.choice((2, 2, 30)) for _ in range(n)]
        rows.append((i, f"q{i}", 0, "c", 0, 60, [("M", n)], seq, qual, None, None))
        at, m, k = 0, 0, 0
        while at < n:
            if qual[at] < 5:
                at += 1
            if at < n and dna[at] == "C":
                k += 1
                m += seq[at] == "C"
            at += 1
        want[i] = (100.0 * m / k if k else 0.0, k)
    reads = spark.createDataFrame(rows, "read_id long, qname string, flag int, chrom string, pos long, mapq int, cigar array<struct<op:string,len:int>>, seq string, qual array<int>, xg string, nh int")
    got = per_read(reads, genome, quality_rule="sequential").collect()
    assert {x.read_id: (x.pct, x.n_informative) for x in got} == want
    assert sum(x.n_informative for x in per_read(reads, genome).collect()) < sum(k for _, k in want.values())


def test_single_ends_are_not_shuffled_by_name(spark):
    from cytosift.operators.pileup import base_calls

    reads = synth.reads(spark.read.parquet(f"{SF}/lineitem.parquet")).withColumn("flag", F.lit(0))
    plan = base_calls(reads, synth.genome(spark), ReadOptions(), ("CpG",))._jdf.queryExecution().executedPlan().toString()
    assert "qname" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x) and "Window" not in plan
