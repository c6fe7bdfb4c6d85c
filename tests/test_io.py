"""Files: alignments, sequences, tracks and outputs, end to end through the command line."""

import gzip
import random
import struct
import zlib

import pytest
from cytosift import cli, svg
from cytosift.functions.strand import STRANDS
from cytosift.operators.intervals import run_lengths
from cytosift.options import ExtractOptions
from cytosift.plans import extract as ex
from cytosift.plans.merge_context import merge_context
from cytosift.sources import bam, fasta, tables, tracks, writers
from pyspark.sql import functions as F

CONTIGS = [("chrA", 500), ("chrB", 300)]


def bgzf(data, size=2000):
    out = b""
    for i in [*range(0, len(data), size), None]:
        part = b"" if i is None else data[i : i + size]
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(part) + pack.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam_file(path, rows):
    text = b"@HD\tVN:1.6\n"
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(CONTIGS))
    for name, n in CONTIGS:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    for name, flag, tid, pos, mapq, cigar, seq, qual, mate, mate_pos, xg, nh in rows:
        codes = [bam.BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), mate, mate_pos, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | bam.OPS.index(op)) for op, n in cigar)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(qual)
        body += b"MDZ3AC\0BCBs" + struct.pack("<ihh", 2, 1, 2) + b"ASC\x07"
        body += (b"XGZ" + xg.encode() + b"\0" if xg else b"") + (b"NHC" + bytes([nh]) if nh else b"")
        data += struct.pack("<i", len(body)) + body
    path.write_bytes(bgzf(data))


def made_reads(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ops = r.choice([[("M", 40)], [("S", 3), ("M", 20), ("I", 2), ("M", 15)], [("M", 10), ("D", 2), ("M", 30), ("H", 4)]])
        size = sum(k for op, k in ops if op in "MIS")
        rows.append((f"read{i // 2}", [99, 147, 83, 163][i % 4], i % 2 and 1 or 0, r.randrange(0, 240), r.randrange(60), ops, "".join(r.choice("ACGTN") for _ in range(size)), [r.randrange(42) for _ in range(size)], 0, r.randrange(200), r.choice([None, "CT", "GA"]), r.choice([None, 1, 2])))
    rows.append(("lost", 4, -1, -1, 0, [], "ACG", [1, 2, 3], -1, -1, None, None))
    return rows


def test_bam_whole_and_split(spark, tmp_path):
    rows = made_reads(700)
    path = tmp_path / "x.bam"
    bam_file(path, rows)
    place = lambda t, p: (CONTIGS[t][0] if t >= 0 else None, p if p >= 0 else None)
    want = sorted((name, flag, *place(tid, pos), mapq, tuple(cigar), seq, tuple(qual), *place(mate, mp), xg, nh) for name, flag, tid, pos, mapq, cigar, seq, qual, mate, mp, xg, nh in rows)
    key = lambda x: tuple(map(repr, x))
    for split in (1 << 25, 9000, 2500):
        frame = bam.read_bam(spark, str(path), split)
        got = [(r.qname, r.flag, r.chrom, r.pos, r.mapq, tuple((c.op, c.len) for c in r.cigar), r.seq, tuple(r.qual), r.mate_chrom, r.mate_pos, r.xg, r.nh) for r in frame.collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        assert frame.select("read_id").distinct().count() == len(rows)
        assert frame.rdd.getNumPartitions() == -(-path.stat().st_size // split)
    assert [tuple(r) for r in bam.read_contigs(spark, str(path)).collect()] == [(0, "chrA", 500), (1, "chrB", 300)]


def test_written_bam(spark, tmp_path):
    """What is written comes back: unplaced reads, missing tags and mates, a CIGAR of over 65,535 operations."""
    bam_file(tmp_path / "x.bam", made_reads(300, 5))
    columns = [f.name for f in bam.ARROW][1:]
    first = bam.read_bam(spark, str(tmp_path / "x.bam"))
    many = [{"op": "MI"[i % 2], "len": 1} for i in range(70_001)]
    size = len(many)
    long = spark.createDataFrame([(0, "long", 0, "chrB", 10, 60, many, "ACGTN" * (size // 5) + "A" * (size % 5), [7] * size, None, None, None, 1)], first.schema)
    both = first.unionByName(long)
    bam.write_bam(both, bam.read_contigs(spark, str(tmp_path / "x.bam")), str(tmp_path / "y.bam"))
    for split in (1 << 25, 3000):
        again = bam.read_bam(spark, str(tmp_path / "y.bam"), split)
        assert sorted(map(repr, again.select(*columns).collect())) == sorted(map(repr, both.select(*columns).collect()))
    assert [tuple(r) for r in bam.read_contigs(spark, str(tmp_path / "y.bam")).collect()] == [(0, "chrA", 500), (1, "chrB", 300)]
    assert (tmp_path / "y.bam").read_bytes().endswith(bam.LAST) and bam.bin_of(0, 16384) == 4681 and bam.bin_of(16383, 16385) == 585


SEQS = {k: "".join(random.Random(k).choices("ACGTCG", k=n)) for k, n in CONTIGS}


@pytest.fixture()
def genome_file(tmp_path):
    lines = []
    for k, s in SEQS.items():
        lines += [f">{k} some words", *[s[i : i + 60].lower() for i in range(0, len(s), 60)]]
    path = tmp_path / "g.fa"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_fasta(spark, tmp_path, genome_file):
    packed = tmp_path / "g2.fa.gz"
    packed.write_bytes(gzip.compress(open(genome_file, "rb").read()))
    for path in (genome_file, str(packed)):
        rows = fasta.read_fasta(spark, path, 128).orderBy("tid", "start").collect()
        assert [(r.tid, r.chrom, r.length) for r in rows if r.start == 0] == [(0, "chrA", 500), (1, "chrB", 300)]
        for k, s in SEQS.items():
            assert "".join(r.seq[2:-2] for r in rows if r.chrom == k) == s
        assert rows[0].seq[:2] == ".." and rows[1].seq[:2] == SEQS["chrA"][126:128]


def test_bed(spark, tmp_path, genome_file):
    genome = fasta.read_fasta(spark, genome_file)
    path = tmp_path / "r.bed"
    path.write_text("track name=x\n# words\n\nchrA\t10\t20\tn\t0\t+\nchrA\t15\t30\tn\t0\t-\nchrB 5 9000\n")
    got = [tuple(r) for r in tables.read_bed(spark, str(path), True, genome).orderBy("chrom", "start").collect()]
    assert got == [("chrA", 10, 20, 1), ("chrA", 15, 30, 2), ("chrB", 5, 301, 0)]
    assert {r.strand for r in tables.read_bed(spark, str(path)).collect()} == {0}
    for bad in ("chrZ\t1\t2\n", "chrA\tx\t2\n", "chrA\t5\t2\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            tables.read_bed(spark, str(path), genome=genome).count()


def test_bbm(spark, tmp_path):
    runs = [(1, 7), (2, 7 + 1), (155, 3), (156, 4), (70_000, 100), (3, 0)]
    data = tracks.encode_runs(iter(runs))
    assert data[:3] == bytes((7, 101, 8)) and data[3:5] == bytes((254, 3)) and data[5] == 255
    rows, at = [], 0
    for n, v in runs:
        rows.append(("c1", at, at + n, v))
        at += n
    contigs = spark.createDataFrame([(0, "c1", at + 10), (1, "none", 40)], "tid int, chrom string, length long")
    path = str(tmp_path / "t.bbm")
    tracks.write_bbm(spark.createDataFrame(rows, "chrom string, start long, end long, value int"), contigs, path)
    got = tracks.read_bbm(spark, path)
    flat = lambda rows: [v for _, a, b, v in sorted(rows) for _ in range(a, b)]
    tracks.write_bbm(spark.createDataFrame(rows, "chrom string, start long, end long, value int"), contigs, str(tmp_path / "chunks.bbm"), 1000)
    assert (tmp_path / "chunks.bbm").read_bytes() == (tmp_path / "t.bbm").read_bytes()
    assert flat(tuple(r) for r in got.where("chrom = 'c1'").collect()) == flat(rows) + [0] * 10
    assert flat(tuple(r) for r in got.where("chrom = 'none'").collect()) == [0] * 40
    assert got.selectExpr("max(end - start)").first()[0] == 65_535
    for bad in (b"", b"\x02\0\0\0\0", b"\x01\x01\0\0\0\x01\0AX\x05\0\0\0"):
        with pytest.raises(ValueError):
            list(tracks.decode_file(bad))
    with pytest.raises(ValueError):
        tracks.encode_runs(iter([(1, 101)]))


def bigwig_file(path, compress):
    blocks = [struct.pack("<IIIIIBBH", 0, 0, 30, 0, 0, 1, 0, 2) + struct.pack("<IIfIIf", 0, 10, 0.5, 20, 30, 1.0), struct.pack("<IIIIIBBH", 1, 5, 40, 0, 3, 2, 0, 2) + struct.pack("<IfIf", 5, 0.25, 30, 0.125), struct.pack("<IIIIIBBH", 1, 50, 90, 10, 4, 3, 0, 3) + struct.pack("<3f", 0.1, 0.2, float("nan"))]
    packed = [zlib.compress(b) if compress else b for b in blocks]
    names_at = 64
    names = struct.pack("<IIIIQQ", tracks.NAMES, 2, 4, 8, 2, 0) + struct.pack("<BBH", 1, 0, 2) + b"chrA" + struct.pack("<II", 0, 500) + b"chrB" + struct.pack("<II", 1, 300)
    data_at = names_at + len(names)
    index_at = data_at + sum(map(len, packed))
    index = struct.pack("<IIQIIIIQII", tracks.INDEX, 256, 3, 0, 0, 1, 300, index_at, 1, 0) + struct.pack("<BBH", 1, 0, 3)
    at = data_at
    for p in packed:
        index += struct.pack("<IIIIQQ", 0, 0, 1, 300, at, len(p))
        at += len(p)
    head = struct.pack("<IHHQQQHHQQIQ", tracks.BIGWIG, 4, 0, names_at, data_at, index_at, 0, 0, 0, 0, max(map(len, blocks)) if compress else 0, 0)
    path.write_bytes(head + names + b"".join(packed) + index)


@pytest.mark.parametrize("compress", [True, False])
def test_bigwig(spark, tmp_path, compress):
    path = tmp_path / "t.bw"
    bigwig_file(path, compress)
    rows = sorted((r.chrom, r.start, r.end, r.value) for r in tracks.as_mappability(tracks.read_bigwig(spark, str(path), 1)).collect())
    assert rows == [("chrA", 0, 10, 50), ("chrA", 20, 30, 100), ("chrB", 5, 8, 25), ("chrB", 30, 33, 13), ("chrB", 50, 54, 10), ("chrB", 60, 64, 20), ("chrB", 70, 74, 0)]
    assert cli.main(["bigWigToBBM", str(path), "-N", str(tmp_path / "out")], spark) == 0
    assert cli.main(["extract", "-M", str(path), "-O"], spark) == 0
    assert (tmp_path / "t.bbm").read_bytes() == (tmp_path / "out.bbm").read_bytes()
    assert cli.main(["extract", "-M", str(path), "-N", str(tmp_path / "named")], spark) == 0
    assert (tmp_path / "named.bbm").read_bytes() == (tmp_path / "out.bbm").read_bytes()
    for wrong in (["extract", "-O"], ["extract", "g.fa"], ["extract", "g.fa", "x.cram"]):
        with pytest.raises(SystemExit):
            cli.main(wrong, spark)
    back = tracks.read_bbm(spark, str(tmp_path / "out.bbm")).where("value = 25").collect()
    assert [tuple(r) for r in back] == [("chrB", 5, 8, 25)]


def test_run_lengths(spark):
    rows = [("c", 0, 5, 1), ("c", 5, 9, 1), ("c", 9, 12, 2), ("c", 20, 22, 2), ("d", 0, 3, 2)]
    got = run_lengths(spark.createDataFrame(rows, "chrom string, start long, end long, value int"), 4)
    assert sorted(tuple(r) for r in got.collect()) == [("c", 0, 4, 1), ("c", 4, 8, 1), ("c", 8, 9, 1), ("c", 9, 12, 2), ("c", 20, 22, 2), ("d", 0, 3, 2)]


def test_long_cigar():
    def record(cigar, extra):
        body = struct.pack("<iiBBHHHiiii", 0, 7, 2, 30, 0, len(cigar), 0, 5, -1, -1, 0) + b"r\0" + struct.pack(f"<{len(cigar)}I", *cigar) + b"\x12\x48\xf0" + bytes(5) + extra
        return struct.pack("<i", len(body)) + body

    real = [2 << 4 | 0, 1 << 4 | 1, 2 << 4 | 0]
    row = bam.decode(record([5 << 4 | 4, 4 << 4 | 3], b"CGBI" + struct.pack("<i3I", 3, *real) + b"NHC\x02"), 0, [("c", 100)], 0)
    assert [(c["op"], c["len"]) for c in row[6]] == [("M", 2), ("I", 1), ("M", 2)] and row[7] == "ACGTN" and row[12] == 2
    short = bam.decode(record([5 << 4 | 0], b"CGBI" + struct.pack("<i3I", 3, *real)), 0, [("c", 100)], 0)
    assert [(c["op"], c["len"]) for c in short[6]] == [("M", 5)]


def test_commands(spark, tmp_path, genome_file, capfdbinary):
    path = tmp_path / "x.bam"
    bam_file(path, made_reads(600, 2))
    (tmp_path / "r.bed").write_text("chrA\t50\t200\tn\t0\t+\nchrB\t0\t150\tn\t0\t.\n")
    bigwig_file(tmp_path / "m.bw", True)
    run = lambda *a: cli.main([*map(str, a)], spark)
    assert run("extract", genome_file, path, "--CHG", "--CHH", "-q", 0) == 0
    single = (tmp_path / "x_CpG.bedGraph").read_text().splitlines()
    assert single[0] == f'track type="bedGraph" description="{tmp_path}/x CpG methylation levels"' and len(single) > 10
    places = [(("chrA", "chrB").index(f[0]), int(f[1])) for f in (x.split("\t") for x in single[1:])]
    assert places == sorted(places)
    reads, genome = bam.read_bam(spark, str(path)), fasta.read_fasta(spark, genome_file)
    rows = ex.extract(reads, genome, ExtractOptions(min_mapq=0, contexts=("CpG", "CHG", "CHH")))
    assert sum(len((tmp_path / f"x_{c}.bedGraph").read_text().splitlines()) - 1 for c in ("CpG", "CHG", "CHH")) == rows.count()
    for flag, end in (("--fraction", "meth.bedGraph"), ("--counts", "counts.bedGraph"), ("--logit", "logit.bedGraph"), ("--methylKit", "methylKit")):
        assert run("extract", genome_file, path, "-q", 0, "-o", tmp_path / "y", flag) == 0
        assert len((tmp_path / f"y_CpG.{end}").read_text().splitlines()) == len(single)
    assert (tmp_path / "y_CpG.methylKit").read_text().startswith(writers.METHYLKIT_HEADER)
    assert run("extract", genome_file, path, "-q", 0, "-o", tmp_path / "y", "--cytosine_report", "--CHG", "--CHH") == 0
    report = (tmp_path / "y.cytosine_report.txt").read_text().splitlines()
    assert len(report) == sum(s.count("C") + s.count("G") for s in SEQS.values())
    assert run("extract", genome_file, path, "-q", 0, "-o", tmp_path / "m", "--mergeContext") == 0
    assert run("mergeContext", genome_file, tmp_path / "x_CpG.bedGraph", "-o", tmp_path / "merged") == 0
    assert (tmp_path / "merged").read_text().splitlines()[1:] == (tmp_path / "m_CpG.bedGraph").read_text().splitlines()[1:]
    assert run("extract", genome_file, path, "-o", tmp_path / "z", "-l", tmp_path / "r.bed", "--keepStrand", "-M", tmp_path / "m.bw", "-t", 0.1, "-b", 5, "--minConversionEfficiency", 0.1, "--nOT", "2,3,4,5", "--OB", "1,30,2,20", "--minOppositeDepth", 1, "--maxVariantFrac", 0.9, "-r", "chrA:20-400") == 0
    assert run("perRead", genome_file, path, "-o", tmp_path / "p.tsv") == 0
    per = [x.split("\t") for x in (tmp_path / "p.tsv").read_text().splitlines()]
    assert len(per) == reads.where("mapq >= 10 AND chrom IS NOT NULL").count() and any(x[3] == "0.0" and x[4] == "0" for x in per)
    assert run("mergeContext", genome_file, tmp_path / "x_CpG.bedGraph") == 0 and run("perRead", genome_file, path) == 0
    said = capfdbinary.readouterr().out
    assert said.endswith((tmp_path / "p.tsv").read_bytes()) and (tmp_path / "merged").read_bytes() in said
    assert run("mbias", genome_file, path, tmp_path / "b", "-q", 0, "--txt") == 0
    said = capfdbinary.readouterr()
    assert said.out.startswith(writers.MBIAS_HEADER.encode()) and b"--O" in said.err
    plots = [tmp_path / f"b_{s}.svg" for s in STRANDS if (tmp_path / f"b_{s}.svg").exists()]
    assert plots and all(p.read_text().startswith("<svg") for p in plots)
    (tmp_path / "only.fa").write_text(">chrA\nACGT\n")
    with pytest.raises(ValueError):
        run("extract", tmp_path / "only.fa", path)
    with pytest.raises(SystemExit):
        run("extract", genome_file, path, "--fraction", "--counts")
    assert cli.default_prefix("/a.b/c") == "/a.b/c" and cli.default_prefix("/a.b/c.bam") == "/a.b/c"


def test_merge_context_example(spark):
    genome = fasta.chunked(spark.createDataFrame([(0, "1", "A" * 25114 + "CG" + "CAG" + "CTT")], "tid int, chrom string, seq string"))
    rows = spark.createDataFrame([("1", 25114, 25115, 66, 2, 1), ("1", 25115, 25116, 100, 3, 0), ("1", 25118, 25119, 50, 1, 1), ("1", 25119, 25120, 0, 0, 4)], "chrom string, start long, end long, pct int, n_meth long, n_unmeth long")
    assert sorted(tuple(r) for r in merge_context(rows, genome).collect()) == [("1", 25114, 25116, 83, 5, 1), ("1", 25116, 25119, 50, 1, 1), ("1", 25119, 25120, 0, 0, 4)]
    with pytest.raises(ValueError):
        merge_context(rows.withColumn("chrom", F.lit("2")), genome)


def test_plot():
    text = svg.plot([svg.Point(1, i, 0.5, 0.4, 0.6) for i in range(1, 90)] + [svg.Point(2, 1, 0.2, 0.1, 0.3)], "a < b", {1: (5, 80)})
    assert "a &lt; b" in text and text.count("<polyline") == 2 and text.count("stroke-dasharray") == 2
    assert svg.plot([], "none").endswith("</svg>\n") and svg.steps(0, 100, 10) == [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]


def test_bam_by_columns_as_one_by_one(tmp_path):
    """Batches of columns are what rows give one by one, both ways; what columns don't provide for is taken by rows."""
    import pyarrow as pa

    contigs, r = [("chrA", 500), ("chrB", 300)], random.Random(8)
    numbers = {"chrA": 0, "chrB": 1}
    rows = []
    for i in range(400):
        n = r.choice((0, 1, 30, 31))
        cigar = [{"op": r.choice("MIDNSHP=X"), "len": r.randint(1, 40)} for _ in range(r.randint(0, 4))]
        rows.append({
            "read_id": i, "qname": f"q{i}", "flag": r.randrange(4096), "chrom": r.choice((None, "chrA", "chrB", "chrC")), "pos": r.choice((None, 0, 7, 16_383, 40_000)), "mapq": r.randrange(256), "cigar": cigar or r.choice((None, [])), "seq": "".join(r.choices("ACGTN", k=n)) if n else r.choice((None, "")),
            "qual": [r.randrange(94) for _ in range(n)] if r.random() < 0.8 else r.choice((None, [])), "mate_chrom": r.choice((None, "chrB")), "mate_pos": r.choice((None, 5)), "xg": r.choice((None, "", "CT", "GA")), "nh": r.choice((None, -3, 1, 2)),
        })
    batch = pa.RecordBatch.from_pylist(rows, schema=bam.ARROW)
    for part in (batch, batch.slice(37, 100), batch.slice(0, 0)):
        want = b"".join(bam.encode(row, numbers) for row in part.to_pylist())
        assert bam._records(part, numbers) == want
    more = [b"", b"NHC\x02", b"XGAC", b"MDZ3AC\0BCBs" + struct.pack("<ihh", 2, 1, 2) + b"NHs\xff\xff", b"NHI\1\0\0\0NHc\x05XGZ\0", b"XXZabc\0XGZCT\0XXf\0\0\0\0"]
    data, starts = b"", []
    for row in rows:
        starts.append(len(data))
        body = bam.encode(row, numbers)[4:] + r.choice(more)
        data += struct.pack("<i", len(body)) + body
    assert bam._columns(data, bam.np.array(starts), contigs, 5).equals(bam._batch([bam.decode(data, at, contigs, 5 + i) for i, at in enumerate(starts)]))
    odd = [rows[0] | {"qname": "é"}, rows[1] | {"cigar": [{"op": "M", "len": 1}] * 70_000}]
    batch = pa.RecordBatch.from_pylist(odd, schema=bam.ARROW)
    data = bam.encoded(batch, numbers)
    assert data == b"".join(bam.encode(row, numbers) for row in odd) and len(bam.decoded(data, [0, 4 + struct.unpack_from("<i", data)[0]], contigs, 0).column("cigar")[1]) == 70_000
