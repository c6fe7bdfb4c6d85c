"""BAM as a Spark data source: `spark.read.format("bam").load(path)` after `register(spark)`.

A file is split at byte offsets. Each task finds the first BGZF block at or after its offset and the first record that
begins in it, recognised by a run of records that hold together, and reads to where the next task begins."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import READS
from .files import create, open_bytes, remove, scratch, size

#: Fixed values of the format: base codes, CIGAR operations, sizes of tag values.
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
#: From the hexadecimal digit of a base's code to the base.
LETTERS = str.maketrans("0123456789abcdef", BASES)
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_FORMAT = {"c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
SPLIT = 32 << 20
#: Records, and their bases, that an Arrow batch holds at most (one longer record comes alone).
BATCH_ROWS, BATCH_BASES = 4096, 1 << 20
ARROW = pa.schema([
    ("read_id", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()),
    ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("seq", pa.string()), ("qual", pa.list_(pa.int32())),
    ("mate_chrom", pa.string()), ("mate_pos", pa.int64()), ("xg", pa.string()), ("nh", pa.int32()),
])
#: Records that must follow each other for a place to count as the beginning of one.
CHAIN = 5


def blocks(data, start: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the BGZF blocks that begin in [start, end)."""
    data.seek(start)
    while end is None or start < end:
        head = data.read(18)
        if len(head) < 18:
            return
        extra = struct.unpack_from("<H", head, 10)[0]
        more = data.read(extra - 6) if extra > 6 else b""
        field, at, total = head[12:18] + more, 0, None
        while at + 4 <= len(field):
            n = struct.unpack_from("<H", field, at + 2)[0]
            if field[at : at + 2] == b"BC":
                total = struct.unpack_from("<H", field, at + 4)[0] + 1
            at += 4 + n
        if head[:4] != b"\x1f\x8b\x08\x04" or total is None:
            raise ValueError(f"no BGZF block at byte {start}")
        rest = data.read(total - 12 - extra)
        yield start, zlib.decompress(rest[:-8], -15)
        start += total


def next_block(data, start: int, end: int) -> int | None:
    """Where the first BGZF block at or after start begins; None if none does before end."""
    data.seek(start)
    window = data.read(min(end - start, 1 << 16) + 32)
    at = -1
    while (at := window.find(b"\x1f\x8b\x08\x04", at + 1)) >= 0:
        if start + at >= end:
            return None
        if window[at + 12 : at + 14] == b"BC":
            try:
                next(blocks(data, start + at))
                return start + at
            except (ValueError, StopIteration, zlib.error):
                continue
    return None


def header(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """(contigs, offset of the block and offset within it at which the records begin)."""
    with open_bytes(path) as data:
        held, starts, total = b"", [], 0
        for offset, block in blocks(data, 0):
            starts.append((offset, total))
            held, total = held + block, total + len(block)
            if (parsed := _header(held)) is not None:
                found, end = parsed
                at = max((x for x in starts if x[1] <= end), key=lambda x: x[1])
                return found, at[0], end - at[1]
    raise ValueError(f"{path}: no BAM header")


def _header(held: bytes) -> tuple[list[tuple[str, int]], int] | None:
    if held[:4] not in (b"BAM\x01", b"BAM"[: len(held)]):
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", held, 4)[0]
        n = struct.unpack_from("<i", held, at)[0]
        at, found = at + 4, []
        for _ in range(n):
            size_ = struct.unpack_from("<i", held, at)[0]
            name = held[at + 4 : at + 4 + size_ - 1].decode()
            found.append((name, struct.unpack_from("<i", held, at + 4 + size_)[0]))
            at += 8 + size_
        return (found, at) if at <= len(held) else None
    except struct.error:
        return None


def plausible(data: bytes, at: int, lengths: list[int]) -> int | None:
    """The end of the record at `at` if its fields hold together; None if they don't; len(data) or more if it is cut off."""
    if at + 36 > len(data):
        return len(data) + 1
    n, tid, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    end = at + 4 + n
    ok = all(-1 <= t < len(lengths) and -1 <= p <= (lengths[t] if t >= 0 else 2**31) for t, p in ((tid, pos), (mate, mate_pos)))
    least = 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq
    if not ok or l_name < 1 or l_seq < 0 or n < least or n > 1 << 26:
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] != 0 or not all(33 <= b <= 126 for b in name[:-1])):
        return None
    return end


def first_record(data: bytes, lengths: list[int]) -> int | None:
    for at in range(len(data)):
        end, n = at, 0
        while n < CHAIN and end is not None and end < len(data):
            end, n = plausible(data, end, lengths), n + 1
        if end is not None and n:
            return at
    return None


def decode(data: bytes, at: int, contigs: list[tuple[str, int]], number: int) -> tuple:
    """One record as a row of the reads schema."""
    n, tid, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    end, p = at + 4 + n, at + 36
    name = data[p : p + l_name - 1].decode("ascii", "replace")
    p += l_name
    cigar = [{"op": OPS[v & 15], "len": v >> 4} for v in struct.unpack_from(f"<{n_ops}I", data, p)]
    p += 4 * n_ops
    seq = data[p : p + (l_seq + 1) // 2].hex().translate(LETTERS)[:l_seq]
    p += (l_seq + 1) // 2
    qual = list(data[p : p + l_seq])
    xg, nh, long_cigar = tags(data, p + l_seq, end)
    if long_cigar and len(cigar) == 2 and cigar[0] == {"op": "S", "len": l_seq} and cigar[1]["op"] == "N":
        cigar = [{"op": OPS[v & 15], "len": v >> 4} for v in long_cigar]
    contig = lambda t: contigs[t][0] if t >= 0 else None
    return (number, name, flag, contig(tid), pos if pos >= 0 else None, mapq, cigar, seq, qual, contig(mate), mate_pos if mate_pos >= 0 else None, xg, nh)


def tags(data: bytes, p: int, end: int) -> tuple[str | None, int | None, tuple[int, ...]]:
    """The values of XG and NH, and CG: the operations of a CIGAR of over 65,535, in whose place the record has one of soft clip and skip."""
    xg = nh = None
    long_cigar: tuple[int, ...] = ()
    while p + 3 <= end:
        tag, kind = data[p : p + 2], chr(data[p + 2])
        p += 3
        if kind in "ZH":
            stop = data.index(b"\0", p)
            if tag == b"XG":
                xg = data[p:stop].decode("ascii", "replace")
            p = stop + 1
        elif kind == "B":
            n = struct.unpack_from("<i", data, p + 1)[0]
            if tag == b"CG" and data[p : p + 1] == b"I":
                long_cigar = struct.unpack_from(f"<{n}I", data, p + 5)
            p += 5 + TAG_BYTES[chr(data[p])] * n
        else:
            if tag == b"NH" and kind in TAG_FORMAT:
                nh = struct.unpack_from(TAG_FORMAT[kind], data, p)[0]
            elif tag == b"XG" and kind == "A":
                xg = chr(data[p])
            p += TAG_BYTES[kind]
    return xg, nh, long_cigar


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


#: The fixed fields of a record, its size first.
HEAD = np.dtype([(n, t) for n, t in zip(("size", "tid", "pos", "l_name", "mapq", "bin", "n_ops", "flag", "l_seq", "mate", "mate_pos", "span"), "<i4 <i4 <i4 u1 u1 <u2 <u2 <u2 <i4 <i4 <i4 <i4".split(), strict=True)])
#: By byte: the two bases of a packed byte, the code of a letter (255: none), bytes of a tag's value.
PAIRS = np.frombuffer("".join(a + b for a in BASES for b in BASES).encode(), np.uint8).reshape(256, 2)
CODE = np.full(256, 255, np.uint8)
CODE[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(16)
WIDTH = np.zeros(256, np.int64)
WIDTH[[ord(k) for k in TAG_BYTES]] = list(TAG_BYTES.values())
OP = np.frombuffer(OPS.encode(), np.uint8)


class _Plain(Exception):
    """Records that are to be taken one by one."""


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] to starts[i] + lengths[i] of all i, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    if (data >= 128).any():
        raise _Plain
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(_offsets(lengths)), pa.py_buffer(np.ascontiguousarray(data)))


def _tag_columns(buf: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """`tags` of many records: the k-th tag of all of them at once."""
    n, at = len(at), at.copy()
    xg_at, xg_n, nh, has_nh = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int32), np.zeros(n, bool)
    zeros = np.flatnonzero(buf == 0)
    left = np.flatnonzero(at + 3 <= ends)
    while len(left):
        q = at[left] + 3
        kind, is_xg, is_nh = buf[q - 1], (buf[q - 3] == ord("X")) & (buf[q - 2] == ord("G")), (buf[q - 3] == ord("N")) & (buf[q - 2] == ord("H"))
        text, many = (kind == ord("Z")) | (kind == ord("H")), kind == ord("B")
        if many.any() and (many & (buf[q - 3] == ord("C")) & (buf[q - 2] == ord("G"))).any() or (~text & ~many & (WIDTH[kind] == 0)).any():
            raise _Plain
        after = q + WIDTH[kind]
        if text.any():
            found = np.searchsorted(zeros, q[text])
            if (found == len(zeros)).any():
                raise _Plain
            after[text] = zeros[found] + 1
        if many.any():
            after[many] = q[many] + 5 + WIDTH[buf[q[many]]] * buf[q[many][:, None] + np.arange(1, 5)].view("<i4")[:, 0]
        if (after > ends[left]).any():
            raise _Plain
        xg = is_xg & (text | (kind == ord("A")))
        xg_at[left[xg]], xg_n[left[xg]] = q[xg], (after - q - text)[xg]
        for code, form in TAG_FORMAT.items():  # struct's letters are numpy's too
            if (m := is_nh & (kind == ord(code))).any():
                nh[left[m]], has_nh[left[m]] = buf[q[m][:, None] + np.arange(TAG_BYTES[code])].view(form)[:, 0], True
        at[left] = after
        left = left[after + 3 <= ends[left]]
    size_of = np.maximum(xg_n, 0)
    strings = _strings(buf[_spread(xg_at, size_of)], size_of)
    return pc.if_else(pa.array(xg_n >= 0), strings, pa.scalar(None, pa.string())), pa.array(nh, pa.int32(), mask=~has_nh)


def _columns(data: bytes, starts: np.ndarray, contigs: list[tuple[str, int]], number: int) -> pa.RecordBatch:
    buf, n = np.frombuffer(data, np.uint8), len(starts)
    h = {k: v.astype(np.int64) for k, v in ((k, buf[starts[:, None] + np.arange(HEAD.itemsize)].view(HEAD)[:, 0][k]) for k in HEAD.names)}
    ends, p = starts + 4 + h["size"], starts + HEAD.itemsize
    half = (h["l_seq"] + 1) // 2
    if (h["l_name"] < 1).any() or (h["l_seq"] < 0).any() or (p + h["l_name"] + 4 * h["n_ops"] + half + h["l_seq"] > ends).any():
        raise _Plain
    names = _strings(buf[_spread(p, h["l_name"] - 1)], h["l_name"] - 1)
    p = p + h["l_name"]
    ops = buf[_spread(p, 4 * h["n_ops"])].view("<u4")
    if (ops & 15 >= len(OPS)).any():
        raise _Plain
    pieces = pa.StructArray.from_arrays([_strings(OP[ops & 15], np.ones(len(ops), np.int64)), pa.array((ops >> 4).astype(np.int32))], fields=list(ARROW.field("cigar").type.value_type))
    p = p + 4 * h["n_ops"]
    letters = PAIRS[buf[_spread(p, half)]].ravel()
    if (odd := h["l_seq"] % 2 == 1).any():
        letters = np.delete(letters, (2 * np.cumsum(half) - 1)[odd])
    p = p + half
    quals = pa.ListArray.from_arrays(_offsets(h["l_seq"]), pa.array(buf[_spread(p, h["l_seq"])].astype(np.int32)))
    xg, nh = _tag_columns(buf, p + h["l_seq"], ends)
    known = pa.array([k for k, _ in contigs], pa.string())
    whole = lambda k, t: pa.array(h[k], t, mask=h[k] < 0)
    return pa.RecordBatch.from_arrays([
        pa.array(number + np.arange(n)), names, pa.array(h["flag"], pa.int32()), known.take(whole("tid", pa.int64())), whole("pos", pa.int64()), pa.array(h["mapq"], pa.int32()),
        pa.ListArray.from_arrays(_offsets(h["n_ops"]), pieces), _strings(letters, h["l_seq"]), quals, known.take(whole("mate", pa.int64())), whole("mate_pos", pa.int64()), xg, nh,
    ], schema=ARROW)


def decoded(data: bytes, starts: list[int], contigs: list[tuple[str, int]], number: int) -> pa.RecordBatch:
    """The records at `starts`, by columns; where one holds what columns don't provide for (a CIGAR in a tag, letters beyond ASCII), all one by one."""
    try:
        return _columns(data, np.array(starts, np.int64), contigs, number)
    except _Plain:
        return _batch([decode(data, at, contigs, number + i) for i, at in enumerate(starts)])


class _Part(InputPartition):
    def __init__(self, number: int, start: int, end: int):
        self.number, self.start, self.end = number, start, end


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self):
        total = size(self.path)
        return [_Part(i, at, min(at + self.split, total)) for i, at in enumerate(range(0, total, self.split))]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        contigs, first_block, first_at = header(self.path)
        lengths = [n for _, n in contigs]
        with open_bytes(self.path) as data:
            start = first_block if part.start <= first_block < part.end else None if first_block >= part.end else next_block(data, part.start, part.end)
            if start is None:
                return
            at, held, number, limit = (first_at if start == first_block else None), bytearray(), 0, None
            starts: list[int] = []
            bases = 0

            def taken() -> pa.RecordBatch:
                return decoded(bytes(memoryview(held)[:at]), starts, contigs, (part.number << 40) + number)

            for offset, block in blocks(data, start):
                # beyond the end only the rest of a record begun before it is read
                if offset >= part.end and limit is None:
                    limit = len(held)
                held += block
                if at is None:
                    at = first_record(bytes(held), lengths)
                    if at is None:
                        continue
                while at + 4 <= len(held) and (limit is None or at < limit):
                    end = at + 4 + struct.unpack_from("<i", held, at)[0]
                    if end > len(held):
                        break
                    starts.append(at)
                    bases += struct.unpack_from("<i", held, at + 20)[0]
                    at = end
                    if len(starts) == BATCH_ROWS or bases >= BATCH_BASES:
                        yield taken()
                        del held[:at]
                        limit = None if limit is None else limit - at
                        number, at, starts, bases = number + len(starts), 0, [], 0
                if limit is not None and at >= limit:
                    break
            if starts:
                yield taken()


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return READS

    def reader(self, schema):
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read_bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    register(spark)
    return spark.read.format("bam").option("split", split).load(path)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(header(path)[0])], "tid int, chrom string, length long")


#: Of the format (fixed values): bytes that a block holds, the empty block that ends a file, sizes of bins as shifts with the number of the first bin.
BLOCK = 0xFF00
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BINS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
CODES = str.maketrans(BASES, "0123456789abcdef")


def bgzf(data: bytes) -> bytes:
    """The bytes as BGZF blocks, without the one that ends a file."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(part) + pack.flush()
        out.append(struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def bin_of(start: int, end: int) -> int:
    """The smallest bin of the index that holds [start, end)."""
    return next((first + (start >> shift) for shift, first in BINS if start >> shift == (end - 1) >> shift), 0)


def encode(row: dict, numbers: dict[str, int]) -> bytes:
    """A row of the reads schema as one record; read_id is not kept."""
    name, seq = row["qname"].encode("ascii", "replace") + b"\0", row["seq"] or ""
    pos = -1 if row["pos"] is None else row["pos"]
    ops = [c["len"] << 4 | OPS.index(c["op"]) for c in row["cigar"] or []]
    span = sum(c["len"] for c in row["cigar"] or [] if c["op"] in "MDN=X")
    more = b"".join(([b"XGZ" + row["xg"].encode("ascii", "replace") + b"\0"] if row["xg"] is not None else []) + ([b"NHi" + struct.pack("<i", row["nh"])] if row["nh"] is not None else []))
    if len(ops) > 0xFFFF:
        more += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | OPS.index("S"), span << 4 | OPS.index("N")]
    packed = bytes.fromhex((seq + "=" * (len(seq) % 2)).translate(CODES))
    quals = bytes(row["qual"]) if row["qual"] else b"\xff" * len(seq)
    mate_pos = -1 if row["mate_pos"] is None else row["mate_pos"]
    head = struct.pack(
        "<iiBBHHHiiii", numbers.get(row["chrom"], -1), pos, len(name), row["mapq"], bin_of(pos, pos + max(1, span)) if pos >= 0 else 4680, len(ops), row["flag"], len(seq),
        numbers.get(row["mate_chrom"], -1), mate_pos, 0,
    )
    body = head + name + struct.pack(f"<{len(ops)}I", *ops) + packed + quals + more
    return struct.pack("<i", len(body)) + body


def _ragged(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values, lengths) of lists or strings, one after the other; a null has none."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary())
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        joined = column.fill_null(b"")
        first, last = np.frombuffer(joined.buffers()[1], np.int32)[[joined.offset, joined.offset + len(joined)]] if len(joined) else (0, 0)
        return np.frombuffer(joined.buffers()[2] or b"", np.uint8)[first:last], lengths
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _records(batch: pa.RecordBatch, numbers: dict[str, int]) -> bytes:
    col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    known = pa.array(list(numbers), pa.string())
    tid, mate = (pc.fill_null(pc.index_in(col[k].cast(pa.string()), known), -1).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("chrom", "mate_chrom"))
    pos, mate_pos = (pc.fill_null(col[k], -1).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("pos", "mate_pos"))
    (name, l_name), (seq, l_seq), (qual, l_qual), (cigar, n_ops), (xg, l_xg) = (_ragged(col[k]) for k in ("qname", "seq", "qual", "cigar", "xg"))
    ops = pc.index_in(cigar.field("op"), pa.array(list(OPS)))
    kinds, has_xg, has_nh = CODE[seq], *(col[k].is_valid().to_numpy(zero_copy_only=False) for k in ("xg", "nh"))
    if col["mapq"].null_count or col["flag"].null_count or col["qname"].null_count or ops.null_count or cigar.field("len").null_count or qual.null_count:
        raise _Plain
    mapq, flag, qual, lens = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (col["mapq"], col["flag"], qual, cigar.field("len")))
    ops = ops.to_numpy(zero_copy_only=False)
    wide = lambda x, top: ((x < 0) | (x > top)).any()
    if (n_ops > 0xFFFF).any() or (kinds == 255).any() or (name >= 128).any() or (xg >= 128).any() or ((l_qual != l_seq) & (l_qual > 0)).any():
        raise _Plain
    if wide(mapq, 0xFF) or wide(l_name, 0xFE) or wide(flag, 0xFFFF) or wide(qual, 0xFF) or wide(lens, (1 << 28) - 1) or wide(pos + 1, 1 << 29) or wide(mate_pos + 1, (1 << 31) - 1):
        raise _Plain
    along = np.concatenate(([0], np.cumsum(np.where(np.isin(ops, [OPS.index(k) for k in "MDN=X"]), lens, 0))))
    edge = np.concatenate(([0], np.cumsum(n_ops)))
    last = pos + np.maximum(1, along[edge[1:]] - along[edge[:-1]]) - 1
    bins = np.zeros(len(pos), np.int64)
    for shift, first in reversed(BINS):
        bins = np.where(pos >> shift == last >> shift, first + (pos >> shift), bins)
    half = (l_seq + 1) // 2
    parts = [l_name + 1, 4 * n_ops, half, l_seq, np.where(has_xg, l_xg + 4, 0), np.where(has_nh, 7, 0)]
    sizes = HEAD.itemsize + sum(parts)
    starts = np.cumsum(sizes) - sizes
    head = np.zeros(len(pos), HEAD)
    for k, v in {"size": sizes - 4, "tid": tid, "pos": pos, "l_name": l_name + 1, "mapq": mapq, "bin": np.where(pos < 0, 4680, bins), "n_ops": n_ops, "flag": flag, "l_seq": l_seq, "mate": mate, "mate_pos": mate_pos}.items():
        head[k] = v
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(-1, HEAD.itemsize)
    name_at, cigar_at, seq_at, qual_at, xg_at, nh_at = starts + HEAD.itemsize + (np.cumsum([0 * l_name, *parts[:-1]], axis=0))
    out[_spread(name_at, l_name)] = name
    out[_spread(cigar_at, 4 * n_ops)] = (lens << 4 | ops).astype("<u4").view(np.uint8)
    even = np.zeros(2 * int(half.sum()), np.uint8)
    even[_spread(2 * (np.cumsum(half) - half), l_seq)] = kinds
    out[_spread(seq_at, half)] = even[::2] << 4 | even[1::2]
    out[_spread(qual_at, l_qual)] = qual
    bare = l_qual == 0
    out[_spread(qual_at[bare], l_seq[bare])] = 0xFF
    for at, tag in ((xg_at[has_xg], b"XGZ"), (nh_at[has_nh], b"NHi")):
        out[at[:, None] + np.arange(3)] = np.frombuffer(tag, np.uint8)
    out[_spread(xg_at + 3, l_xg)] = xg
    out[nh_at[has_nh][:, None] + np.arange(3, 7)] = pc.drop_null(col["nh"]).to_numpy(zero_copy_only=False).astype("<i4").view(np.uint8).reshape(-1, 4)
    return out.tobytes()


def encoded(batch: pa.RecordBatch, numbers: dict[str, int]) -> bytes:
    """The rows as records, by columns; where one holds what columns don't provide for, all one by one."""
    try:
        return _records(batch, numbers)
    except _Plain:
        return b"".join(encode(row, numbers) for row in batch.to_pylist())


def write_bam(reads: DataFrame, contigs: DataFrame, path: str) -> None:
    """Reads as one BAM file, in the order of their partitions. Executors write each partition's blocks to a file of the shared scratch
    folder, all at a time; the driver puts these together by small steps."""
    known = [(r.chrom, r.length) for r in contigs.select("tid", "chrom", "length").distinct().orderBy("tid").collect()]  # a row a contig
    numbers = {name: i for i, (name, _) in enumerate(known)}
    folder = scratch(reads.sparkSession, "bam")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}"  # another for each attempt
        with create(name) as out:
            held = b""
            for batch in batches:
                held += encoded(batch, numbers)
                whole = len(held) // BLOCK * BLOCK
                out.write(bgzf(held[:whole]))
                held = held[whole:]
            out.write(bgzf(held))
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    head = b"BAM\x01" + struct.pack("<ii", 0, len(known))
    for name, length in known:
        head += struct.pack("<i", len(name) + 1) + name.encode("ascii") + b"\0" + struct.pack("<i", length)
    names = [r.name for r in reads.select(*[f.name for f in ARROW]).mapInArrow(run, "name string").collect()]  # a row a partition
    with create(path) as out:
        out.write(bgzf(head))
        for name in names:
            with open_bytes(name) as data:
                while piece := data.read(8 << 20):
                    out.write(piece)
            remove(name)
        out.write(LAST)
