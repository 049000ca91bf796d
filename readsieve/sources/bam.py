"""BAM as a source and a sink. BGZF files are gzip members of at most 64 KiB; records are unpacked and packed in Arrow batches.

A file is one task's to read, since only reading in order finds where records begin; several files are several tasks. Writing is
parallel: parts are ranges of rows, and one after the other they are one BAM file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsieve.sources.files import inflated, opened
from readsieve.sources.header import Header

SCHEMA = "idx long, qname string, flag int, tid int, pos int, mapq int, cigar string, mtid int, mpos int, tlen int, seq string, qual string, tags array<string>, rg string"
OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
#: Types of tag values by their letter.
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 65_280
BATCH = 10_000
PAIRS = [BASES[b >> 4] + BASES[b & 15] for b in range(256)]


class _Stream:
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer, self.at = pieces, b"", 0

    def read(self, n: int) -> bytes | None:
        """The next n bytes; None at the end of the file."""
        while len(self.buffer) - self.at < n:
            more = next(self.pieces, None)
            if more is None:
                return None
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        self.at += n
        return self.buffer[self.at - n : self.at]


def _header(stream: _Stream) -> Header:
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.read(struct.unpack("<i", stream.read(4))[0]).rstrip(b"\0").decode()
    lines = [x for x in text.split("\n") if x]
    found = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        name = stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode()
        found.append((name, struct.unpack("<i", stream.read(4))[0]))
    if not any(x.startswith("@SQ") for x in lines):
        lines += [f"@SQ\tSN:{n}\tLN:{size}" for n, size in found]
    return Header(lines)


def _tags(data: bytes) -> list[str]:
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in NUMBERS:
            size = struct.calcsize(NUMBERS[kind])
            value = struct.unpack_from(f"<{NUMBERS[kind]}", data, at)[0]
            out.append(f"{name}:f:{value:g}" if kind == "f" else f"{name}:i:{value}")
            at += size
        elif kind == "A":
            out.append(f"{name}:A:{chr(data[at])}")
            at += 1
        elif kind in "ZH":
            end = data.index(0, at)
            out.append(f"{name}:{kind}:{data[at:end].decode()}")
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[sub]}", data, at + 5)
            out.append(f"{name}:B:{sub}" + "".join(f",{v:g}" if sub == "f" else f",{v}" for v in values))
            at += 5 + n * struct.calcsize(NUMBERS[sub])
        else:
            raise ValueError(f"unknown tag type {kind!r}")
    return out


def decode(data: bytes) -> tuple:
    """Fields of one record, without idx. Unmapped reads get their flag as in SAM text."""
    tid, pos, name, mapq, _, ops, flag, bases, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + name
    cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in struct.unpack_from(f"<{ops}I", data, at)) or "*"
    at += 4 * ops
    seq = "".join(PAIRS[b] for b in data[at : at + (bases + 1) // 2])[:bases] or "*"
    at += (bases + 1) // 2
    qual = data[at : at + bases]
    quals = "*" if not bases or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    tags = _tags(data[at + bases :])
    return data[32 : 32 + name - 1].decode(), flag, tid, pos, mapq, cigar, mtid, mpos, tlen, seq, quals, tags, next((t[5:] for t in tags if t.startswith("RG:Z:")), None)


def read_header(path: str) -> Header:
    system, name = opened(path)
    with system.open_input_file(name) as file:
        return _header(_Stream(inflated(file, 1 << 16)))


def read_bam(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    """Reads and header of one BAM file."""
    names = [f.name for f in spark.createDataFrame([], SCHEMA).schema]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                system, name = opened(source)
                with system.open_input_file(name) as file:
                    stream = _Stream(inflated(file))
                    _header(stream)
                    rows, n = [], 0
                    while (size := stream.read(4)) is not None:
                        rows.append((n, *decode(stream.read(struct.unpack("<i", size)[0]))))
                        n += 1
                        if len(rows) == BATCH:
                            yield _batch(rows, names)
                            rows = []
                    if rows:
                        yield _batch(rows, names)

    return spark.createDataFrame([(path,)], "path string").mapInArrow(scan, SCHEMA), read_header(path)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.string(), *[pa.int32()] * 3, pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _bin(begin: int, end: int) -> int:
    """Number of the smallest of the nested bins (512 MiB, then each an eighth) that holds [begin, end)."""
    end -= 1
    for level in range(5, 0, -1):
        shift = 14 + 3 * (5 - level)
        if begin >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (begin >> shift)
    return 0


def _packed(tag: str) -> bytes:
    name, kind, value = tag.split(":", 2)
    head = name.encode()
    if kind == "i":
        n = int(value)
        return head + (b"i" + struct.pack("<i", n) if -(1 << 31) <= n < 1 << 31 else b"I" + struct.pack("<I", n))
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "A":
        return head + b"A" + value.encode()
    if kind == "B":
        sub, *values = value.split(",")
        number = float if sub == "f" else int
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{NUMBERS[sub]}", len(values), *map(number, values))
    return head + kind.encode() + value.encode() + b"\0"


def encode(row: dict) -> bytes:
    """One record with its size."""
    ops, number = [], 0
    for ch in row["cigar"] if row["cigar"] not in (None, "*") else "":
        if ch.isdigit():
            number = number * 10 + int(ch)
        else:
            ops.append((number, ch))
            number = 0
    span = sum(n for n, op in ops if op in "MDN=X") or 1
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = [max(BASES.find(b.upper()), 0) if b.upper() in BASES else 15 for b in seq] + [0] * (len(seq) % 2)
    bases = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else bytes(q - 33 for q in row["qual"].encode())
    name = row["qname"].encode() + b"\0"
    pos = row["pos"]
    body = struct.pack("<iiBBHHHiiii", row["tid"], pos, len(name), row["mapq"], _bin(max(pos, 0), max(pos, 0) + span) if pos >= 0 else 4680, len(ops), row["flag"], len(seq), row["mtid"], row["mpos"], row["tlen"])
    body += name + struct.pack(f"<{len(ops)}I", *[n << 4 | OPS.index(op) for n, op in ops]) + bases + qual + b"".join(map(_packed, row["tags"] or []))
    return struct.pack("<i", len(body)) + body


def blocks(data: bytes) -> bytes:
    """Bytes as BGZF blocks."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        deflater = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflater.compress(part) + deflater.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def head(header: Header) -> bytes:
    text = header.text().encode()
    refs = header.references
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)


def write_bam(reads: DataFrame, header: Header, path: str) -> list[str]:
    """Writes a folder of parts in file order, of which the names are returned: header, rows and end mark; their concatenation is a BAM
    file. Parts of repeated tasks are overwritten by equal ones."""
    system, root = opened(path)
    system.create_dir(root, recursive=True)
    columns = [c for c in ("qname", "flag", "tid", "pos", "mapq", "cigar", "mtid", "mpos", "tlen", "seq", "qual", "tags")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        target, base = opened(path)
        name = f"part-{TaskContext.get().partitionId() + 1:05d}.bam"
        with target.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                out.write(blocks(b"".join(encode(row) for row in batch.select(columns).to_pylist())))
        yield pa.RecordBatch.from_pydict({"name": pa.array([name])})

    with system.open_output_stream(f"{root}/part-00000.bam", compression=None) as out:
        out.write(blocks(head(header)))
    spread = reads.select("idx", *columns).repartitionByRange("idx").sortWithinPartitions("idx")
    parts = sorted(r.name for r in spread.mapInArrow(write, "name string").collect())
    with system.open_output_stream(f"{root}/part-99999-end.bam", compression=None) as out:
        out.write(END_OF_FILE)
    return ["part-00000.bam", *parts, "part-99999-end.bam"]


def count_placed(reads: DataFrame) -> DataFrame:
    """Reads per reference sequence: tid, mapped and unmapped counts, as an index's statistics have them."""
    return reads.groupBy("tid").agg(F.count_if(F.col("flag").bitwiseAND(F.lit(4)) == 0).alias("mapped"), F.count_if(F.col("flag").bitwiseAND(F.lit(4)) != 0).alias("unmapped"))
