"""Binary alignments: BAM in blocks of compressed members, decoded and encoded over Arrow batches of whole files.

A file is one row of ``binaryFile`` (2 GB at most, Spark's bound for a
value), so a cohort is read file by file, side by side. Larger files are to
be split by contig first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

SCHEMA = "qname string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual string, tags map<string,string>"
#: Fixed values of the format: operations, bases, and the empty last block.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_SIZES = {"c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def inflate(data: bytes) -> bytes:
    """All members of a blocked file, or the data itself if it isn't compressed."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def deflate(data: bytes) -> bytes:
    """Blocks of the format (64 KB at most, each with its own size), and the empty last one."""
    out = []
    for at in range(0, len(data), 0xFF00):
        part = data[at : at + 0xFF00]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + END_BLOCK


def header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """(text, contigs with lengths, where the records begin) of an inflated file."""
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    n, = struct.unpack_from("<i", data, 4)
    text = data[8 : 8 + n].rstrip(b"\0").decode()
    at = 8 + n
    contigs, = struct.unpack_from("<i", data, at)
    at += 4
    out = []
    for _ in range(contigs):
        size, = struct.unpack_from("<i", data, at)
        name = data[at + 4 : at + 3 + size].decode()
        length, = struct.unpack_from("<i", data, at + 4 + size)
        out.append((name, length))
        at += 8 + size
    return text, out, at


#: Tables between a base and the hexadecimal digit of its code, and between qualities and their characters.
_DIGITS = str.maketrans(dict.fromkeys("0123456789abcdefEF", "x") | dict(zip(BASES, "0123456789abcdef")))  # what is no base is no digit either
_LETTERS = str.maketrans("0123456789abcdef", BASES)
_UP, _DOWN = bytes((k + 33) % 256 for k in range(256)), bytes((k - 33) % 256 for k in range(256))


@lru_cache(1 << 14)
def _cigar_text(data: bytes) -> str:
    return "".join(f"{v >> 4}{OPS[v & 15]}" for v in struct.unpack(f"<{len(data) // 4}I", data)) or "*"


@lru_cache(1 << 14)
def _cigar_bytes(cigar: str) -> bytes:
    ops, n = [], ""
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            n += c
        else:
            ops.append(int(n) << 4 | OPS.index(c))
            n = ""
    return struct.pack(f"<{len(ops)}I", *ops)


@lru_cache(1 << 14)
def _tag_bytes(tags: tuple) -> bytes:
    return b"".join(k.encode() + (b"i" + struct.pack("<i", int(v)) if v.lstrip("-").isdigit() and abs(int(v)) < 1 << 31 else b"Z" + v.encode() + b"\0") for k, v in tags)


@lru_cache(1 << 14)
def _tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in _CODES:
            out[name] = str(struct.unpack_from(_CODES[kind], data, at)[0])
            at += _SIZES[kind]
        elif kind == "A":
            out[name], at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, (n,) = chr(data[at]), struct.unpack_from("<i", data, at + 1)
            at += 5
            out[name] = ",".join([sub, *(str(struct.unpack_from(_CODES[sub], data, at + k * _SIZES[sub])[0]) for k in range(n))])
            at += n * _SIZES[sub]
        else:
            raise ValueError(f"tag of kind {kind!r}")
    return out


def records(data: bytes) -> Iterator[tuple]:
    """The records of a BAM file's bytes, as rows of SCHEMA."""
    data = inflate(data)
    _, contigs, at = header(data)
    while at + 4 <= len(data):
        size, ref, pos, name, mapq, _, ops, flag, length, *_rest = struct.unpack_from("<iiiBBHHHiiii", data, at)
        end, p = at + 4 + size, at + 36
        qname = data[p : p + name - 1].decode()
        p += name
        cigar = _cigar_text(data[p : p + 4 * ops])
        p += 4 * ops
        packed = data[p : p + (length + 1) // 2]
        seq = packed.hex().translate(_LETTERS)[:length] or "*"
        p += (length + 1) // 2
        raw = data[p : p + length]
        qual = "*" if not length or raw[0] == 255 else raw.translate(_UP).decode()
        yield qname, flag, contigs[ref][0] if ref >= 0 else None, pos, mapq, cigar, seq, qual, dict(_tags(data[p + length : end]))
        at = end


def pack(rows: Iterator[tuple], contigs: list[tuple[str, int]], text: str = "") -> bytes:
    """A BAM file's bytes of rows of SCHEMA; tags that are whole numbers are written as such, others as text."""
    number = {name: k for k, (name, _) in enumerate(contigs)}
    raw = text.encode()
    out = [b"BAM\x01", struct.pack("<i", len(raw)), raw, struct.pack("<i", len(contigs))]
    for name, length in contigs:
        out.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length))
    for qname, flag, contig, pos, mapq, cigar, seq, qual, tags in rows:
        ops = _cigar_bytes(cigar)
        bases = "" if seq == "*" else seq
        digits = bases.translate(_DIGITS) + "0" * (len(bases) % 2)
        quals = b"\xff" * len(bases) if qual == "*" else qual.encode().translate(_DOWN)
        extra = _tag_bytes(tuple(sorted(dict(tags or {}).items())))
        body = struct.pack("<iiBBHHHiiii", number.get(contig, -1), pos, len(qname) + 1, mapq, 0, len(ops) // 4, flag, len(bases), -1, -1, 0)
        body += qname.encode() + b"\0" + ops + bytes.fromhex(digits) + quals + extra
        out.append(struct.pack("<i", len(body)) + body)
    return deflate(b"".join(out))


def decode(files: DataFrame) -> DataFrame:
    """The records of files (``content``)."""

    kind = to_arrow_schema(T.DataType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            columns[-1] = [list(t.items()) for t in columns[-1]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        for some in batches:
            for content in some.column("content"):
                held = []
                for row in records(content.as_py()):
                    held.append(row)
                    if len(held) == 20_000:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    return files.select("content").mapInArrow(run, SCHEMA)


def bam(spark: SparkSession, path: str) -> DataFrame:
    """The records of BAM files: qname, flag, contig, pos (0-based), mapq, cigar, seq, qual, tags."""
    return decode(spark.read.format("binaryFile").load(path))


def bam_header(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The contigs and lengths of a BAM file."""
    return header(inflate(spark.read.format("binaryFile").load(path).first()["content"]))[1]


#: Records of one file at most: a file is a value of a row, and is packed and read in memory.
FILE_RECORDS = 100_000


def encode(alignments: DataFrame, contigs: list[tuple[str, int]], text: str = "") -> DataFrame:
    """part, content: BAM files of every partition's rows, in their order, of FILE_RECORDS each; ``part`` follows the partitions and the order in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        first = True
        while (few := list(islice(rows, FILE_RECORDS))) or first:
            content = pack(iter(few), contigs, text)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([content], pa.binary())], names=["part", "content"])
            part, first = part + 1, False

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return alignments.select(*names).mapInArrow(run, "part long, content binary")


def joined(files: DataFrame) -> bytes:
    """One BAM file of several in the order of ``part``, their headers being the same; for files that a driver can hold."""
    parts = [inflate(r["content"]) for r in files.orderBy("part").collect()]
    return deflate(b"".join(p if k == 0 else p[header(p)[2] :] for k, p in enumerate(parts)))
