"""Media columns: signature sniffing, validation and carving.

An Aho-Corasick automaton locates the magic bytes of the known formats
anywhere in a binary value; each hit is then confirmed by its format's own
structure (chunk chains, declared lengths, checksums, end markers), which
also yields where the object ends. The object that starts at offset 0
corrects the declared type; further ones are embedded media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from plexframe.llm.batches import clash_free, with_batches

#: Magic bytes of the formats and where in the object they lie.
MAGIC = {
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/gif": (b"GIF8", 0),
    "image/bmp": (b"BM", 0),
    "audio/wav": (b"WAVEfmt ", 8),
    "audio/flac": (b"fLaC", 0),
    "application/ogg": (b"OggS", 0),
    "application/pdf": (b"%PDF-", 0),
    "application/zip": (b"PK\x03\x04", 0),
    "application/gzip": (b"\x1f\x8b\x08", 0),
    "video/mp4": (b"ftyp", 4),
}
#: Payloads are padded with this byte to a positive multiple of BLOCK bytes.
PAD, BLOCK = 255, 576
RATE = 8000


@cache
def _locator() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (magic, back) in MAGIC.items():
        out.add_word(magic.decode("latin-1"), (kind, len(magic) + back - 1))
    out.make_automaton()
    return out


def _png(d: bytes, at: int) -> int:
    pos = at + 8
    while pos + 12 <= len(d):
        size, = struct.unpack_from(">I", d, pos)
        end = pos + 12 + size
        if end > len(d) or zlib.crc32(d[pos + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return 0
        if d[pos + 4 : pos + 8] == b"IEND":
            return end
        pos = end
    return 0


def _jpeg(d: bytes, at: int) -> int:
    pos = at + 2
    while pos + 2 <= len(d) and d[pos] == 0xFF:
        mark = d[pos + 1]
        if mark == 0xD9:
            return pos + 2
        if pos + 4 > len(d):
            return 0
        pos += 2 + struct.unpack_from(">H", d, pos + 2)[0]
        if mark == 0xDA:  # entropy-coded data up to the next marker that isn't stuffing or a restart
            while (pos := d.find(b"\xff", pos)) >= 0 and pos + 1 < len(d) and (d[pos + 1] == 0 or 0xD0 <= d[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return 0
    return 0


def _gif(d: bytes, at: int) -> int:
    if d[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(d):
        return 0
    pos = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 128 else 0)
    while pos < len(d):
        kind = d[pos]
        if kind == 0x3B:
            return pos + 1
        if kind == 0x2C and pos + 10 < len(d):
            pos += 11 + (3 << (d[pos + 9] & 7) + 1 if d[pos + 9] & 128 else 0)
        elif kind == 0x21:
            pos += 2
        else:
            return 0
        while pos < len(d) and d[pos]:
            pos += 1 + d[pos]
        pos += 1
    return 0


def _bmp(d: bytes, at: int) -> int:
    if at + 30 > len(d):
        return 0
    size, reserved, first, header = struct.unpack_from("<IIII", d, at + 2)
    planes, = struct.unpack_from("<H", d, at + 26)
    return at + size if header in (12, 40, 52, 56, 108, 124) and not reserved and planes == 1 and 14 + header <= first <= size <= len(d) - at else 0


def _wav(d: bytes, at: int) -> int:
    if d[at : at + 4] != b"RIFF" or at + 44 > len(d):
        return 0
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    return end if end <= len(d) and wav_data(d, at, end) else 0


def wav_data(d: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Where the samples of a WAV object lie: walks its chunks."""
    pos = at + 12
    while pos + 8 <= end:
        size, = struct.unpack_from("<I", d, pos + 4)
        if d[pos : pos + 4] == b"data":
            return (pos + 8, pos + 8 + size) if pos + 8 + size <= end else None
        pos += 8 + size + (size & 1)
    return None


class _Next:
    """Where a mark comes next in one object's bytes: hits are asked for in order, so every byte is searched once."""

    def __init__(self, data: bytes):
        self.data, self.found, self.dead = data, {}, set()  # dead: pages of streams that don't end

    def __call__(self, mark: bytes, at: int) -> int:
        """The mark's first place from ``at`` on, -1 if there is none."""
        last, place = self.found.get(mark, (0, -2))
        if not (last <= at and (place == -1 or place >= at)):
            place = self.data.find(mark, at)
            self.found[mark] = (at, place)
        return place


def _zip(d: bytes, at: int, following: _Next) -> int:
    pos = following(b"PK\x05\x06", at)
    if pos < 0 or pos + 22 > len(d):
        return 0
    size, offset, comment = struct.unpack_from("<IIH", d, pos + 12)
    return pos + 22 + comment if pos + 22 + comment <= len(d) and at + offset + size == pos else 0


def _gzip(d: bytes, at: int) -> int:
    reader = zlib.decompressobj(31)
    try:
        for pos in range(at, len(d), 1 << 16):
            reader.decompress(d[pos : pos + (1 << 16)], 1 << 20)
            while reader.unconsumed_tail:
                reader.decompress(reader.unconsumed_tail, 1 << 20)
            if reader.eof:
                return min(len(d), pos + (1 << 16)) - len(reader.unused_data)
    except zlib.error:
        pass
    return 0


def _pdf(d: bytes, at: int, following: _Next) -> int:
    end, table = following(b"%%EOF", at), following(b"startxref", at)
    return end + 5 if d[at + 5 : at + 6].isdigit() and 0 <= table <= end - 9 else 0


def _flac(d: bytes, at: int) -> int:
    return len(d) if d[at + 4 : at + 8] in (b"\x00\x00\x00\x22", b"\x80\x00\x00\x22") and at + 42 <= len(d) else 0


def _ogg(d: bytes, at: int, following: _Next) -> int:
    pos, pages = at, []
    while pos not in following.dead and d[pos : pos + 5] == b"OggS\x00" and pos + 27 <= len(d):
        pages.append(pos)
        n = d[pos + 26]
        end = pos + 27 + n + sum(d[pos + 27 : pos + 27 + n])
        if end > len(d):
            break
        last, pos = d[pos + 5] & 4, end
        if last:
            return pos
    following.dead.update(pages)
    return 0


def _mp4(d: bytes, at: int) -> int:
    pos, boxes = at, 0
    while pos + 8 <= len(d):
        size, = struct.unpack_from(">I", d, pos)
        if size < 8 or pos + size > len(d) or not d[pos + 4 : pos + 8].isalnum():
            break
        pos, boxes = pos + size, boxes + 1
    return pos if boxes > 1 else 0


#: Formats whose validators look far ahead and so remember what they saw.
_SEARCHING = ("application/pdf", "application/zip", "application/ogg")
_VALID = dict(zip(MAGIC, (_png, _jpeg, _gif, _bmp, _wav, _flac, _ogg, _pdf, _zip, _gzip, _mp4), strict=True))


def carve(data: bytes | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of the confirmed objects, outermost first; nothing inside another object is reported twice by its own format."""
    found: list[tuple[str, int, int]] = []
    inside: dict[str, int] = {}
    following = _Next(data or b"")
    for last, (kind, back) in _locator().iter((data or b"").decode("latin-1")):
        start = last - back
        if start >= inside.get(kind, 0) and (end := _VALID[kind](data, start, *([following] if kind in _SEARCHING else []))):
            found.append((kind, start, end))
            inside[kind] = end
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def sniff(df: DataFrame, data_col: str, declared_col: str | None = None) -> DataFrame:
    """Appends media_type, declared_ok, and embedded (array of type, start, end).

    media_type is the confirmed object at offset 0, else
    application/octet-stream; null data has null type. declared_ok is null
    without a declared type. Columns of these names in ``df`` are replaced.
    """
    span = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = T.StructType([T.StructField("media_type", T.StringType()), T.StructField("declared_ok", T.BooleanType()), T.StructField("embedded", T.ArrayType(span))])
    kept = clash_free(df.schema, added.fieldNames())
    schema = T.StructType([*kept, *added.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            kinds, good, rest = [], [], []
            said = batch.column(declared_col).to_pylist() if declared_col else [None] * batch.num_rows
            for d, declared in zip(batch.column(data_col), said, strict=True):
                data = d.as_py()
                spans = carve(data)
                top = next((k for k, a, _ in spans if a == 0), "application/octet-stream")
                kinds.append(None if data is None else top)
                good.append(None if data is None or declared is None else declared.lower() == top)
                rest.append([{"type": k, "start": a, "end": b} for k, a, b in spans if a > 0])
            new = [pa.array(v, type=f.type) for v, f in zip((kinds, good, rest), list(arrow)[len(kept) :], strict=True)]
            columns = [batch.column(f.name).cast(arrow.field(f.name).type) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=arrow.names)

    return df.mapInArrow(run, schema)


def payload(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % BLOCK if text else BLOCK)


def wav(samples: bytes) -> bytes:
    """A mono 8-bit PCM WAV object that holds the samples as they are."""
    return struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVEfmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def read_back(stored: bytes) -> bytes:
    """The samples of the WAV object that the sniffer confirms at offset 0."""
    kind, start, end = next(x for x in carve(stored) if x[:2] == ("audio/wav", 0))
    a, b = wav_data(stored, start, end)
    return stored[a:b]


def encode(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Appends ``media``: each text's payload as a WAV object (null text as empty)."""

    def make():
        return lambda batch: {"media": [wav(payload((t or "").encode())) for t in batch.column(text_col).to_pylist()]}

    return with_batches(docs, text_col, make, T.StructType([T.StructField("media", T.BinaryType())]))


def describe(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Stores each text as a WAV object, sniffs and reads it back, and appends what was read.

    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 and feature (type, sample count, mean, standard deviation,
    mean absolute step, count of embedded objects). Null and empty texts are
    one block of padding, very long ones are stored whole, repeated rows each
    return (equal texts with equal values), an empty table stays empty.
    Columns of these names in ``docs`` are replaced.
    """
    long, string = T.LongType(), T.StringType()
    added = T.StructType([T.StructField(n, k) for n, k in (("n_bytes", long), ("payload_bytes", long), ("payload_sha256", string), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", string), ("feature", string))])

    def make():
        def one(text: str | None) -> tuple:
            raw = (text or "").encode()
            stored = wav(payload(raw))
            spans = carve(stored)
            top = next(x for x in spans if x[1] == 0)
            a, b = wav_data(stored, top[1], top[2])
            back = stored[a:b]
            x = np.frombuffer(back, np.uint8)
            step = np.abs(np.diff(x.astype(np.int16)))
            feature = f"{top[0]};samples={len(x)};mean={x.mean():.4f};sd={x.std():.4f};step={step.mean():.4f};embedded={len(spans) - 1}"
            return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

        return lambda batch: dict(zip(added.fieldNames(), map(list, zip(*[one(t) for t in batch.column(text_col).to_pylist()], strict=True)), strict=True))

    return with_batches(docs, text_col, make, added)
