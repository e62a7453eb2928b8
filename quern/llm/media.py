"""Media columns: what bytes are by their signatures, not by their declared type.

``sniff`` finds magic bytes anywhere in a blob with one Aho-Corasick automaton; a validator of each format then checks
structure and lengths, so chance hits fall away.  The valid format that starts at byte 0 corrects the declared type; valid
formats further in, and within the samples of a WAV file, are embedded media and are carved.  Formats that are closed by a record at their end (PDF, ZIP) are
found from that record, which says where its file starts, so time doesn't grow with the square of the number of hits.

``encode_wav`` stores texts losslessly as 8-bit samples; the query writes these, reads them back, sniffs and carves them and takes features.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table

BLOCK = 64
SAMPLE_RATE = 8000
#: Fixed values of the formats: (type, magic bytes, offset of the magic from the start of the file).
SIGNATURES = [
    ("audio/wav", b"RIFF", 0),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/bmp", b"BM", 0),
    ("application/pdf", b"%PDF-", 0),
    ("application/zip", b"PK\x03\x04", 0),
    ("application/gzip", b"\x1f\x8b\x08", 0),
    ("audio/flac", b"fLaC", 0),
    ("application/ogg", b"OggS", 0),
]
#: Fixed values of the formats: magic bytes of the records that close a file.
CLOSING = [("application/pdf", b"%%EOF"), ("application/zip", b"PK\x05\x06")]
#: Longest name or comment of a gzip header that is read.
GZIP_NAME = 4096


# -- validators: (blob, start) -> length of the valid file from start, or 0 ---------------------


def wav_chunks(b: bytes, at: int) -> dict[bytes, tuple[int, int]]:
    """Chunk id -> (start, length) of a RIFF WAVE file, {} if it is broken."""
    if len(b) - at < 12 or b[at : at + 4] != b"RIFF" or b[at + 8 : at + 12] != b"WAVE":
        return {}
    end, p, out = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, {}
    if end > len(b):
        return {}
    while p + 8 <= end:
        n = struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return {}
        out[b[p : p + 4]] = (p + 8, n)
        p += 8 + n + n % 2
    return out


def _wav(b: bytes, at: int) -> int:
    c = wav_chunks(b, at)
    return 8 + struct.unpack_from("<I", b, at + 4)[0] if b"fmt " in c and b"data" in c and c[b"fmt "][1] >= 16 else 0


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first and (kind, n) != (b"IHDR", 13) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) - at < 14:
        return 0
    flags, p = b[at + 10], at + 13
    p += 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21:
            p = blocks(p + 2)
        elif kind == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1)
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return 0
        p += 2 + n
        if kind == 0xDA:
            while True:  # entropy-coded data: up to the next marker that is neither stuffed nor a restart
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return p + 2 - at if b[p : p + 2] == b"\xff\xd9" else 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) - at < 26:
        return 0
    n, reserved, data, head = struct.unpack_from("<IIII", b, at + 2)
    if reserved or head not in (12, 40, 52, 56, 64, 108, 124) or not 14 + head <= data <= n <= len(b) - at:
        return 0
    if head == 12:
        width, height, planes, bits = struct.unpack_from("<HHHH", b, at + 18)
    else:
        width, height, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    plain = head == 12 or struct.unpack_from("<I", b, at + 30)[0] == 0
    pixels = (width * bits + 31) // 32 * 4 * abs(height) if plain else 0
    return n if planes == 1 and width > 0 and bits in (1, 4, 8, 16, 24, 32) and data + pixels <= n else 0


def _object_before(b: bytes, low: int, high: int) -> int:
    """Where the last "number number obj" of the stretch starts, -1 without any."""
    p = b.rfind(b" obj", low, high)
    m = re.search(rb"\d{1,10} \d{1,5}$", b[max(low, p - 16) : p]) if p >= 0 else None
    return max(low, p - 16) + m.start() if m else -1


def pdf_ends(b: bytes, headers: list[int], closings: list[int]) -> dict[int, int]:
    """Header -> end of the PDF file that starts there.

    The offset before a closing record points to the file's cross-reference section, the last one before the record (or, in a linearised file, one after the
    nearest header): that tells where the file starts.  A file with later updates ends with the last of its records.
    """
    out, starts, low = {}, set(headers), 0
    for e in closings:
        s = b.rfind(b"startxref", max(low, e - 64), e)
        m = re.fullmatch(rb"startxref\s+(\d{1,15})\s*", b[s:e]) if s >= 0 else None
        if m and (v := int(m[1])):
            x = b.rfind(b"xref", low, s)
            near = bisect.bisect_right(headers, e) - 1
            places = [x - v if x >= 0 else -1, _object_before(b, low, s) - v]
            if near >= 0 and re.match(rb"xref|\d{1,10} \d{1,5} obj", b[headers[near] + v : headers[near] + v + 24]):
                places.append(headers[near])
            for at in places:
                if at in starts and at + v < s and b[at + 5 : at + 6].isdigit():
                    out[at] = e + 5
        low = e + 5
    return out


def zip_ends(b: bytes, headers: list[int], closings: list[int]) -> dict[int, int]:
    """Header -> end of the ZIP file that starts there: the closing record tells where, every entry of its directory must point to a local header of that name."""
    out, starts = {}, set(headers)
    for e in closings:
        if e + 22 > len(b):
            continue
        n, size, offset, note = struct.unpack_from("<HIIH", b, e + 10)
        at, p = e - size - offset, e - size
        if at not in starts or e + 22 + note > len(b):
            continue
        while n and p + 46 <= e and b[p : p + 4] == b"PK\x01\x02":
            packed, name, extra, comment, local = *struct.unpack_from("<I", b, p + 20), *struct.unpack_from("<HHH", b, p + 28), at + struct.unpack_from("<I", b, p + 42)[0]
            if b[local : local + 4] != b"PK\x03\x04" or b[local + 30 : local + 30 + name] != b[p + 46 : p + 46 + name] or local + 30 + name + packed > e - size:
                break
            n, p = n - 1, p + 46 + name + extra + comment
        if n == 0 and p == e:
            out[at] = e + 22 + note
    return out


def _gzip(b: bytes, at: int) -> int:
    if len(b) - at < 18 or b[at + 3] & 0xE0:
        return 0
    flags, p = b[at + 3], at + 10
    if flags & 4:
        p += 2 + struct.unpack_from("<H", b, p)[0]
    for bit in (8, 16):
        if flags & bit and not (p := b.find(b"\0", p, p + GZIP_NAME) + 1):
            return 0
    p += 2 if flags & 2 else 0
    d, crc, size = zlib.decompressobj(-15), 0, 0
    try:
        while p < len(b) and not d.eof:
            part = b[p : p + 65536]
            p += len(part)
            while part and not d.eof:  # a piece at a time, however much it unpacks to
                data = d.decompress(part, 1 << 20)
                crc, size, part = zlib.crc32(data, crc), size + len(data), d.unconsumed_tail
    except zlib.error:
        return 0
    p -= len(d.unused_data)
    return p + 8 - at if d.eof and p + 8 <= len(b) and struct.unpack_from("<II", b, p) == (crc, size & 0xFFFFFFFF) else 0


@cache
def _crc_table(poly: int, bits: int) -> list[int]:
    """Remainders of each byte for a CRC that takes the high bit first."""
    out, top = [], 1 << bits - 1
    for v in range(256):
        r = v << bits - 8
        for _ in range(8):
            r = (r << 1 ^ poly if r & top else r << 1) & (1 << bits) - 1
        out.append(r)
    return out


def _flac_frame(b: bytes, p: int) -> tuple[int, int] | None:
    """(samples, length of the header) of the frame that starts at ``p``; None where its header or the header's CRC is broken."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 3] & 1 or b[p + 3] >> 4 > 10:
        return None
    size, rate = b[p + 2] >> 4, b[p + 2] & 15
    number = next((k for k, top in enumerate((0x80, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE, 0xFF)) if b[p + 4] & top != top), 8)
    q = p + 4 + max(number, 1)
    if size == 0 or rate == 15 or q + 5 > len(b):
        return None
    if size in (6, 7):
        samples = int.from_bytes(b[q : q + size - 5], "big") + 1
        q += size - 5
    else:
        samples = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    q += 1 if rate == 12 else 2 if rate in (13, 14) else 0
    crc, table = 0, _crc_table(0x07, 8)
    for x in b[p:q]:
        crc = table[crc ^ x]
    return (samples, q + 1 - p) if q < len(b) and crc == b[q] else None


def _flac(b: bytes, at: int) -> int:
    """Frames are walked one by one: each ends where its CRC comes out and the next one starts, the last one with the sample count of the header."""
    if len(b) - at < 42 or b[at + 4] & 0x7F or int.from_bytes(b[at + 5 : at + 8], "big") != 34:
        return 0
    largest, fields = int.from_bytes(b[at + 15 : at + 18], "big"), int.from_bytes(b[at + 18 : at + 26], "big")
    channels, bits, total = (fields >> 41 & 7) + 1, (fields >> 36 & 31) + 1, fields & (1 << 36) - 1
    p, last = at + 4, 0
    while not last and p + 4 <= len(b):
        last, p = b[p] & 0x80, p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")
    done, table = 0, _crc_table(0x8005, 16)
    while last and (frame := _flac_frame(b, p)):
        done += frame[0]
        limit = min(len(b), p + (largest or frame[0] * channels * (bits + 1) // 8 + 64))
        crc, ends, after = 0, [], None
        for e in range(p, limit):
            crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ b[e]]
            if crc == 0 and e + 1 >= p + frame[1] + 3:  # a whole frame with its CRC leaves nothing
                if _flac_frame(b, e + 1) and not (total and done >= total):
                    after = e + 1
                    break
                ends.append(e + 1)
        if after is None:
            ends = ends if not total or done >= total else []
            return (len(b) if len(b) in ends else ends[0]) - at if ends else 0
        p = after
    return 0


def _ogg(b: bytes, at: int) -> int:
    p = at
    while len(b) - p >= 27 and b[p : p + 5] == b"OggS\0":
        n = b[p + 26]
        stop = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + 27 + n > len(b) or stop > len(b):
            return 0
        last, p = b[p + 5] & 4, stop
        if last:
            return p - at
    return 0


VALIDATORS = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/gzip": _gzip, "audio/flac": _flac, "application/ogg": _ogg}


@cache
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, magic, offset in SIGNATURES:
        out.add_word(magic.decode("latin-1"), (kind, len(magic), offset))
    for kind, magic in CLOSING:
        out.add_word(magic.decode("latin-1"), (kind, len(magic), None))
    out.make_automaton()
    return out


def find_media(blob: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of every valid file in the blob, outermost first; none lies within another."""
    out, end, starts, closings = [], 0, [], {k: [] for k, _ in CLOSING}
    for stop, (kind, n, offset) in _automaton().iter(blob.decode("latin-1")):
        if offset is None:
            closings[kind].append(stop + 1 - n)
        else:
            starts.append((stop + 1 - n - offset, kind))
    own = lambda kind: [s for s, k in starts if k == kind]
    ends = {kind: f(blob, own(kind), closings[kind]) for kind, f in (("application/pdf", pdf_ends), ("application/zip", zip_ends)) if closings[kind]}
    for start, kind in sorted(starts):
        if start >= end and (n := VALIDATORS[kind](blob, start) if kind in VALIDATORS else ends.get(kind, {}).get(start, start) - start):
            out.append((start, n, kind))
            end = start + n
    return out


def samples_of(blob: bytes) -> tuple[int, int]:
    """Where the samples of a valid WAV file start, and how many bytes they are."""
    return wav_chunks(blob, 0)[b"data"]


MEDIA = T.StructType([
    T.StructField("media_type", T.StringType()), T.StructField("declared_ok", T.BooleanType()),
    T.StructField("carved", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType()), T.StructField("bytes", T.BinaryType())]))),
])


def sniff(df: DataFrame, blob: str = "media", declared: str | None = None) -> DataFrame:
    """``df`` with media_type (the validated type at byte 0; application/octet-stream if none), declared_ok and carved.

    ``carved`` has the files embedded further in, and those within the samples of a WAV file at byte 0, with their bytes.  A null blob has null results, an empty one is
    octet-stream.  Without a ``declared`` column declared_ok is null.  Columns of ``df`` that have the name of a result are replaced; other columns may have any name and type.
    """
    df = df.drop("media_type", "declared_ok", "carved")
    schema = T.StructType([*df.schema.fields, *MEDIA.fields])
    names = df.columns
    k, m = names.index(blob), names.index(declared) if declared else None
    carved_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, oks, carved = [], [], []
            for i, b in enumerate(batch.column(k)):
                b = b.as_py()
                found = [] if b is None else find_media(b)
                kind = None if b is None else found[0][2] if found and found[0][0] == 0 else "application/octet-stream"
                if kind == "audio/wav":
                    at, n = samples_of(b)
                    found = [(at + s, c, t) for s, c, t in find_media(b[at : at + n])] + found[1:]
                said = batch.column(m)[i].as_py() if m is not None else None
                kinds.append(kind)
                oks.append(None if said is None or kind is None else said == kind)
                carved.append(None if b is None else [{"start": s, "length": n, "type": t, "bytes": b[s : s + n]} for s, n, t in found if s])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(oks, pa.bool_()), pa.array(carved, carved_type)], names=[*names, "media_type", "declared_ok", "carved"])

    return df.mapInArrow(run, schema)


# -- texts as 8-bit samples ----------------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of BLOCK."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def wav_of(payload: bytes) -> bytes:
    """Mono 8-bit PCM, one sample for each byte; payloads have even lengths, so no padding byte is needed."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def encode_wav(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, declared_type, media): every text stored as a WAV file of its bytes, declared as one; null counts as empty."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([wav_of(payload_of(t)) for t in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    stored = docs.select(F.col(id_col), F.col(text).alias("text")).mapInArrow(run, schema)
    return stored.select(F.col(id_col), "n_bytes", F.lit("audio/wav").alias("declared_type"), "media")


FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def stored_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read stored media (id, n_bytes, declared_type, media) back: types are sniffed and corrected, embedded files carved, the samples taken out of the data chunk, and digests taken.

    The feature names the validated type, where the samples lie, the files embedded within the samples (type@offset+length) and the mean, the least and the greatest
    sample.  A null medium has null features; one that is not a whole WAV file as declared is an error, as reading back must not go on with damaged files.
    """
    import numpy as np

    names = [id_col, "n_bytes", *FEATURES]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([stored.schema[id_col], T.StructField("n_bytes", T.LongType()), *[T.StructField(n, t) for n, t in zip(FEATURES, kinds, strict=True)]])

    def one(media: bytes | None, ok: bool | None, carved: list | None) -> tuple:
        if media is None:
            return (None,) * len(FEATURES)
        if not ok:
            raise ValueError("stored media is not one whole WAV file")
        start, size = samples_of(media)
        payload = media[start : start + size]
        inner = ",".join(f"{c['type']}@{c['start'] - start}+{c['length']}" for c in carved)
        x = np.frombuffer(payload, np.uint8)
        feature = f"audio/wav;data={start}+{size};embedded={inner};mean={int(x.sum(dtype=np.int64)) * 1000 // size};min={x.min()};max={x.max()}"
        return size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = [one(m.as_py(), ok.as_py(), c.as_py()) for m, ok, c in zip(*batch.columns[2:], strict=True)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)

    known = sniff(stored.select(F.col(id_col), "n_bytes", "media", "declared_type"), declared="declared_type")
    carved = F.transform("carved", lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"), c["type"].alias("type")))
    return known.select(F.col(id_col), "n_bytes", "media", (F.col("declared_ok") & (F.col("media_type") == "audio/wav")).alias("ok"), carved.alias("carved")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(materialize(encode_wav(table(spark, sf_dir, "documents")), "media"))
