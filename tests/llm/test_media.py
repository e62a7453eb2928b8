import hashlib
import io
import struct
import zipfile
import zlib

from quern.llm import media as M


def png(data=b"\0\0"):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0\x3b"
BMP = b"BM" + struct.pack("<IIIIIIHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"


def a_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b" * 100)
    return out.getvalue()


WHOLE = {"image/png": png(), "image/gif": GIF, "image/bmp": BMP, "application/pdf": PDF, "application/zip": a_zip(), "application/gzip": zlib.compress(b"x" * 500, wbits=31), "audio/wav": M.wav_of(M.payload_of(b"abc"))}


def test_formats_are_found_whole_and_not_when_cut():
    WHOLE["audio/flac"] = a_flac()
    for kind, blob in WHOLE.items():
        assert M.find_media(blob) == [(0, len(blob), kind)], kind
        assert M.find_media(blob[:-1]) == [] or kind == "image/bmp" and False, kind
        assert M.find_media(b"noise BM GIF89a RIFF" + blob + b"tail")[0] == (20, len(blob), kind), kind


def a_pdf(body=b"1 0 obj\n<<>>\nendobj\n", updates=0):
    out = b"%PDF-1.4\n" + body
    for k in range(updates + 1):
        at = len(out)
        out += b"xref\n0 1\n0000000000 65535 f \ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % at + (b"\n" if k < updates else b"")
    return out


def crc(data, poly, bits):
    r = 0
    for x in data:
        r ^= x << bits - 8
        for _ in range(8):
            r = (r << 1 ^ poly if r >> bits - 1 else r << 1) & (1 << bits) - 1
    return r


def a_flac(frames=3, size=192):
    info = struct.pack(">HH", size, size) + bytes(6) + ((8000 << 44) | (0 << 41) | (7 << 36) | frames * size).to_bytes(8, "big") + bytes(16)
    out = b"fLaC\x80\0\0\x22" + info
    for k in range(frames):
        head = b"\xff\xf8\x14\x02" + bytes([k])  # 192 samples, 8 kHz, one channel of 8 bits
        head += bytes([crc(head, 0x07, 8)])
        frame = head + bytes([0, 17 + k])  # a constant subframe
        out += frame + crc(frame, 0x8005, 16).to_bytes(2, "big")
    return out


def test_files_end_where_they_say():
    two, z, f = a_pdf(), a_zip(), a_flac()
    assert M.find_media(two + a_pdf(updates=2)) == [(0, len(two), "application/pdf"), (len(two), len(a_pdf(updates=2)), "application/pdf")]
    assert M.find_media(f + png()) == [(0, len(f), "audio/flac"), (len(f), len(png()), "image/png")]
    assert M.find_media(f[:-1]) == [] and M.find_media(f[:60] + b"x" + f[61:]) == []
    jar = io.BytesIO()
    with zipfile.ZipFile(jar, "w") as out:
        out.writestr("inner.zip", z)  # stored, so that its closing record comes first
    assert M.find_media(b"xx" + jar.getvalue() + z) == [(2, len(jar.getvalue()), "application/zip"), (2 + len(jar.getvalue()), len(z), "application/zip")]
    junk = b"PK\x03\x04" + bytes(40) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, 10, 34, 0)
    assert M.find_media(junk) == []
    g = WHOLE["application/gzip"]
    assert M.find_media(g[:-8] + bytes(8)) == []
    assert M.find_media(BMP[:22] + struct.pack("<i", 900) + BMP[26:]) == []


def test_time_is_linear_in_cut_files():
    import time

    for magic in (b"%PDF-1", b"PK\x03\x04", b"%%EOF", b"PK\x05\x06", b"startxref 9 %%EOF %PDF-1 ", b"\x1f\x8b\x08", b"fLaC", b"GIF89a", b"\xff\xd8\xff"):
        at = time.time()
        assert M.find_media(magic * 60_000) == []
        assert time.time() - at < 6, magic


def test_media_within_samples_are_carved(spark, docs):
    text = "before %PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF after"
    got = M.stored_features(M.encode_wav(docs([(1, text), (2, "plain")])).unionByName(spark.createDataFrame([(3, None, None, None)], "doc_id long, n_bytes long, declared_type string, media binary"))).collect()
    assert f"embedded=application/pdf@7+{len(PDF)};" in got[0].feature and "embedded=;" in got[1].feature
    assert tuple(got[2]) == (3, *[None] * 7)
    sniffed = M.sniff(M.encode_wav(docs([(1, text)])), declared="declared_type").first()
    assert sniffed.declared_ok and [(c.type, bytes(c.bytes)) for c in sniffed.carved] == [("application/pdf", PDF)]


def test_sniff_corrects_types_and_carves(spark):
    host = b"text before " + WHOLE["image/png"] + b" and " + GIF
    df = spark.createDataFrame([(1, bytearray(WHOLE["image/png"]), "image/jpeg"), (2, bytearray(host), "text/plain"), (3, None, "x"), (4, bytearray(b""), None)], "id long, media binary, said string")
    r = {x.id: x for x in M.sniff(df, declared="said").collect()}
    assert (r[1].media_type, r[1].declared_ok, r[1].carved) == ("image/png", False, [])
    assert [(c.type, bytes(c.bytes)) for c in r[2].carved] == [("image/png", WHOLE["image/png"]), ("image/gif", GIF)]
    assert r[3].media_type is None and r[4].media_type == "application/octet-stream" and r[4].declared_ok is None


def test_round_trip_features(awkward, empty):
    want = []
    for r in awkward.collect():
        b = (r.text or "").encode()
        p = b + bytes((-len(b)) % 64 if b else 64)
        want.append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    stored = M.encode_wav(awkward)
    got = M.stored_features(stored).collect()
    assert [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got] == want
    assert len({r.feature for r in got if r.doc_id in (5, 7)}) == 1
    assert M.stored_features(M.encode_wav(empty)).count() == 0
    odd = docs_with_odd_names(awkward)
    assert M.sniff(odd).count() == len(want) and "b, c: <>" in M.sniff(odd).columns


def docs_with_odd_names(df):
    return df.selectExpr("doc_id", "encode(text, 'utf-8') as media", "source as `b, c: <>`", "array(named_struct('x y', n_chars)) as `{}`")
