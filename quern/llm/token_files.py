"""Token ids in bit-plane files.

File layout (all integers little-endian): a header, blocks, the chunk index and a footer.  A block holds ``BLOCK_IDS`` ids (the
last one fewer), transposed into planes: plane k has byte k (or bit k) of every id of the block, so that the almost constant
high planes shrink to nothing; each plane is compressed by zstandard by itself.  The chunk index has, for each block, the number of ids and
the place and length of each plane; for each document its first id and its number of ids.

Files are images of bounded size, stored as rows of a Parquet table (shard, seq, content) in the shared folder: Spark's commit protocol then makes
their writing safe when executors are lost, and any store that Spark reads can hold them.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_path, table

MAGIC, VERSION = b"QBPS", 1
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 21
#: zstandard level of a plane.
LEVEL = 3
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Chunks in each of the two halves of an encoder's cache, and characters of the longest that is kept.
CACHED_CHUNKS, CHUNK_CHARS = 500_000, 64
#: Bytes of text in a shard: at most, and at least where there are fewer shards than shuffle partitions.
SHARD_BYTES, LEAST_SHARD_BYTES = 1 << 28, 1 << 21


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# -- planes and files ----------------------------------------------------------------------------


def planes_of(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of unsigned 32-bit ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, k], bitorder="little").tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1).view("<u4").ravel()
    each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(each, axis=1, bitorder="little").view("<u4").ravel()


def file_of(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: bool = False) -> bytes:
    import zstandard

    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    body, index = bytearray(struct.pack("<4sHHI", MAGIC, VERSION, 32 if bits else 4, BLOCK_IDS)), bytearray()
    blocks = 0
    for at in range(0, len(ids), BLOCK_IDS):
        part = ids[at : at + BLOCK_IDS]
        index += struct.pack("<I", len(part))
        for plane in planes_of(part, bits):
            small = pack(plane)
            index += struct.pack("<QI", len(body), len(small))
            body += small
        blocks += 1
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<u8").tobytes())
    at = len(body)
    return bytes(body + index + docs + struct.pack("<QIIQ4s", at, blocks, len(doc_ids), len(docs), MAGIC))


FOOTER = struct.calcsize("<QIIQ4s")


class TokenFile:
    """A file image: any block or document can be read by itself through the chunk index."""

    def __init__(self, content: bytes):
        import zstandard

        self.unpack, self.content = zstandard.ZstdDecompressor().decompress, content
        magic, version, self.n_planes, self.block_ids = struct.unpack_from("<4sHHI", content)
        at, n, n_docs, n_docs_bytes, end = struct.unpack_from("<QIIQ4s", content, len(content) - FOOTER)
        if (magic, version, end) != (MAGIC, VERSION, MAGIC):
            raise ValueError("not a token file, or a truncated one")
        self.blocks = []
        for _ in range(n):
            count = struct.unpack_from("<I", content, at)[0]
            self.blocks.append((count, [struct.unpack_from("<QI", content, at + 4 + 12 * k) for k in range(self.n_planes)]))
            at += 4 + 12 * self.n_planes
        raw = self.unpack(content[at : at + n_docs_bytes])
        known = np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(raw, "<i8", n_docs), known, strict=True)]
        self.lengths = np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def block(self, i: int) -> np.ndarray:
        n, places = self.blocks[i]
        return ids_of([self.unpack(self.content[s : s + k]) for s, k in places], n)

    def ids(self, start: int = 0, count: int | None = None) -> np.ndarray:
        """Ids from ``start`` on, reading only the blocks that hold them."""
        stop = int(self.lengths.sum()) if count is None else start + count
        if stop <= start:
            return np.empty(0, "<u4")
        first = start // self.block_ids
        parts = [self.block(i) for i in range(first, (stop - 1) // self.block_ids + 1)]
        return np.concatenate(parts)[start - first * self.block_ids : stop - first * self.block_ids]


# -- encoding ------------------------------------------------------------------------------------

_RISKY = re.compile(r"\s\s|\x00")
_RISKY_ASCII = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\0")


def risky(text: str) -> bool:
    """Whether a text may not be cut: white space side by side, or a zero character (some more texts count as risky)."""
    return any(x in text for x in _RISKY_ASCII) if text.isascii() else bool(_RISKY.search(text))


class Encoder:
    """Ids of texts by the tokenizers library, each chunk of a text encoded once.

    The byte-level pre-tokenizer never puts what stands before a white-space character and that character into one token.  Where white space
    stands singly, a text can so be cut before each space and line break and its chunks encoded by themselves; other texts, and
    those with the string of a special token, go to the library whole.  ``cuts`` is True only for tokenizers of that kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = str(self.tokenizer.pre_tokenizer)
        self.cuts = pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre and self.tokenizer.normalizer is None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of the text that each token stands for; a byte-level token has one character for each.
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks: those that begin with white space are encoded many at a time, one after another, and told apart by the bytes of their tokens."""
        out: dict[str, bytes] = {}
        run = [c for c in chunks if c[:1] in (" ", "\n") and len(c) > 1]
        alone = [c for c in chunks if not (c[:1] in (" ", "\n") and len(c) > 1)]
        out.update(zip(alone, self._whole(alone), strict=True))
        parts = [run[i : i + 200] for i in range(0, len(run), 200)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(list(map("".join, parts)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in part])
            cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * 4
            flat, at = ids.tobytes(), 0
            for c, end in zip(part, cuts.tolist(), strict=True):
                out[c] = flat[at:end]
                at = end
        return [out[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens."""
        out: list[bytes | None] = [None] * len(texts)
        cut, whole = [], []
        for i, t in enumerate(texts):
            (cut if self.cuts and not risky(t) and not any(s in t for s in self.special) else whole).append(i)
        for i, e in zip(whole, self._whole([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = e
        if cut:
            for i, e in zip(cut, self._cut([texts[i] for i in cut]), strict=True):
                out[i] = e
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Cuts texts into chunks and numbers distinct chunks outside Python; ids of texts are then gathered from those of the distinct chunks."""
        marked = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.large_string()), " ", "\0 "), "\n", "\0\n")
        lists = pc.split_pattern(marked, "\0")
        numbered = lists.flatten().dictionary_encode()
        chunks, code = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        if len(self.known) > CACHED_CHUNKS:  # the older half goes when the younger half is full
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        fresh = [c for c in chunks if c not in known]
        known.update((c, older[c]) for c in fresh if c in older)
        new = [c for c in fresh if c not in older]
        fresh = dict(zip(new, self._chunks(new), strict=True))
        known.update(x for x in fresh.items() if len(x[0]) <= CHUNK_CHARS)
        blobs = [known[c] if c in known else fresh[c] for c in chunks]
        flat = np.frombuffer(b"".join(blobs), "<u4")
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[code] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, bits: bool = False, end_id: int = END_ID) -> None:
    """Tokenize whole texts and write them as files in ascending order of the id (null first; equal ids by text) below ``path``.

    Null text counts as empty.  One shard for each range of ids, as many as the texts' bytes ask for; a shard is cut into files of about FILE_IDS ids, never within a document.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = struct.pack("<I", end_id)
        parts, ids, lengths, total = [], [], [], 0

        def image() -> pa.RecordBatch:
            content = file_of(np.frombuffer(b"".join(parts), "<u4"), ids, lengths, bits)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([total], pa.int64()), pa.array([content], pa.binary())], names=["shard", "seq", "n_ids", "content"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                for doc_id, e in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    parts += (e, end)
                    ids.append(doc_id)
                    lengths.append(len(e) // 4 + 1)
                    total += lengths[-1]
                    if total >= FILE_IDS:
                        yield image()
                        seq += 1
                        parts, ids, lengths, total = [], [], [], 0
        if ids:
            yield image()

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")  # spreads and orders rows of one id
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // SHARD_BYTES), min(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_SHARD_BYTES)))
    ordered = d.repartitionByRange(n, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie, "text")
    ordered.mapInArrow(run, "shard int, seq int, n_ids long, content binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document in the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    # sums of shards run in one task (a row for each shard), those of files within their shard
    each = files.select("shard", "seq", "n_ids")
    shards = each.groupBy(F.col("shard").alias("s")).agg(F.sum("n_ids").alias("n")).select("s", (F.sum("n").over(Window.orderBy("s")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")
    offsets = each.withColumn("within", within).join(shards, F.col("shard") == F.col("s")).select("shard", "seq", (F.col("before") + F.col("within")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seq, content in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                f = TokenFile(content.as_py())
                ids = f.ids()
                sums = [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(f.starts, f.lengths, strict=True)]
                k = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()), pa.array(f.doc_ids, pa.int64()), pa.array(f.starts), pa.array(f.lengths), pa.array(sums, pa.int64())],
                    names=["shard", "seq", "id", "at", "n_tokens", "ids_crc32"],
                )

    rows = files.select("shard", "seq", "content").mapInArrow(run, "shard int, seq int, id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["shard", "seq"]).select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
