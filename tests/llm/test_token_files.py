import random
import zlib

import numpy as np
import pytest

from quern.llm import token_files as T
from quern.llm.common import shared_path


def test_planes_and_files_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 70_001):
        ids = rng.integers(0, 1 << 32, n, np.uint32).astype("<u4")
        for bits in (False, True):
            assert (T.ids_of(T.planes_of(ids, bits), n) == ids).all()
            f = T.TokenFile(T.file_of(ids, [None, -5], [n // 3, n - n // 3], bits))
            assert (f.ids() == ids).all() and f.doc_ids == [None, -5]
            if n > 66_000:
                assert (f.ids(65_000, 3000) == ids[65_000:68_000]).all()
    with pytest.raises(ValueError):
        T.TokenFile(T.file_of(ids, [1], [n])[:-1] + b"x")


def test_cut_encoding_equals_the_library():
    e, rnd = T.Encoder(T.default_tokenizer()), random.Random(1)
    parts = ["a", "B", "é", " ", " ", "\n", "'s", "12", "!", ".", "\t", "中", "　", "\xa0", "'ll", "<|endoftext|>", "\0", "word"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)]
    assert got == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_of_documents(spark, awkward, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.default_tokenizer())
    path = shared_path(spark, "test")
    T.write_token_files(awkward, path)
    got = T.read_token_files(spark, path).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in awkward.collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
    at, want = 0, []
    for _, i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    path = shared_path(spark, "test")
    T.write_token_files(empty, path)
    assert T.read_token_files(spark, path).count() == 0


def test_shards_by_size_and_long_chunks(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(T, "SHARD_BYTES", 3000)
    rng, t = random.Random(3), Tokenizer.from_file(T.default_tokenizer())
    rows = [(i, "x" * rng.randrange(200) + " word" * rng.randrange(40)) for i in range(120)]
    path = shared_path(spark, "test")
    T.write_token_files(docs(rows), path)
    assert spark.read.parquet(path).select("shard").distinct().count() > 4
    at, want = 0, []
    for i, text in rows:
        n = len(t.encode(text, add_special_tokens=False).ids) + 1
        want.append((i, at, n))
        at += n
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in T.read_token_files(spark, path).collect()) == want
    e = T.Encoder(T.default_tokenizer())
    e.encode(["y" * 5000 + " z", "short words"])
    assert max(map(len, e.known)) <= T.CHUNK_CHARS
