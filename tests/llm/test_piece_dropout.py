import random

import numpy as np
import pytest

from quern.llm import piece_dropout as P


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    parts = [*"abthe THE.,  \n\t!é中😀▂▁'1 9", "the", "ing", " of", "   ", "...", "<s>", "\0", "x" * 60]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(1500)]


def ids(b):
    return np.frombuffer(b, "<i4").tolist()


def test_without_dropout_it_is_the_library(texts):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    own = [t for t in texts if P.BLANK not in t and "\0" not in t]
    assert list(map(ids, P.Coder(P.default_model(), dropout=0).encode(own, [0] * len(own)))) == m.encode(own)


def test_arrays_equal_the_agenda_and_decode_losslessly(texts):
    c = P.Coder(P.default_model(), dropout=0.3)
    variants = [i % 3 for i in range(len(texts))]
    got = list(map(ids, c.encode(texts, variants)))
    for t, v, g in zip(texts, variants, got, strict=True):
        assert g == [x for k in c.chunks(t) for x in P.merge_one(c.v, k, P.chunk_key(k, c.seed, c.epoch, v), c.limit)]
        assert c.decode(g) == t


def test_segmentations_vary_with_variant_and_epoch():
    t = "something interesting happened yesterday in the international community"
    a = P.Coder(P.default_model(), dropout=0.3)
    b = P.Coder(P.default_model(), dropout=0.3, epoch=1)
    got = {tuple(ids(c.encode([t], [v])[0])) for c in (a, b) for v in range(4)}
    assert len(got) > 3 and got == {tuple(ids(c.encode([t], [v])[0])) for c in (a, b) for v in range(4)}


def test_documents(awkward, empty):
    got = P.encode(awkward).collect()
    assert len(got) == 9 and all(r.lossless and r.n_ids == len(r.ids) for r in got) and {r.n_ids for r in got if r.doc_id in (1, 2)} == {0}
    assert sorted(map(str, got)) == sorted(map(str, P.encode(awkward.repartition(5)).collect()))
    back = P.decode(P.encode(awkward)).collect()
    assert [(r.doc_id, r.text) for r in back] == [(r.doc_id, r.text or "") for r in awkward.collect()]
    assert P.encode(empty).count() == 0


def test_each_occurrence_has_its_own_draws(docs):
    text = " ".join(["international"] * 30)
    rows = P.encode(docs([(i, text) for i in range(40)])).collect()
    c = P.Coder(P.default_model())
    cuts = []
    for r in rows:
        key, at, chunks = P.row_key(r.doc_id, 0, text, P.SEED, P.EPOCH), 0, c.chunks(text)
        keys = P.place_key(np.full(len(chunks), key, np.uint64), np.arange(len(chunks)))
        own = [tuple(P.merge_one(c.v, k, int(x), c.limit)) for k, x in zip(chunks, keys, strict=True)]
        assert r.ids == [x for k in own for x in k]
        cuts += own
    assert len(set(cuts)) > 8 and len({tuple(r.ids) for r in rows}) == 40


def test_draws_of_places_are_even_and_apart():
    keys = P.place_key(np.full(20_000, P.row_key(5, 0, "", P.SEED, P.EPOCH), np.uint64), np.arange(20_000))
    drawn = np.array([[P.skipped(int(k), at, 700 + at, int(0.1 * 2**32)) for at in range(4)] for k in keys])
    assert np.abs(drawn.mean(axis=0) - 0.1).max() < 0.01
    assert max(abs((drawn[1:, i] & drawn[:-1, j]).mean() - 0.01) for i in range(4) for j in range(4)) < 0.004


def test_copies_differ(spark, docs):
    import corpus_pipeline

    text = "something interesting happened yesterday in the international community " * 5
    df = docs([(1, text), (1, text), (None, text), (None, text), (2, text)])
    got = corpus_pipeline.encode(spark, df, "").collect()
    assert len({tuple(r.ids) for r in got}) == 5 and all(r.lossless for r in got)
    assert sorted(map(str, got)) == sorted(map(str, corpus_pipeline.encode(spark, df.repartition(3), "").collect()))
