import random

import corpus_pipeline as C
from quern.llm import language_id, mixing, quality_rules
from quern.llm.common import materialize

from .test_classifiers import corpus
from .test_near_dedup import brute


def test_stages_take_effect(spark, docs, monkeypatch):
    rng = random.Random(4)
    rows = [(i, t + " " + " ".join(f"n{rng.randrange(10**6)}" for _ in range(12)), lang, f"s{i % 3}", 1) for i, t, lang in corpus(240)]
    rows += [(1000 + i, rows[i][1], "en", "s1", 1) for i in range(20)] + [(2000, None, None, None, None), (2001, "12 34", "en", "s1", 1), (2002, "few words", "en", "s1", 1), (None, rows[3][1] + " more", "en", "s2", 1)]
    # two unlike texts of one id, one of them as two rows
    rows += [(3000, rows[5][1] + " tail one", "en", "s1", 1), (3000, " ".join(f"own{i} the and" for i in range(30)), "en", "s2", 1), (3000, " ".join(f"own{i} the and" for i in range(30)), "en", "s2", 1)]
    df, at = docs(rows).withColumn("score", C.F.lit("clash")), []
    for name, stage in C.STAGES:
        df = materialize(stage(spark, df, ""), name)
        at.append({(r.doc_id, r.text) if "text" in df.columns else r.doc_id: r for r in df.collect()})
        if name != "sentencepiece":
            assert df.columns == C.COLUMNS
    lang, good, near, mixed, coded = at
    ids = lambda x: {i for i, _ in x}
    assert {2000, 2001} & ids(lang) == set() and 2002 in ids(lang) and 2002 not in ids(good)
    net = language_id.fit(docs(rows))
    assert set(lang) == {(r.doc_id, r.text) for r in language_id.predict(docs(rows), net).collect() if r.lang_pred != "und" and r.score >= language_id.MIN_SCORE}
    assert set(good) == {(r.doc_id, r.text) for r in quality_rules.ledger(docs([tuple(r) for r in lang.values()])).where(~quality_rules.rejected(C.QUALITY_POLICY)).collect()}
    groups = brute(list(good), 5, 80)
    assert set(near) == {r for r, c in groups.items() if c == r[0] or r[0] is None} and not {1000 + i for i in range(20) if i in ids(good)} & ids(near)
    assert sum(i == 3000 for i, _ in near) == sum(i == 3000 for i, _ in good) - 1 or 3000 not in ids(good) or 5 not in ids(good)
    copies = {(r.doc_id, r.text): r.copies for r in mixing.allocate(mixing.sized(docs([tuple(r) for r in near.values()])), draw="draw", keep=("text",)).collect()}
    assert set(mixed) == {i for i, k in copies.items() if k} and df.count() == sum(copies.values())
    assert set(coded) == ids(mixed) and all(r.lossless for r in coded.values())


def test_near_duplicates_keep_one_row_of_each_text(spark, docs):
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "xyz"]
    rows = [(1, text[0], "en", "b", 2), (1, text[0], "en", "a", 1), (1, text[1], "en", "a", 1), (2, text[1] + " end", "en", "a", 1), (None, text[0], None, None, None), (None, text[0], None, None, None), (3, None, None, None, None), (3, None, None, None, None), (4, text[2], None, None, None)]
    got = sorted(map(str, map(tuple, C.near_duplicates(spark, materialize(docs(rows), "t"), "").collect())))
    assert got == sorted(map(str, [rows[1], rows[2], rows[4], rows[5], rows[6], rows[8]]))


def test_empty_table(spark, empty):
    df = empty
    for name, stage in C.STAGES:
        df = materialize(stage(spark, df, ""), name)
    assert df.count() == 0
