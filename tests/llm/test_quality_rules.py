import collections
import re

from pyspark.sql import functions as F

from quern.llm import quality_rules as Q

WS = re.compile(r"[\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = [x for x in WS.split(text) if x]
    lines = [x for x in text.split("\n") if WS.sub("", x)]
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(g)
    covered = {i + k for i, x in enumerate(g) if n[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = ["a b c d e a b c d e", "a b c d e f a b c d e f g", "x " * 40, "one\ntwo\none\n\n \n\none ", "# * | < > $$ &&", "a a a a a a", "p q r s t u v w x y z p q r s t 1 2 3 u v w x y"]


def test_measures_match_brute_force(docs, awkward):
    for df in (docs([(i, t) for i, t in enumerate(TEXTS)]), awkward):
        got = Q.measure(df).collect()
        assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [brute(r.text) for r in got]


def test_policies_and_ablation(spark, docs):
    good = " ".join(f"word{i}" for i in range(30))
    df = docs([(1, good), (2, "few words"), (3, good.replace(" ", " # ")), (4, "# # #"), (5, None)]).withColumn("n_words", F.lit("clash"))
    led = Q.ledger(df)
    assert {r.doc_id: bool(r.x) for r in led.select("doc_id", Q.rejected("full-1").alias("x")).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}
    assert led.where(~Q.rejected("full-1")).count() == 1
    ab = {r.rule: r for r in Q.ablation(led, "full-1").collect()}
    assert (ab["few_words"].n_fail, ab["few_words"].n_only) == (3, 2) and ab["symbols"].n_fail == 2
    assert ab["symbols"].n_kept == 1 and ab["symbols"].n_kept_without == 1 + ab["symbols"].n_only
    assert all(r.n_fail == 0 for r in Q.ablation(led.limit(0), "full-1").collect())
    assert Q.ledger(docs([])).count() == 0


def test_equal_windows_meet_though_others_stand_between(spark):
    windows = [([4, 5, 4], 7), ([4, 5, 6, 7, 4, 5], 10), ([1, 2, 3], 0), ([9, 9], 6), ([8, 1, 8, 1, 8, 1, 8], 11), ([3] + list(range(10, 500)) + [3], 10)]
    df = spark.createDataFrame([(w, n) for w, n in windows], "w array<long>, n int")
    assert all(r.got == r.n for r in df.select("n", Q._covered(F.col("w")).alias("got")).collect())
