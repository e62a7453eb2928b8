import random
import re

import numpy as np
import pytest

from quern.llm import language_id as L
from quern.llm import rule_ensemble as R

WORDS = {"en": "the and of to with from this that which would", "de": "und der die das nicht mit einer auch über für", "fr": "les des est une dans pour avec être où été", "es": "los las que del una con para por está año"}


def corpus(n, seed=0):
    rng = random.Random(seed)
    langs = list(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 4]].split()) for _ in range(rng.randrange(5, 120))), langs[i % 4]) for i in range(n)]


def test_gradients_match_differences():
    net, rng = L.Network.new(["a", "b", "c"], 3), np.random.default_rng(0)
    for p in net.params():
        p[...] = p * 1.0
    x, y = rng.integers(1, 255, (6, L.WINDOW)).astype(np.uint8), rng.integers(0, 3, 6)
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y].astype(np.float64)).mean()
    for p, g in zip(net.params(), net.gradients(x, y), strict=True):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[k], 1e-2
        p[k] = old + step
        up = loss()
        p[k] = old - step
        down = loss()
        p[k] = old
        assert abs((up - down) / (2 * step) - g[k]) < 0.05 * max(1e-2, abs(g[k])) + 2e-3


def test_windows_cover_the_text():
    t = bytes(range(1, 256)) * 7
    w = L.windows_of(t)
    seen = {i * L.HOP + k for i in range(len(w)) for k in range(L.WINDOW) if w[i][k]}
    assert seen == set(range(len(t))) and len(L.windows_of(b"")) == 1


def naive_forward(net, text):
    """Mean over windows of plain loops over every place, filter and byte."""
    raw, total, weight = text.lower().encode(), np.zeros(len(net.languages)), 0
    for at in range(0, max(1, len(raw) - L.WINDOW + L.HOP), L.HOP):
        w = raw[at : at + L.WINDOW]
        full, feature = w + bytes(L.WINDOW - len(w)), []
        for width, f, b in zip(L.WIDTHS, net.filters, net.biases, strict=True):
            for k in range(L.FILTERS):
                best = max(sum(float(net.embed[full[p + j]] @ f[j * L.EMBED : (j + 1) * L.EMBED, k]) for j in range(width)) for p in range(L.WINDOW - width + 1))
                feature.append(max(best + float(b[k]), 0.0))
        z = np.array(feature) @ net.out + net.out_bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        n = len(w) - w.count(0)
        total, weight = total + n * p, weight + n
    return total / weight


def test_predictions_equal_a_plain_forward_pass(docs):
    net, rng = L.Network.new(["a", "b", "c"], 5), np.random.default_rng(1)
    for b in net.biases:
        b += rng.standard_normal(len(b)).astype(np.float32) * 0.1
    texts = ["Ab", "x", "Straße über alles " * 3, "words and more words, " * 26]
    got = {r.doc_id: r for r in L.predict(docs(list(enumerate(texts))), net).collect()}
    for i, t in enumerate(texts):
        p = naive_forward(net, t)
        assert got[i].lang_pred == net.languages[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-4


def test_every_language_and_the_whole_text_are_learnt(docs):
    rows = [(100 * k + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)}q " * 30, f"l{k:03}") for k in range(90) for i in range(4)]
    assert len(L.fit(docs(rows)).languages) == 90
    # what tells the two languages apart stands only in the middle of long texts
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, noise(9000) + ("xyz " if i % 2 else "zyx ") * 1500 + noise(9000), "ab"[i % 2]) for i in range(240)]
    got = L.predict(docs(rows), L.fit(docs(rows))).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_epochs_go_round_the_windows():
    owner = np.repeat([0, 1, 2], [1, 9, 4])
    seen = [L._epoch(owner, k).tolist() for k in range(3)]
    assert seen[0] == [0, 1, 2, 3, 4, 10, 11, 12, 13] and set(sum(seen, [])) == set(range(14))


def test_fit_takes_only_texts_with_letters(docs):
    good = corpus(240)
    junk = [(10_000 + i, [None, "", " 12, 34!"][i % 3], lang) for i, (_, _, lang) in enumerate(corpus(6000))]
    net, plain = L.fit(docs(good + junk)), L.fit(docs(good))
    assert net.languages == plain.languages and all((a == b).all() for a, b in zip(net.params(), plain.params(), strict=True))
    assert L.fit(docs([(i, None, "en") for i in range(20)])) is None


def test_held_out_accuracy_and_awkward_rows(docs, awkward, empty):
    df = docs(corpus(600))
    net = L.fit(df)
    got = L.predict(df.withColumn("held", L.held_out()), net).where("held").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    rows = L.predict(awkward, net).collect()
    assert len(rows) == 9 and all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3)) and all(0 <= r.score <= 1 for r in rows)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (5, 7)}) == 1
    assert L.predict(empty, net).count() == 0
    assert L.fit(empty) is None and {r.lang_pred for r in L.predict(awkward, None).collect()} == {"und"}


def test_rules_are_learnt_and_compiled(spark, docs, awkward, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 90))]
        rows.append((i, " ".join(words) if good else " ".join(w + "###" for w in words) if i % 2 else " ".join(words[:2] * 20)))
        labels.append((i, int(good)))
    df, lab = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int")
    e = R.fit(df, lab)
    assert 0 < len(e.rules) <= R.MAX_RULES
    got = {r.doc_id: r for r in R.score(df.withColumn("held", R.held_out()), e).collect()}
    held = [i for i, r in got.items() if r.held]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held)
    stats = R.statistics(df).orderBy("doc_id").select(*R.STATISTICS).collect()
    assert np.allclose(e.score(np.array(stats)), [got[i].score for i in range(500)])
    odd = R.score(awkward, e).collect()
    assert len(odd) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= R.THRESHOLD) for r in odd)
    assert R.score(empty, e).count() == 0
    none = R.fit(empty, lab)
    assert none.rules == [] and none.bias == pytest.approx(0)


def plain_statistics(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    n, c, k = max(len(w), 1), max(len(t), 1), max(len(lines), 1)
    many = lambda chars: sum(x in chars for x in t)
    return [
        len(w), sum(map(len, w)) / n, len(set(w)) / n, sum("A" <= x <= "Z" for x in t) / c, many("#*$%&|<>") / n, many("!?") / n, many(".,;:") / n, sum("0" <= x <= "9" for x in t) / c,
        len(w) / k, (len(lines) - len(set(lines))) / k, (len(t.encode()) - len(t)) / c,
    ]


def test_statistics_equal_plain_python(docs, awkward):
    rng = random.Random(9)
    parts = ["Word", "word", "#", "!!", "a.b,c", "12", "\n", "\n", " ", "\t", "ü", "中文", "\x0b", "|", "\u3000", "x" * 30]
    texts = ["".join(rng.choice(parts) + " " * rng.randrange(2) for _ in range(rng.randrange(60))) for _ in range(200)]
    for df in (docs(list(enumerate(texts))), awkward):
        for r in R.statistics(df).collect():
            assert np.allclose([r[c] for c in R.STATISTICS], plain_statistics(r.text)), r.text


def test_lasso_drives_useless_weights_to_zero():
    rng = np.random.default_rng(0)
    r = rng.integers(0, 2, (800, 12)).astype(float)
    y = (r[:, 3] + 0.1 * rng.standard_normal(800) > 0.5).astype(float)
    _, w = R.fit_lasso(r, y, 0.02)
    assert abs(w).argmax() == 3 and np.count_nonzero(w) <= 3
