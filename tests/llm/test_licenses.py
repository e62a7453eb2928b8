import re

import pytest

from quern.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    hits = [(i, label) for label, p in L.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    "Released under the MIT License. And again: under the MIT license",
    "under-the-mit-license cc by nc cc by nc by nc",
    "apache license version 20 apache license, version 2",
    "under the MIT lİcense",
]


def test_base_matches_brute_force(docs, awkward):
    for df in (docs([(i, t) for i, t in enumerate(TEXTS)]), awkward):
        got = sorted((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.license_report(df).collect())
        want = [brute(r.text) for r in df.collect()]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_fuzzy_span_keeps_label_and_score(docs):
    words = L.TEMPLATES[1][1].split()
    changed = words[:10] + ["extra"] + words[10:20] + words[21:]
    r = L.license_report(docs([(1, "intro " + " ".join(changed) + " end"), (2, " ".join(words[:8]))])).collect()
    by = {x.doc_id: x for x in r}
    assert by[1].labels == "mit" and L.MIN_COVERAGE <= by[1].score < 1 and by[1].n_base == 0
    assert by[2].labels == "" and by[2].score == 0


def test_empty_table_and_template_bounds(empty):
    assert L.license_report(empty).count() == 0
    with pytest.raises(ValueError):
        L.rows_of(templates=[("x", "two words")])
