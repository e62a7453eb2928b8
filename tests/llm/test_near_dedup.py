import random
import time

import numpy as np
import pytest

from quern.llm import near_dedup as N
from quern.llm.components import connected_components


def brute(rows, width, percent):
    """(id, text) -> least id of the rows that it is linked with, None without id; each row is a document."""
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    live = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    for n, k in enumerate(live):
        for j in live[:n]:
            both = len(sets[k] & sets[j])
            if 100 * both >= percent * (len(sets[k]) + len(sets[j]) - both):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k in live:
        least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    return {r: None if r[0] is None else least.get(find(k), r[0]) for k, r in enumerate(rows)}


def chain(rng, n, edits):
    """Texts of which each is the one before with a few words changed: linked in a row, the ends unlike."""
    w = [f"w{rng.randrange(4000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        out.append(" ".join(w))
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"w{rng.randrange(4000)}"
    return out


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_components_match_brute_force(docs, width, percent):
    rng = random.Random(width)
    texts = [*chain(rng, 30, 1), *chain(rng, 25, 3), *[" ".join(f"x{rng.randrange(50)}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]]
    base = chain(rng, 1, 0)[0].split()
    for _ in range(80):  # a large group around one text, many of them just short of a link
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randrange(1, 9)):
            w[k] = f"y{rng.randrange(900)}"
        texts.append(" ".join(w))
    texts += texts[:5] + [None, "", " \n", "Same", "same", "SAME"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    got = {r.doc_id: r for r in N.near_duplicates(docs(rows), width=width, percent=percent).collect()}
    want = {i: c for (i, _), c in brute(rows, width, percent).items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_unlike_texts_of_one_id_are_documents_of_their_own(docs):
    rng = random.Random(11)
    one, two = chain(rng, 3, 1), chain(rng, 3, 1)
    rows = [(5, one[0]), (5, two[0]), (5, two[1]), (9, one[1]), (3, two[2]), (5, one[0]), (8, "a"), (8, "b"), (8, None)]
    got = N.near_duplicates(docs(rows), rows=True).collect()
    want = brute(rows, 5, 80)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, want[i, t]) for i, t in rows)
    first = [(r.doc_id, r.component_id) for r in got if r.first]
    assert sorted(first) == [(3, 3), (5, 5), (5, 5), (8, 8), (8, 8), (8, 8)]  # the repeated row twice, as it is one (id, text)


def test_awkward_rows_and_empty_table(awkward, empty):
    got = N.near_duplicates(awkward).collect()
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = brute(rows, 5, 80)
    assert len(got) == 9 and sorted(map(str, ((r.doc_id, r.component_id) for r in got))) == sorted(map(str, ((i, want[i, t]) for i, t in rows)))
    assert all(r.kept for r in got if r.doc_id is None) and {r.n_shingles for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert N.near_duplicates(empty).count() == 0


def test_small_bitmaps_cells_and_blocks_change_nothing(docs, monkeypatch):
    rng = random.Random(8)
    base, texts = chain(rng, 1, 0)[0].split(), []
    for _ in range(150):  # a star with many rays, of which many are just short of a link
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randrange(1, 12)):
            w[k] = f"y{rng.randrange(9000)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts + chain(rng, 40, 3)))
    for name, v in {"STAR_CELL": 4, "SIG_BLOCK": 8, "BLOCK": 4, "BLOCK_SHINGLES": 500, "MAX_BITMAP": 1 << 16, "BITS_EACH": 1}.items():
        monkeypatch.setattr(N, name, v)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs(rows), width=3, percent=85).collect()}
    assert got == {i: c for (i, _), c in brute(rows, 3, 85).items()}


def test_a_band_with_twenty_thousand_unlike_members(spark):
    """Signatures alone decide on the pairs of such a band; the few true links among them are found."""
    rng, n = np.random.default_rng(2), 20_000
    low = rng.integers(0, 1 << 32, (n, N.N_HASHES), np.uint32)
    twins = rng.permutation(n)[:200].reshape(100, 2)
    low[twins[:, 1]] = low[twins[:, 0]]
    low[twins[:, 1], :6] = 7
    sig = N.pack(low).view(np.int64)
    at = time.time()
    i, j = N.plausible(sig[:10_000].view(np.uint64), sig.view(np.uint64), 80)
    assert time.time() - at < 60
    df = spark.createDataFrame([(1, k, k, 100, sig[k].tolist()) for k in range(n)], "main long, node long, comp long, n_shingles long, sig array<long>")
    cells = N.plausible_cells(df.where("comp <> main"), df.where("comp = main"), 80).collect()
    met = {}
    for r in cells:
        met.setdefault((r.kind, r.i, r.j), ([], []))[r.side].append(r.node)
    assert len(cells) == 200 and {(min(p), max(p)) for p in ((a, b) for left, right in met.values() for a in left for b in right) if {p, p[::-1]} & pairs_of(twins)} == pairs_of(twins)


def pairs_of(twins):
    return {(int(min(t)), int(max(t))) for t in twins}


def test_recall_of_planted_pairs(docs):
    rng = random.Random(21)
    texts, pairs = [], []
    for k in range(400):
        w = [f"w{rng.randrange(50_000)}" for _ in range(rng.randrange(60, 300))]
        v = list(w)
        for _ in range(rng.randrange(0, 3)):
            v[rng.randrange(len(v))] = "changed"
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(w), " ".join(v)]
    want = [p for p in pairs if len(set(brute([(0, texts[p[0]]), (1, texts[p[1]])], 5, 80).values())) == 1]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert len(want) > 300 and sum(got[a] == got[b] for a, b in want) >= 0.99 * len(want)


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(0)
    a, b = N._permutations()
    rows = []
    for j in (0.0, 0.5, 0.9):
        common = rng.integers(0, 1 << 63, int(2000 * j), np.uint64)
        own = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, (2000 - len(common)) // 2, np.uint64)])) for _ in range(2)]
        low = np.stack([N.minima(s, a, b) for s in own])
        rows.append((j, *[[int(x) for x in N.pack(low)[k].view(np.int64)] for k in (0, 1)]))
    df = spark.createDataFrame(rows, "j double, a array<long>, b array<long>").select("j", N.estimate("a", "b").alias("e"))
    assert all(abs(r.j - r.e) < 0.15 for r in df.collect())


def test_bands_lose_next_to_nothing():
    for p in (80, 85):
        bands, rows = N.bands_for(p)
        assert bands * rows <= N.N_HASHES and (1 - (p / 100) ** rows) ** bands <= N.MISS


def test_plausible_signatures_are_those_of_the_estimate(spark):
    rng = np.random.default_rng(3)
    low = np.repeat(rng.integers(0, 1 << 32, (6, N.N_HASHES), np.uint32), 10, axis=0)
    change = rng.random(low.shape) < np.linspace(0, 0.6, 60)[:, None]
    low[change] = rng.integers(0, 1 << 32, int(change.sum()), np.uint32)
    sig = N.pack(low)
    df = spark.createDataFrame([(k, s.view(np.int64).tolist()) for k, s in enumerate(sig)], "k long, sig array<long>")
    pairs = df.selectExpr("k as i", "sig as x").crossJoin(df.selectExpr("k as j", "sig as y"))
    want = {(r.i, r.j) for r in pairs.where(N.estimate("x", "y") >= N.least_estimate(80)).collect()}
    assert set(zip(*(x.tolist() for x in N.plausible(sig, sig, 80)), strict=True)) == want and 60 < len(want) < 3600


def test_blocks_join_what_they_should():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 3, 6, 500)]
    every, nodes = [(a, b) for a in range(4) for b in range(a)], np.array([1, 2, 3, 4])
    assert N.block_links(nodes, [1, 2, 3, 4], sets, every, 85) == [(2, 1), (3, 1)]
    assert N.block_links(nodes, [1, 1, 1, 4], sets, every, 85) == []
    assert N.block_links(nodes, [1, 2, 3, 4], sets, [(0, 3), (1, 2)], 85) == [(2, 3)]


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
