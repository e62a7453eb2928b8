"""Near-duplicate documents by b-bit MinHash.

1. Every text becomes its set of word shingles (64-bit hashes), 128 minima, band keys and a signature that keeps the low
   4 bits of each minimum, packed into eight longs.  Equal sets form one class, which has a number; only classes go on.
2. Classes that share a band key are candidates.  Their similarity is estimated from the signatures by bit counts and
   corrected for chance collisions (C = 1/16); pairs five deviations below the threshold go.
3. What is left is confirmed on the full sets, computed again from the whole texts.
4. Links are joined to connected components.

No bucket is ever expanded into rows of all its pairs.  A bucket first sends one star (its least class with each member), of which the
best edge for each member is confirmed, then those that would still join two components.  Last, buckets that still hold several
components: members outside the bucket's main component meet all members in blocks, by their signatures alone (64 bytes each); members with a plausible partner in
a smaller block of texts are sent there, and plausible pairs are confirmed on the full sets, as many as it takes to join what they join.  No list of pairs is ever
made.  All candidate pairs that could change a component are so confirmed; there is no cap on bucket sizes.

Texts travel little: a bitmap, sized by the number of texts that are needed, filters them where they are read.  A star's members are dealt to cells of
bounded size, and a cell gets the hub's text once; in the last step a text is sent once for each block that it has a plausible partner in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import connected_components

N_HASHES, BITS = 128, 4
LONGS = N_HASHES * BITS // 64
#: A link of exactly the threshold's similarity may be missed by the bands with this probability at most.
MISS = 1e-6
DEVIATIONS = 5
#: Signatures in a block that meets another; texts in a block, and their shingles; members in a cell of a star.
SIG_BLOCK, BLOCK, BLOCK_SHINGLES, STAR_CELL = 512, 128, 1 << 21, 256
#: Bits of the bitmap that filters texts: for each text that is needed, and at most.  Beyond half of that it would let most texts pass and is left out.
BITS_EACH, MAX_BITMAP = 16, 1 << 28
#: Components whose block counts (a long and four ints) are broadcast; beyond, they are joined.
MAX_SIZES = 1_000_000
#: Words (of up to so many bytes) whose hash is kept.
CACHED_WORDS, WORD_BYTES = 300_000, 64
SEED = 20_24


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows in each): the most rows for which bands miss a link at the threshold with probability MISS at most."""
    fit = [(N_HASHES // r, r) for r in range(1, 17) if (1 - (percent / 100) ** r) ** (N_HASHES // r) <= MISS]
    return fit[-1] if fit else (N_HASHES, 1)


class _Words(dict):
    """Word -> 64-bit hash, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = h
        return h


_WORDS = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z, words end at ASCII white space.  Fewer words than ``width`` make one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(_mix(out))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, N_HASHES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, N_HASHES, np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), step):
        np.minimum(out, (a[:, None] * x[None, i : i + step] + b[:, None]).min(axis=1), out=out)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """(n, N_HASHES) minima -> (n, LONGS) longs of their low bits."""
    parts = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), LONGS, 64 // BITS)
    return (parts << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = low[:, : bands * rows].reshape(len(low), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(low), bands)).copy()
    for r in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, r])
    return key


SKETCH = "id long, th long, n_shingles long, digest binary, bands array<long>, sig array<long>"


def _lists(x: np.ndarray) -> pa.Array:
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32) if k else np.zeros(n + 1, np.int32)), pa.array(x.astype(np.uint64).view(np.int64).ravel()))


def sketch(docs: DataFrame, text: str, id_col: str, width: int, percent: int) -> DataFrame:
    """(id, th, n_shingles, digest, bands, sig) of every row, th being a hash of the text; without words no digest and empty lists."""
    bands, rows = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b = _permutations()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sizes, digests, low, seen = [], [], [], {}
                for t in batch.column(1).cast(pa.binary()).to_pylist():
                    t = t or b""
                    if t not in seen:
                        s = shingle_set(t, width)
                        seen[t] = (len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, minima(s, a, b))
                    n, d, m = seen[t]
                    sizes.append(n)
                    digests.append(d)
                    low.append(m)
                m = np.stack(low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(band_keys(m, bands, rows)), _lists(pack(m))],
                    names=["id", "th", "n_shingles", "digest", "bands", "sig"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th")).mapInArrow(run, SKETCH)


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: share of equal groups of BITS bits, corrected for chance collisions."""
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    differ = " + ".join(f"bit_count((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 2) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 3)) & {ones}L)" for i in range(LONGS))
    c = 2.0**-BITS
    return (F.lit(1.0) - F.expr(differ) / float(N_HASHES) - c) / (1 - c)


def least_estimate(percent: int) -> float:
    t, c = percent / 100, 2.0**-BITS
    p = c + (1 - c) * t
    return t - DEVIATIONS * math.sqrt(p * (1 - p) / N_HASHES) / (1 - c)


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm_stars(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (a, b) whose full sets are alike.  ``texts``: node, text.

    The partners of one ``a`` are dealt to cells of about STAR_CELL; a cell is a stretch of sorted rows, the text of ``a`` first, so a task holds one set at a time.
    """
    crowded = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_CELL).cast("int").alias("cells")).where("cells > 1")
    each = pairs.select("a", "b").join(crowded, "a", "left").withColumn("cell", F.coalesce(F.pmod(F.xxhash64("b"), F.col("cells")).cast("int"), F.lit(0)))
    rows = each.select("a", "cell", F.lit(1).alias("place"), F.col("b").alias("node")).unionByName(each.select("a", "cell", F.lit(0).alias("place"), F.col("a").alias("node")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            a, b = [], []
            for h, place, node, text in zip(*(batch.column(k) for k in range(3)), batch.column(3).cast(pa.binary()), strict=True):
                own = shingle_set(text.as_py() or b"", width)
                if place.as_py() == 0:
                    hub, hub_set = h.as_py(), own
                elif hub == h.as_py() and _alike(hub_set, own, percent):
                    a.append(hub)
                    b.append(node.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.join(texts, "node").repartition("a", "cell").sortWithinPartitions("a", "cell", "place")
    return dealt.select("a", "place", "node", "text").mapInArrow(run, "a long, b long")


def plausible(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the packed signatures x[i], y[j] whose estimate reaches ``least_estimate``: the second half of the longs is compared only where the first leaves that open."""
    c, ones = 2.0**-BITS, np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    most = math.floor(N_HASHES * (1 - c - (1 - c) * least_estimate(percent)) + 1e-9)

    def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a ^ b
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        return np.bitwise_count(d & ones)

    out_i, out_j, half = [], [], LONGS // 2
    for at in range(0, len(x), 128):
        own = x[at : at + 128]
        n = sum(differ(own[:, None, k], y[None, :, k]) for k in range(half))
        i, j = np.nonzero(n <= most)
        rest = n[i, j] + sum(differ(own[i, k], y[j, k]) for k in range(half, LONGS))
        out_i.append(i[rest <= most] + at)
        out_j.append(j[rest <= most])
    return np.concatenate(out_i), np.concatenate(out_j)


CELL = ["main", "kind", "i", "j"]


def plausible_cells(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """(main, kind, i, j, side, node): the cells in which a node meets a node of another component of the same ``main`` with a plausible estimate; x and y: main, node, comp, n_shingles, sig.

    Every x meets every x and y.  Rows are cut into blocks of about BLOCK texts and BLOCK_SHINGLES shingles, which are the cells, and these are grouped to blocks of about SIG_BLOCK; a task sees
    two of the latter, and only signatures travel.  A node's row stands for all its partners in a block, so there are fewer rows than pairs.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        fine = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
        return df.groupBy("main").agg(F.ceil(F.count("*") / SIG_BLOCK).cast("int").alias(f"n{name}"), fine.cast("int").alias(f"f{name}"))

    sizes = blocks(x, "x").join(blocks(y, "y"), "main", "left")
    sizes = materialize(sizes.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ny", "fy")}), "nd-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_SIZES else sizes  # else one component's members would be dealt to one task
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    upto = lambda lo, hi, f: F.when(lo <= hi, F.transform(F.sequence(lo, hi), f)).otherwise(F.array().cast("array<struct<kind: string, i: int, j: int, side: int>>"))
    me, last = F.col("own"), F.col("nx") - 1
    cells = F.concat(upto(me, last, lambda j: cell("xx", me, j, 0)), upto(F.lit(0), me, lambda i: cell("xx", i, me, 1)), upto(F.lit(0), F.col("ny") - 1, lambda j: cell("xy", me, j, 0)))

    def placed(df: DataFrame, name: str, to: Column) -> DataFrame:
        rows = df.join(sizes, "main").withColumn("fine", F.pmod(F.xxhash64("node"), F.col(f"f{name}")).cast("int"))
        return rows.withColumn("own", F.floor(F.col("fine") * F.col(f"n{name}") / F.col(f"f{name}")).cast("int")).select("main", "node", "comp", "sig", "fine", F.inline(to))

    rows = placed(x, "x", cells).unionByName(placed(y, "y", upto(F.lit(0), last, lambda i: cell("xy", i, me, 1))))

    def run(t: pa.Table) -> pa.Table:
        sig = _signatures(t["sig"])
        node, comp, side, fine = (t[c].to_numpy() for c in ("node", "comp", "side", "fine"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = plausible(sig[left], sig[right], percent) if len(left) and len(right) else (left[:0], right[:0])
        a, b = left[a], right[b]
        ok = comp[a] != comp[b]
        if t["kind"][0].as_py() == "xx" and t["i"][0].as_py() == t["j"][0].as_py():
            ok &= node[a] < node[b]
        a, b = a[ok], b[ok]
        ends = [np.unique(np.stack([own.astype(np.int64), fine[a].astype(np.int64), fine[b].astype(np.int64)]), axis=1) for own in (a, b)]
        own, i, j = np.concatenate(ends, axis=1)
        n = len(own)
        main, kind = t["main"][0].as_py(), t["kind"][0].as_py()
        sides = np.repeat([0, 1], [e.shape[1] for e in ends])
        return pa.table({"main": pa.array(np.full(n, main), pa.int64()), "kind": pa.array([kind] * n, pa.string()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "side": pa.array(sides, pa.int32()), "node": pa.array(node[own], pa.int64())})

    return rows.groupBy(*CELL).applyInArrow(run, "main long, kind string, i int, j int, side int, node long")


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, LONGS)


def block_links(nodes: np.ndarray, comps: list[int], sets: list[np.ndarray], pairs: list[tuple[int, int]], percent: int) -> list[tuple[int, int]]:
    """Links between components among ``pairs`` (places in the lists), as many as it takes to join what they join."""
    root = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for a, b in pairs:
        if (u := find(comps[a])) != (w := find(comps[b])) and _alike(sets[a], sets[b], percent):
            root[max(u, w)] = min(u, w)
            out.append((int(nodes[a]), int(nodes[b])))
    return out


def confirm_cells(cells: DataFrame, info: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of the plausible pairs in each cell (see ``plausible_cells``); info: node, comp, sig.  A cell holds the texts of two blocks."""
    rows = cells.join(info, "node").join(texts, "node")

    def run(t: pa.Table) -> pa.Table:
        sig, side = _signatures(t["sig"]), t["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = plausible(sig[left], sig[right], percent) if len(left) and len(right) else (left[:0], right[:0])
        sets = [shingle_set(v or b"", width) for v in t["text"].cast(pa.binary()).to_pylist()]
        found = block_links(t["node"].to_numpy(), t["comp"].to_pylist(), sets, list(zip(left[a].tolist(), right[b].tolist(), strict=True)), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy(*CELL).applyInArrow(run, "a long, b long")


def texts_of(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of ``wanted`` (node, id, th), a written table; ``source``: id, th, text.

    The wanted (id, th) become a bitmap of BITS_EACH bits for each, which is broadcast to the scan: other texts are left out before any shuffle.  Its size is checked: MAX_BITMAP bits are
    a table of MAX_BITMAP / 64 rows.  Repeated rows of one id and text count once.
    """
    n = wanted.count()
    bits = 1 << max(16, min((max(1, n) * BITS_EACH - 1).bit_length(), MAX_BITMAP.bit_length() - 1))
    rows = source
    if n <= bits // 2:
        place = F.pmod(F.xxhash64("id", "th"), F.lit(bits))
        words = wanted.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        hit = F.expr("shiftrightunsigned(bits, cast(p % 64 as int)) & 1L") == 1
        rows = rows.withColumn("p", place).withColumn("at", (F.col("p") / 64).cast("int"))
        rows = rows.join(F.broadcast(words), F.col("at") == F.col("word")).where(hit).select("id", "th", "text")
    return materialize(rows.join(wanted, ["id", "th"]).groupBy("node").agg(F.first("text").alias("text")), "nd-texts")


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (id, component) after more links between components."""
    if labels is None:
        return materialize(connected_components(links), "nd-labels")
    more = links
    for side in ("a", "b"):
        more = more.join(labels.withColumnRenamed("id", side), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    top = materialize(connected_components(more), "nd-top").withColumnRenamed("component", "top").withColumnRenamed("id", "own")
    moved = labels.join(top, F.col("component") == F.col("own"), "left").select("id", F.coalesce("top", "component").alias("component"))
    fresh = top.select(F.col("own").alias("id"), F.col("top").alias("component")).join(labels, "id", "left_anti")
    return materialize(moved.unionByName(fresh), "nd-labels")


def _labelled(df: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(labels.select(F.col("id").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80, rows: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id (the least id of the rows that it is linked with, itself included), kept (whether that is its own).

    Rows are linked by their texts: rows of one id with unlike texts belong to different groups, with the same component_id if they are the least of both.
    Texts without words have an empty set and link with nothing.  Rows without id link with nothing, have no component and are kept.  Repeated rows are all returned.
    ``docs`` is read again for candidates and should be a table.

    ``rows`` adds th (the hash of the text) and first: true for the one (id, text) that stands for its group; rows without id or words stand for themselves.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    nodes = materialize(sketch(docs, text, id_col, width, percent), "nd-nodes")
    live = nodes.where("id is not null and digest is not null")
    classes = live.groupBy("digest").agg(F.min(F.struct("id", "th", "n_shingles", "bands", "sig")).alias("r"))
    classes = materialize(classes.select("digest", "r.*", F.monotonically_increasing_id().alias("node")), "nd-classes")
    info, sigs = classes.select("node", "id", "th"), classes.select("node", "sig")
    keys = classes.select("node", F.explode("bands").alias("key"))
    buckets = materialize(keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1"), "nd-buckets")
    inside = materialize(keys.join(buckets.select("key", "leader"), "key"), "nd-inside")
    star = materialize(inside.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "nd-star")
    est = star.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    floor = F.lit(least_estimate(percent))
    near = materialize(est.select("a", "b", estimate("sig_a", "sig_b").alias("est")).where(F.col("est") >= floor), "nd-near")
    both = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = texts_of(source, materialize(both(near).join(info, "node"), "nd-wanted"))

    best = near.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a"))
    labels = _relabel(None, materialize(confirm_stars(best, texts, width, percent), "nd-links"))
    rest = near.join(best, ["a", "b"], "left_anti")
    rest = _labelled(_labelled(rest, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select("a", "b").distinct()
    labels = _relabel(labels, materialize(confirm_stars(materialize(rest, "nd-rest"), texts, width, percent), "nd-links"))

    # buckets that still hold several components: members outside the main one against each other and against those in it
    here = materialize(_labelled(inside, labels, "node", "comp"), "nd-here")
    mixed = here.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.count("*").alias("comps"))
    mixed = materialize(mixed.where("comps > 1").select("key", "main"), "nd-mixed")
    member = materialize(here.join(mixed, "key").select("main", "node", "comp").distinct().join(classes.select("node", "n_shingles", "sig"), "node"), "nd-member")
    cells = materialize(plausible_cells(member.where("comp <> main"), member.where("comp = main"), percent), "nd-cells")
    wanted = materialize(cells.select("node").distinct().join(info, "node"), "nd-wanted")
    comps = materialize(member.select("node", "comp", "sig").dropDuplicates(["node"]).join(wanted.select("node"), "node", "left_semi"), "nd-info")
    links = confirm_cells(cells, comps, texts_of(source, wanted), width, percent)
    labels = _relabel(labels, materialize(links, "nd-links"))

    # a group's least (id, text) stands for it
    grouped = labels.withColumnRenamed("id", "node").join(info, "node")
    least = grouped.groupBy("component").agg(F.min(F.struct("id", "th")).alias("least"))
    grouped = grouped.select("node", "component").join(least, "component").select("node", "least")
    found = classes.select("digest", "node", "id", "th").join(grouped, "node", "left")
    found = materialize(found.select("digest", F.coalesce("least", F.struct("id", "th")).alias("least")), "nd-found")
    out = nodes.select("id", "th", "n_shingles", "digest").join(found, "digest", "left").withColumn("component_id", F.coalesce("least.id", "id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    more = [F.col("th"), F.coalesce((F.col("id") == F.col("least.id")) & (F.col("th") == F.col("least.th")), F.lit(True)).alias("first")] if rows else []
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"), *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
