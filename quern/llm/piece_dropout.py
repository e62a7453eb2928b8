"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text is cut into chunks that no piece of the vocabulary can cross (checked when the model is loaded).  Within a chunk, characters are
merged by the model's merge order: the agenda holds every adjacent pair that makes a piece, the best piece (leftmost among equals)
comes first, and each candidate is skipped for good where a keyed hash falls below the dropout: of seed, epoch, the document's id and copy number,
the chunk's place in the text, and the candidate's place and piece.  So every occurrence of a word is drawn for itself, one key always gives the
same segmentation, and with dropout 0 it is the model's own.  What is kept is no draw, only what a chunk becomes under a set of skips (``Tree``).

New nodes of a batch are merged together as arrays; ``merge_one`` is the same agenda for a single chunk and serves very long ones.
Characters outside the vocabulary, and U+2581 itself, become byte pieces, so that decoding gives back every text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "piece_bpe_32k.model"
DROPOUT, SEED, EPOCH = 0.1, 7, 0
BLANK = "▁"
LONG_CHUNK = 48
#: Nodes and noted chunks of the tree after which it is begun anew, and chunks that are looked up in it at once.
CACHED_NODES, AT_ONCE = 600_000, 1 << 17
#: For the child of a merge: not built, but skipped once.
MET = -2
NONE = np.int32(2**31 - 1)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_M = (1 << 64) - 1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Pieces:
    """The vocabulary of a model: pieces with their merge order, byte pieces, and where texts may be cut."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        if n > 0xFFFF:
            raise ValueError("vocabularies of up to 65,535 pieces are supported")
        plain = {m.id_to_piece(i): i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.ids, self.unknown = plain, m.unk_id()
        scores = np.array([m.get_score(i) for i in range(n)])
        self.rank = np.full(n, NONE, np.int32)
        kept = np.array(sorted(plain.values()))
        self.rank[kept] = np.unique(-scores[kept], return_inverse=True)[1].astype(np.int32)
        self.bytes = [next((i for i in range(n) if m.is_byte(i) and m.id_to_piece(i) == f"<0x{b:02X}>"), None) for b in range(256)]
        if None in self.bytes:
            raise ValueError("lossless coding needs a model with byte pieces")
        self.out = [b""] * n
        for p, i in plain.items():
            self.out[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.out[i] = bytes([b])
        pairs = {(plain[p[:k]] << 16 | plain[p[k:]]): i for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain}
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.uint32)
        self.merged = np.array([pairs[int(k)] for k in self.keys], np.int32)
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.chars[ord(" " if p == BLANK else p)] = i
        self.chars[ord(BLANK)] = -1
        if any(c not in plain for p in plain for c in p):
            raise ValueError("a piece has a character that is no piece")
        after = {(a, b) for p in plain for a, b in zip(p, p[1:], strict=False)}
        #: No piece goes on after a character with a blank, so texts can be cut there.
        self.cut_blank = all(b != BLANK or a == BLANK for a, b in after)
        self.cut_line = not any("\n" in p for p in plain)
        #: Texts can be cut before a full stop or comma, but for those after a character that some piece joins to it.
        joined = "".join(sorted(re.escape(" " if a == BLANK else a) for a, b in after if b in ".,"))
        self.risky = re.compile("  |\0" + (f"|[{joined}][.,]" if joined else ""))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two adjacent symbols make, -1 for none; symbols are ids, or -1 for what is no piece."""
        key = (left.astype(np.uint32) & np.uint32(0xFFFF)) << np.uint32(16) | (right.astype(np.uint32) & np.uint32(0xFFFF))
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], np.int32(-1))


def chunk_key(chunk: str, seed: int, epoch: int, variant: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(chunk.encode("utf-8", "surrogatepass"), seed=(seed * 1_000_003 + epoch * 8191 + variant) & _M)


def row_key(row_id: object, copy: int, text: str, seed: int, epoch: int) -> int:
    """The key of a document's copy; the text stands for an id that is null."""
    import xxhash

    name = f"i{row_id}" if row_id is not None else f"t{text}"
    return xxhash.xxh64_intdigest(f"{copy}:{name}".encode("utf-8", "surrogatepass"), seed=(seed * 1_000_003 + epoch * 8191) & _M)


def place_key(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of the chunks at these places (0, 1, ...) of rows with these keys: the row's key and place, mixed as in splitmix64."""
    h = row + (place.astype(np.uint64) + np.uint64(1)) * _C1
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def skipped(key: int, start: int, piece: int, limit: int) -> bool:
    """Whether the candidate that makes ``piece`` from the character at ``start`` on is skipped: its hash is below ``limit`` (of 2^32)."""
    h = (key + start * int(_C1) + piece * int(_C2)) & _M
    h = ((h ^ h >> 33) * int(_C3)) & _M
    return (h ^ h >> 29) >> 32 < limit


def _skips(h: np.ndarray, limit: int) -> np.ndarray:
    """``skipped`` of arrays: from key + start * _C1 + piece * _C2."""
    h = (h ^ h >> np.uint64(33)) * _C3
    return (h ^ h >> np.uint64(29)) >> np.uint64(32) < np.uint64(limit)


def merge_one(v: Pieces, chunk: str, key: int, limit: int) -> list[int]:
    """The agenda for one chunk, by a heap."""
    sym = [int(v.chars[ord(c)]) for c in chunk]
    n = len(sym)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    agenda: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        j = right[i]
        if i >= 0 and j < n and sym[i] >= 0 and sym[j] >= 0 and (p := v.pairs.get(sym[i] << 16 | sym[j])) is not None:
            heapq.heappush(agenda, (int(v.rank[p]), i, p, sym[i], sym[j]))

    for i in range(n - 1):
        push(i)
    while agenda:
        _, i, p, a, b = heapq.heappop(agenda)
        j = right[i]
        if not alive[i] or j >= n or sym[i] != a or sym[j] != b or skipped(key, i, p, limit):
            continue
        sym[i], alive[j], right[i] = p, False, right[j]
        if right[j] < n:
            left[right[j]] = i
        if left[i] >= 0:
            push(left[i])
        push(i)
    out: list[int] = []
    for i in range(n):
        if alive[i]:
            out += [sym[i]] if sym[i] >= 0 else [v.bytes[b] for b in chunk[i].encode("utf-8", "surrogatepass")]
    return out


def _merge_block(v: Pieces, chunks: list[str], width: int, skips: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The agenda for many chunks of up to ``width`` characters at once; each round makes one merge in each chunk that still has a candidate.

    ``skips``: tells for (chunk numbers, places, pieces) which candidates are skipped.  Gives each chunk's ids, its merges in their order as
    codes (place << 16 | piece), (chunks, width), and their number.
    """
    total, w = len(chunks), width + 1  # +1 column, so that the last symbol has an empty one after it
    points = np.array(chunks, dtype=f"<U{width}").view(np.uint32).reshape(total, width)
    size, cols = np.array([len(c) for c in chunks]), np.arange(w)
    used = cols < size[:, None]
    grid = np.full((total, w), -1, np.int32)
    grid[:, :-1][used[:, :-1]] = v.chars[points[used[:, :-1]]]
    sym, alive, piece = grid.ravel(), used.ravel(), np.full(total * w, -1, np.int32)
    after, before = np.tile(cols + 1, total), np.tile(cols - 1, total)
    made, count = np.zeros((total, width), np.int32), np.zeros(total, np.int64)

    def ranks(row: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Looks up what the symbols make, notes it, and gives its rank, NONE where there is nothing to make."""
        found = v.lookup(left, right)
        ok = (found >= 0) & (left >= 0) & (right >= 0)
        if skips:
            ok[ok] = ~skips(row[ok], at[ok], found[ok])
        piece[row * w + at] = found
        return np.where(ok, v.rank[np.where(ok, found, 0)], NONE)

    order = np.full((total, w), NONE, np.int32)
    row, at = np.nonzero(used[:, 1:])
    order[row, at] = ranks(row, at, sym[row * w + at], sym[row * w + at + 1])
    live, step = np.arange(total), 0
    while True:
        p = order.argmin(axis=1)
        go = np.flatnonzero(order[np.arange(len(live)), p] != NONE)
        if not len(go):
            break
        p = p[go]
        if len(go) < 0.8 * len(live):
            order, live = order[go], live[go]
            go = np.arange(len(live))
        row = live[go]
        base = row * w
        i = base + p
        new, q = piece[i], after[i]
        made[row, step], count[row] = p << 16 | new, step + 1
        step += 1
        j = base + q
        sym[i], alive[j], order[go, q] = new, False, NONE
        far = after[j]
        after[i], before[base + np.minimum(far, width)] = far, p
        near = before[i]
        has = np.flatnonzero(near >= 0)
        rows, places = np.concatenate([row, row[has]]), np.concatenate([p, near[has]])
        order[np.concatenate([go, go[has]]), places] = ranks(rows, places, np.concatenate([new, sym[base[has] + near[has]]]), np.concatenate([sym[base + np.minimum(far, width)], new[has]]))
    left = size - count
    ends, flat = np.cumsum(left), sym[alive].astype("<i4")
    data = flat.tobytes()
    out = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), left.tolist(), strict=True)]
    if (flat < 0).any():
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), side="right")):
            ids: list[int] = []
            for k in np.flatnonzero(alive[i * w : i * w + w]).tolist():
                s = int(sym[i * w + k])
                ids += [s] if s >= 0 else [v.bytes[b] for b in chunks[i][k].encode("utf-8", "surrogatepass")]
            out[i] = np.array(ids, "<i4").tobytes()
    return out, made, count


def _blocks(chunks: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """The numbers of chunks of like width, up to 4,096 at once, with that width."""
    bucket = np.searchsorted([4, 8, 12, 16, 24], np.array([len(c) for c in chunks]))
    for k, width in enumerate((4, 8, 12, 16, 24, LONG_CHUNK)):
        own = np.flatnonzero(bucket == k)
        for at in range(0, len(own), 4096):
            yield own[at : at + 4096], width


class _Table:
    """Arrays of equal length that grow together."""

    def __init__(self, **kinds: type):
        self.n, self.a = 0, {k: np.zeros(1024, t) for k, t in kinds.items()}

    def add(self, n: int, **values: np.ndarray | int) -> None:
        for k, x in self.a.items():
            if self.n + n > len(x):
                self.a[k] = x = np.concatenate([x, np.zeros(max(n, len(x)), x.dtype)])
            x[self.n : self.n + n] = values[k]
        self.n += n


class Tree:
    """What chunks become under each set of skipped candidates that was met.

    A node is a chunk with a set of skips: its ids, and the merges still to be drawn, in their order.  A merge that is drawn as skipped leads to the child
    with one skip more, whose merges are the same up to there.  So an occurrence of a chunk whose nodes are there needs only its draws.
    """

    def __init__(self, v: Pieces):
        self.v, self.root, self.seen, self.ids, self.chunk = v, {}, set(), [], []
        self.nodes = _Table(first=np.int64, draws=np.int32, done=np.int32, parent=np.int32, skip=np.int32)
        self.merges = _Table(code=np.int32, hash=np.uint64, node=np.int32, child=np.int32)

    def build(self, chunks: list[str], skips: np.ndarray, done: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """The new nodes' numbers. skips: (chunks, any) codes; done: merges of each that are drawn already."""
        number = np.zeros(len(chunks), np.int32)
        for part, w in _blocks(chunks):
            texts, own = [chunks[i] for i in part], skips[part]
            ids, made, count = _merge_block(self.v, texts, w, (lambda row, at, piece, own=own: (own[row] == (at << 16 | piece)[:, None]).any(axis=1)) if own.shape[1] else None)
            draws, cols = count - done[part], np.arange(w)
            code = made[(cols >= done[part, None]) & (cols < count[:, None])]
            number[part] = self.nodes.n + np.arange(len(part))
            self.nodes.add(len(part), first=self.merges.n + np.cumsum(draws) - draws, draws=draws, done=done[part], parent=parent[part], skip=own[:, -1] if own.shape[1] else -1)
            h = (code >> 16).astype(np.uint64) * _C1 + (code & 0xFFFF).astype(np.uint64) * _C2
            self.merges.add(len(code), code=code, hash=h, node=np.repeat(number[part], draws), child=-1)
            self.ids += ids
            self.chunk += texts
        return number

    def children(self, at: np.ndarray) -> None:
        """Builds the children at these merges, all of one depth."""
        m, n = self.merges.a, self.nodes.a
        parent = m["node"][at]
        skips, up = [m["code"][at]], parent
        while len(up) and n["parent"][up[0]] >= 0:
            skips.append(n["skip"][up])
            up = n["parent"][up]
        done = n["done"][parent] + (at - n["first"][parent])
        new = self.build([self.chunk[i] for i in parent.tolist()], np.stack(skips[::-1], 1), done, parent)
        self.merges.a["child"][at] = new

    def find(self, chunks: list[str], keys: np.ndarray, limit: int) -> list[bytes]:
        """Ids of each chunk, its draws made by its own key.  A node is built when it is met again; the first time, the agenda runs for that occurrence alone."""
        node = np.fromiter(map(self.root.get, chunks, repeat(-1)), np.int32, len(chunks))
        again, lacking = set(), np.flatnonzero(node < 0)
        for c in map(chunks.__getitem__, lacking.tolist()):
            (again if c in self.seen else self.seen).add(c)
        if fresh := list(again):
            none = np.zeros(len(fresh), np.int32)
            self.root.update(zip(fresh, self.build(fresh, np.zeros((len(fresh), 0), np.int32), none, none - 1).tolist(), strict=True))
        node[lacking] = [self.root.get(chunks[i], -1) for i in lacking.tolist()]
        alone = [np.flatnonzero(node < 0)]
        open_ = np.flatnonzero(node >= 0) if limit else alone[0][:0]
        while len(open_):
            own = node[open_]
            draws = self.nodes.a["draws"][own]
            of = np.repeat(np.arange(len(own)), draws)
            at = np.arange(len(of)) + np.repeat(self.nodes.a["first"][own] - (np.cumsum(draws) - draws), draws)
            hit = np.flatnonzero(_skips(keys[open_][of] + self.merges.a["hash"][at], limit))
            hit = hit[np.diff(of[hit], prepend=-1) != 0]  # the first skipped one of each
            at, open_ = at[hit], open_[of[hit]]
            met, times = np.unique(at[self.merges.a["child"][at] < 0], return_counts=True)
            often = (times > 1) | (self.merges.a["child"][met] == MET)
            self.merges.a["child"][met] = MET
            self.children(met[often])
            child = self.merges.a["child"][at]
            alone.append(open_[child < 0])
            node[open_] = child
            open_ = open_[child >= 0]
        out = [self.ids[i] if i >= 0 else b"" for i in node.tolist()]
        rest = np.concatenate(alone)
        texts, own = [chunks[i] for i in rest.tolist()], keys[rest]
        for part, w in _blocks(texts):
            by_key = lambda row, at, piece, key=own[part]: _skips(key[row] + at.astype(np.uint64) * _C1 + piece.astype(np.uint64) * _C2, limit)
            for i, ids in zip(rest[part].tolist(), _merge_block(self.v, [texts[i] for i in part], w, by_key if limit else None)[0], strict=True):
                out[i] = ids
        return out


_RUNS = re.compile(r" *[^ ]+| +")


class Coder:
    """Encoder and decoder of one model, seed, epoch and dropout, with a tree of the cuts met so far."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED, epoch: int = EPOCH):
        self.v, self.limit, self.seed, self.epoch = Pieces(path), int(dropout * 2**32), seed, epoch
        self.tree = Tree(self.v)

    def chunks(self, text: str) -> list[str]:
        """Pieces never cross the ends of these chunks, which join to a blank and the text; none for an empty text."""
        if not text:
            return []
        v, t = self.v, " " + text
        if not v.cut_blank:
            return [t]
        if v.risky.search(t):
            return _RUNS.findall(t)
        t = t.replace(" ", "\0 ")
        if v.cut_line:
            t = t.replace("\n", "\0\n\0")
        return [c for c in t.replace(".", "\0.").replace(",", "\0,").split("\0") if c]

    def merge(self, chunks: list[str], keys: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk, by its own key."""
        out: list[bytes] = []
        for at in range(0, len(chunks), AT_ONCE):
            part, key = chunks[at : at + AT_ONCE], keys[at : at + AT_ONCE]
            if self.tree.nodes.n + len(self.tree.seen) > CACHED_NODES:
                self.tree = Tree(self.v)
            if max(map(len, part)) <= LONG_CHUNK:
                out += self.tree.find(part, key, self.limit)
                continue
            short = [i for i, c in enumerate(part) if len(c) <= LONG_CHUNK]
            found = dict(zip(short, self.tree.find([part[i] for i in short], key[short], self.limit), strict=True))
            out += [found[i] if i in found else np.array(merge_one(self.v, c, int(key[i]), self.limit), "<i4").tobytes() for i, c in enumerate(part)]
        return out

    def encode(self, texts: list[str], variants: list[int]) -> list[bytes]:
        """Ids of each text, where equal chunks of one variant are cut alike."""
        cut = [self.chunks(t) for t in texts]
        keys = [chunk_key(c, self.seed, self.epoch, x) for own, x in zip(cut, variants, strict=True) for c in own]
        return self._joined(cut, np.array(keys, np.uint64))

    def encode_rows(self, texts: list[str], rows: list[int]) -> list[bytes]:
        """Ids of each text, where each chunk is cut by the key of its row and its place."""
        cut = [self.chunks(t) for t in texts]
        n = np.array([len(c) for c in cut], np.int64)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self._joined(cut, place_key(np.repeat(np.array(rows, np.uint64), n), place))

    def _joined(self, cut: list[list[str]], keys: np.ndarray) -> list[bytes]:
        merged = self.merge([c for own in cut for c in own], keys)
        ends = np.cumsum([0, *map(len, cut)]).tolist()
        return [b"".join(merged[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks for U+2581, bytes for byte pieces, without the blank put before the text."""
        return b"".join(map(self.v.out.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@cache
def _coder(path: str, dropout: float, seed: int, epoch: int) -> Coder:
    return Coder(path, dropout, seed, epoch)


def encode(docs: DataFrame, text: str = "text", id_col: str = "doc_id", model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, epoch: int = EPOCH, copy: str | None = None) -> DataFrame:
    """(id, copy, n_ids, ids, lossless) for each row: ``lossless`` is whether decoding the ids gives back the text.

    ``copy``: a column that numbers the rows of one id, each of which is cut by its own draws; without it all are copy 0.  Null and empty texts
    have no ids.  Equal ids, copy numbers and texts get equal results; the order of rows or their partitions don't matter.
    """
    model, kind = model or default_model(), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model, dropout, seed, epoch)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                rows = [row_key(d, k, t, seed, epoch) for d, t, k in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True)]
                coded = [np.frombuffer(b, "<i4") for b in coder.encode_rows(texts, rows)]
                good = [coder.decode(c.tolist()) == t for c, t in zip(coded, texts, strict=True)]
                ends = np.cumsum([0, *map(len, coded)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(coded)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(ends), pa.int64()), ids, pa.array(good, pa.bool_())], names=[id_col, "copy", "n_ids", "ids", "lossless"])

    number = F.coalesce(F.col(copy).cast("int"), F.lit(0)) if copy else F.lit(0)
    return docs.select(id_col, F.col(text).alias("text"), number.alias("copy")).mapInArrow(run, f"`{id_col}` {kind}, copy int, n_ids long, ids array<int>, lossless boolean")


def decode(coded: DataFrame, id_col: str = "doc_id", model: str | None = None) -> DataFrame:
    """(id, text) of rows with ids; null ids give null."""
    model, kind = model or default_model(), dict(coded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model, 0.0, SEED, EPOCH)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return coded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
