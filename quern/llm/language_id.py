"""Language identification by a byte convolutional network, trained here in numpy.

A text becomes fixed-length windows of its lower-cased UTF-8 bytes that overlap by the widest filter; each byte is embedded,
filters of several widths run over every place of the window, each is max-pooled, and a softmax layer gives
the languages.  A text's prediction is the mean over all its windows, weighted by their bytes: whole texts, never prefixes.

Training uses a bounded sample of documents: ``PER_LANGUAGE`` of each language, of however many languages there are (fewer of each where that would be more than
``MAX_DOCUMENTS``), drawn by a hash of id and text.  Each epoch sees ``TRAIN_WINDOWS`` windows of a document, others each time, drawn over its whole text; a document's windows are cut out
where it is read, and only those that some epoch sees reach the driver.  The network's size depends on the number of languages alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, table

WINDOW = 256
#: Ascending; a filter's bytes are looked up two at a time.
WIDTHS, FILTERS, EMBED = (3, 4, 6), 12, 8
#: Bounds of the training sample: documents of a language, of all languages, and windows of a document that an epoch sees.
PER_LANGUAGE, MAX_DOCUMENTS, TRAIN_WINDOWS = 240, 20_000, 4
EPOCHS, BATCH, RATE = 6, 64, 5e-3
HOP = WINDOW - max(WIDTHS) + 1
UNDETERMINED = "und"
#: A document is rejected by the filter below this score.
MIN_SCORE = 0.4


def windows_of(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes: windows every HOP bytes over the whole text, zero-padded at its end."""
    raw = np.frombuffer(text.lower(), np.uint8)
    n = max(1, -(-(len(raw) - (WINDOW - HOP)) // HOP))
    out = np.zeros((n - 1) * HOP + WINDOW, np.uint8)
    out[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(out, (n, WINDOW), (HOP, 1))


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: list[np.ndarray]  # (width * EMBED, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    out_bias: np.ndarray
    looked_up: list[tuple[int, int, np.ndarray]] | None = None

    def ready(self) -> Network:
        """The same, with its look-up tables made once: parameters must not change any more."""
        return replace(self, looked_up=self._pairs())

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.out, self.out_bias]

    @classmethod
    def new(cls, languages: list[str], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
        embed = draw(256, EMBED, by=0.5)
        embed[0] = 0
        return cls(languages, embed, [draw(w * EMBED, FILTERS, by=(w * EMBED) ** -0.5) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   draw(len(WIDTHS) * FILTERS, len(languages), by=0.2), np.zeros(len(languages), np.float32))

    def _fields(self, e: np.ndarray, w: int) -> np.ndarray:
        """(n * positions, w * EMBED): what each filter position sees."""
        n, places, s = len(e), WINDOW - w + 1, e.strides
        view = np.lib.stride_tricks.as_strided(e, (n, places, w * EMBED), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view).reshape(n * places, w * EMBED)

    def _pairs(self) -> list[tuple[int, int, np.ndarray]]:
        """(offset, first column, table): what two bytes at this offset from a filter's place add to the responses of all filters that reach so far.

        A filter is linear in its bytes' embeddings, so its response is the sum of three such look-ups at most.
        """
        out = []
        for at in range(0, max(WIDTHS), 2):
            reach = [i for i, w in enumerate(WIDTHS) if w > at]
            cols = [self._tap(i, at)[:, None, :] + self._tap(i, at + 1)[None, :, :] for i in reach]
            out.append((at, reach[0] * FILTERS, np.concatenate(cols, axis=2).reshape(1 << 16, -1)))
        return out

    def _tap(self, i: int, k: int) -> np.ndarray:
        """(256, FILTERS): what each byte at place k adds to the filters of width i."""
        return self.embed @ self.filters[i][k * EMBED : (k + 1) * EMBED] if k < WIDTHS[i] else np.zeros((256, FILTERS), np.float32)

    def pool(self, x: np.ndarray, step: int = 32) -> np.ndarray:
        """(n, features) of (n, WINDOW) bytes: the greatest response of each filter, cut at 0."""
        pairs, places, out = self._pairs() if self.looked_up is None else self.looked_up, WINDOW - WIDTHS[0] + 1, []
        for k in range(0, len(x), step):
            wide = np.zeros((len(x[k : k + step]), WINDOW + max(WIDTHS)), np.uint16)
            wide[:, :WINDOW] = x[k : k + step]
            two = wide[:, :-1] << 8 | wide[:, 1:]
            r = pairs[0][2][two[:, :places]]
            for at, first, t in pairs[1:]:
                r[:, :, first:] += t[two[:, at : at + places]]
            out.append(np.concatenate([r[:, : WINDOW - w + 1, i * FILTERS : (i + 1) * FILTERS].max(axis=1) for i, w in enumerate(WIDTHS)], axis=1))
        return np.maximum(np.concatenate(out) + np.concatenate(self.biases), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.pool(x) @ self.out + self.out_bias)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, e = len(x), self.embed[x]
        pooled, keep = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            fields = self._fields(e, w)
            r = (fields @ f).reshape(n, -1, FILTERS)
            at = r.argmax(axis=1)
            top = np.take_along_axis(r, at[:, None], 1)[:, 0] + b
            pooled.append(np.maximum(top, 0))
            keep.append((fields.reshape(n, -1, w * EMBED), at, top > 0))
        h = np.concatenate(pooled, axis=1)
        d = _softmax(h @ self.out + self.out_bias)
        d[np.arange(n), y] -= 1
        d /= n
        dh = d @ self.out.T
        de, dfs, dbs = np.zeros_like(self.embed), [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            fields, at, on = keep[i]
            g = dh[:, i * FILTERS : (i + 1) * FILTERS] * on  # (n, FILTERS)
            seen = fields[np.arange(n)[:, None], at]  # (n, FILTERS, w * EMBED)
            dfs.append(np.einsum("nf,nfk->kf", g, seen))
            dbs.append(g.sum(axis=0))
            back = (g[:, :, None] * f.T[None]).reshape(n, FILTERS, w, EMBED)
            places = at[:, :, None] + np.arange(w)
            seen_bytes = x[np.arange(n)[:, None, None], places].ravel()
            for j in range(EMBED):
                de[:, j] += np.bincount(seen_bytes, back[..., j].ravel(), 256)
        de[0] = 0  # padding
        return [de, *dfs, *dbs, h.T @ d, d.sum(axis=0)]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _epoch(owner: np.ndarray, epoch: int) -> np.ndarray:
    """The windows that an epoch sees, of windows of these documents (numbers 0, 1, ..., those of a document side by side): the next TRAIN_WINDOWS of each, round and round."""
    n = np.bincount(owner)
    first = np.cumsum(n) - n
    at = (epoch * TRAIN_WINDOWS + np.arange(TRAIN_WINDOWS)[None, :]) % np.maximum(n, 1)[:, None]
    return (first[:, None] + at)[np.arange(TRAIN_WINDOWS)[None, :] < n[:, None]]


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 0, epochs: int = EPOCHS, owner: np.ndarray | None = None) -> Network:
    """Adam over windows ``x`` with language numbers ``y`` (``owner``: their documents); the same input gives the same network."""
    net, rng = Network.new(languages, seed), np.random.default_rng(seed)
    owner = np.arange(len(x)) if owner is None else owner
    m = [np.zeros_like(p) for p in net.params()]
    v = [np.zeros_like(p) for p in net.params()]
    t = 0
    for k in range(epochs):
        order = rng.permutation(_epoch(owner, k))
        for i in range(0, len(order), BATCH):
            own, t = order[i : i + BATCH], t + 1
            for p, g, a, b in zip(net.params(), net.gradients(x[own], y[own]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> Network | None:
    """A network from a bounded sample of ``docs`` (read twice); None where there is no language to learn.

    The sample: of each language the PER_LANGUAGE documents of least hash outside the held-out part whose text has a letter.  Documents are first thinned by the hash,
    to about four times as many, so that no task ever sees a whole language; repeated rows count once.
    """
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = materialize(rows.where(has_letter).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")), "lang-counts")
    known = counts.count()
    if not known:
        return None
    per = max(1, min(PER_LANGUAGE, MAX_DOCUMENTS // known))
    limit = F.ceil(F.least(F.lit(1.0), 4.0 * per / F.col("n")) * float(1 << 53)).cast("long")
    key = F.pmod(F.xxhash64(F.lit("language-id"), F.col(id_col), F.col(text)), F.lit(1 << 53))
    near = rows.select(F.col(lang).alias("lang"), F.col(id_col).alias("id"), F.col(text).alias("text"), key.alias("key"))
    near = near.join(counts.select("lang", limit.alias("limit")), "lang").where((F.col("key") < F.col("limit")) & F.col("text").rlike(r"\p{L}"))
    near = near.groupBy("lang", "key", "id").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "id"))
    picks = near.withColumn("place", place).where(F.col("place") <= per).select("lang", "key", "text")
    languages, x, y, owner = [], [], [], []
    for name, _, w in sorted(map(tuple, picks.mapInArrow(_cut_windows, "lang string, key long, windows binary").collect())):
        languages += [] if languages[-1:] == [name] else [name]
        own = np.frombuffer(w, np.uint8).reshape(-1, WINDOW)
        owner += [owner[-1] + 1 if owner else 0] * len(own)
        x.append(own)
        y += [len(languages) - 1] * len(own)
    return train(np.concatenate(x), np.array(y), languages, owner=np.array(owner)) if x else None


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, text) with the windows that training sees instead of the text: all of them, or as many as all epochs see, drawn by the key."""
    for batch in batches:
        out = []
        for key, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            w = windows_of(t.encode("utf-8", "surrogatepass"))
            picks = np.random.default_rng(key).permutation(len(w))[: EPOCHS * TRAIN_WINDOWS]
            out.append(w[picks].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["lang", "key", "windows"])


def predict(docs: DataFrame, net: Network | None, text: str = "text", chunk: int = 192) -> DataFrame:
    """``docs`` with lang_pred and score (columns of those names are replaced).

    Null and empty texts, texts without any letter, and everything where there is no network: ``und`` with score 0.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names, k = docs.columns, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value and shared.value.ready()

        def scores(texts: list[bytes]) -> list[np.ndarray]:
            """Mean probabilities of each text, its windows weighed by their bytes, ``chunk`` windows at a time across texts."""
            sums = [np.zeros(len(net.languages)) for _ in texts]
            pend: list[tuple[int, np.ndarray]] = []
            waiting = 0

            def flush():
                p = net.probabilities(np.concatenate([w for _, w in pend]))
                at = 0
                for i, w in pend:
                    weight = np.count_nonzero(w, axis=1)
                    sums[i] += weight @ p[at : at + len(w)]
                    at += len(w)
                pend.clear()

            for i, t in enumerate(texts):
                w = windows_of(t)
                for s in range(0, len(w), chunk):
                    pend.append((i, w[s : s + chunk]))
                    waiting += len(pend[-1][1])
                    if waiting >= chunk:
                        flush()
                        waiting = 0
            if pend:
                flush()
            return [s / max(s.sum(), 1e-9) for s in sums]

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(k).to_pylist()
                own = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
                lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if own:
                    for i, p in zip(own, scores([texts[i].encode("utf-8", "surrogatepass") for i in own]), strict=True):
                        lang[i], score[i] = net.languages[int(p.argmax())], float(min(p.max(), 1.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")
