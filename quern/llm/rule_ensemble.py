"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark columns.

Small trees are boosted on a bounded sample of labelled documents; every path from a root to a node becomes a conjunctive
rule; a lasso-penalised logistic fit keeps few of them.  The surviving rules are plain comparisons of statistics, so a
fitted ensemble is one SQL expression and scoring stays in the JVM.

The driver gathers the statistics (never the texts) of at most ``MAX_ROWS`` labelled documents, drawn by a hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spaced_words, table, text_or_empty

MAX_ROWS = 4000
TREES, DEPTH, LEAF, CUTS, SHRINK = 40, 3, 12, 24, 0.2
LASSO, STEPS, MAX_RULES = 2e-3, 3000, 48
THRESHOLD = 0.3
STATISTICS = ["n_words", "word_length", "distinct_share", "upper_share", "symbol_share", "exclaim_share", "stop_share", "digit_share", "line_words", "dup_line_share", "wide_share"]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of STATISTICS (double, never null; all 0 for null or empty texts); columns of those names are replaced."""
    docs = docs.drop(*STATISTICS)
    own, t = docs.columns, F.col("__t")
    only = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]+", ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("__t", text_or_empty(text))
    df = df.select(
        *own, spaced_words(t).alias("__w"), lines.alias("__l"), F.length(t).alias("__n"), (F.octet_length(t) - F.length(t)).alias("__wide"), only("A-Z").alias("__upper"),
        only("#*$%&|<>").alias("__symbol"), only("!?").alias("__exclaim"), only(".,;:").alias("__stop"), only("0-9").alias("__digit"),
    )
    words, chars, rows = F.greatest(F.size("__w"), F.lit(1)), F.greatest(F.col("__n"), F.lit(1)), F.greatest(F.size("__l"), F.lit(1))
    return df.select(
        *own, F.size("__w").cast("double").alias("n_words"), (F.length(F.array_join("__w", "")) / words).alias("word_length"), (F.size(F.array_distinct("__w")) / words).alias("distinct_share"),
        (F.col("__upper") / chars).alias("upper_share"), (F.col("__symbol") / words).alias("symbol_share"), (F.col("__exclaim") / words).alias("exclaim_share"), (F.col("__stop") / words).alias("stop_share"),
        (F.col("__digit") / chars).alias("digit_share"), (F.size("__w") / rows).alias("line_words"), ((F.size("__l") - F.size(F.array_distinct("__l"))) / rows).alias("dup_line_share"), (F.col("__wide") / chars).alias("wide_share"),
    )


#: A condition is (statistic, +1 for > or -1 for <=, cut); a rule is a conjunction of them.
Condition = tuple[int, int, float]


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            z += weight * satisfied(x, conditions)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as a column over the columns of STATISTICS."""
        terms = [repr(self.bias) + "D"]
        for conditions, weight in self.rules:
            cond = " AND ".join(f"{STATISTICS[k]} {'>' if sign > 0 else '<='} {cut!r}D" for k, sign, cut in conditions)
            terms.append(f"IF({cond}, {weight!r}D, 0D)")
        return F.expr(f"1D / (1D + exp(-({' + '.join(terms)})))")


def satisfied(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, sign, cut in conditions:
        out &= x[:, k] > cut if sign > 0 else x[:, k] <= cut
    return out


def _tree(x: np.ndarray, gradient: np.ndarray, cuts: list[np.ndarray], paths: list, path: tuple, own: np.ndarray, out: np.ndarray) -> None:
    """Least-squares splits of ``gradient``; adds the path of every node and writes node means to ``out``."""
    out[own] = gradient[own].mean()
    if path:
        paths.append(path)
    if len(path) == DEPTH or len(own) < 2 * LEAF:
        return
    g, best = gradient[own], (1e-9, -1, 0.0)
    for k, c in enumerate(cuts):
        above = x[own, k][:, None] > c[None]
        n = above.sum(axis=0)
        s = (above * g[:, None]).sum(axis=0)
        m, r = len(own) - n, g.sum() - s
        fit = np.where((n >= LEAF) & (m >= LEAF), s * s / np.maximum(n, 1) + r * r / np.maximum(m, 1) - g.sum() ** 2 / len(own), 0)
        if len(fit) and fit.max() > best[0]:
            best = (float(fit.max()), k, float(c[fit.argmax()]))
    _, k, cut = best
    if k >= 0:
        above = x[own, k] > cut
        _tree(x, gradient, cuts, paths, (*path, (k, 1, cut)), own[above], out)
        _tree(x, gradient, cuts, paths, (*path, (k, -1, cut)), own[~above], out)


def _tightest(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The path in order, with one condition for each statistic and direction."""
    best: dict[tuple[int, int], float] = {}
    for k, sign, cut in path:
        best[k, sign] = max(best.get((k, sign), cut) * sign, cut * sign) * sign
    return tuple((k, sign, cut) for (k, sign), cut in sorted(best.items()))


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[tuple[Condition, ...]]:
    """Rules from the paths of boosted trees, each tree on half of the rows."""
    rng, z, found = np.random.default_rng(seed), np.full(len(x), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, CUTS))) for k in range(x.shape[1])]
    for _ in range(TREES):
        gradient = y - 1 / (1 + np.exp(-z))
        own = rng.permutation(len(x))[: max(2 * LEAF, len(x) // 2)]
        paths, fitted = [], np.zeros(len(x))
        _tree(x, gradient, cuts, paths, (), np.sort(own), fitted)
        for p in paths:
            found[_tightest(p)] = None
        for p in paths:  # the deepest path that holds decides, for rows outside the sample too
            hit = satisfied(x, p)
            mean = gradient[own][satisfied(x[own], p)].mean() if satisfied(x[own], p).any() else 0
            fitted[hit] = mean
        z += SHRINK * 4 * fitted
    return list(found)


def fit_lasso(r: np.ndarray, y: np.ndarray, lasso: float, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic fit with an L1 penalty on the weights, by accelerated proximal gradient steps."""
    n, k = r.shape
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    rate = 4 / (np.linalg.norm(np.c_[r, np.ones(n)], 2) ** 2 / n)
    for _ in range(steps):
        d = (1 / (1 + np.exp(-(r @ v + c))) - y) / n
        new = v - rate * (r.T @ d)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        new_b, new_t = c - rate * d.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        moved, w, b, t = max(np.abs(new - w).max(initial=0), abs(new_b - b)), new, new_b, new_t
        if moved < 1e-6:
            break
    return float(b), w


def fit_arrays(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Ensemble:
    """An ensemble for statistics ``x`` and labels ``y`` (0/1); of one class only, a constant near its share."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(p / (1 - p))), [])
    rules = tree_rules(x, y, seed)
    r = np.stack([satisfied(x, c) for c in rules], axis=1).astype(float) if rules else np.zeros((len(x), 0))
    lasso = LASSO
    while True:
        bias, w = fit_lasso(r, y, lasso)
        if np.count_nonzero(w) <= MAX_RULES:
            return Ensemble(bias, [(c, float(x)) for c, x in zip(rules, w, strict=True) if x])
        lasso *= 1.5


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels are never learnt: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> Ensemble:
    """An ensemble from at most ``max_rows`` labelled documents outside the held-out part.

    Null ids and labels are left out; of an id with several labels the least counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label).alias("__y"))
    picks = known.orderBy(F.xxhash64(F.lit("rule-ensemble"), F.col(id_col)), id_col).limit(max_rows)
    rows = docs.select(id_col, F.col(text).alias("__text")).join(F.broadcast(picks), id_col)  # max_rows rows at most
    data = statistics(rows, "__text").select(id_col, "__y", *STATISTICS).collect()
    data = sorted(tuple(r) for r in data)
    x = np.array([r[2:] for r in data], float).reshape(-1, len(STATISTICS))
    return fit_arrays(x, np.array([float(r[1]) for r in data]))


def score(docs: DataFrame, ensemble: Ensemble, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 where the score reaches the threshold)."""
    docs = docs.drop("score", "predicted")
    scored = statistics(docs, text).withColumn("score", ensemble.column())
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)).drop(*STATISTICS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ensemble = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), ensemble).select("doc_id", "held_out", "score", "predicted")
