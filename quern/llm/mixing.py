"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Targets: sources share ``budget`` times all words by weight; no target exceeds ``max_copies`` times its source's words, and
what is above is shared again by weight (water filling: full sources are set aside round by round, each round one aggregate).

Selection: a source whose target is c + f times its words (c whole, 0 <= f < 1) takes every document c times for certain;
one more copy goes to a sample.  A document's inclusion odds grow with the root of its size; documents are ranked by
(random odds) / (inclusion odds), the random number being a keyed hash of id and text, and the sample is the head of
that order whose words come nearest to the rest of the target: its size in words is fixed.

The head is found by counting: words per 1/1024 of the rank scale, then per 1/2^20 within the cell where the target falls,
and only the distinct (rank, id, size) of one such cell are sorted.  Rows that tie in all of these are alike; where the target falls among them,
as many as come nearest to it are taken, in the order of their numbers in the written table.  No source is ever sorted as a whole or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, numbered, spaced_words, table, text_or_empty

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT, MAX_COPIES = 150, 2
SEED = "mix-1"
CELLS = 1024
#: The order of documents within a source.
PLACE = ["rank", "id", "size"]


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sources`` (one row for each source: source, source_size) with weight and target (double); other columns stay.

    Sources are weighed in code point order, null last, by ``weights`` in turn.
    """
    w, cap = F.array(*[F.lit(int(x)) for x in weights]), F.col("source_size") * max_copies
    df = numbered(sources, [F.col("source").asc_nulls_last()], "__place")
    df = materialize(df.withColumn("weight", F.get(w, F.pmod("__place", F.lit(len(weights))).cast("int")).cast("long")).drop("__place"), "mix-weights")
    level, ratio = 0.0, cap / F.col("weight") * 100
    while True:  # the level rises with each round, as sources at their cap leave more to the rest
        done, none = ~(F.lit(level) < ratio), F.lit(0)
        sums = [F.coalesce(F.sum(c), none) for c in ("source_size", F.when(done, cap), F.when(~done, F.col("weight")))]
        words, held, left, least = df.agg(*sums, F.min(F.when(~done, ratio))).first()
        if not left:
            break
        level = (words * budget_percent - held * 100) / left
        if level < least:
            break
    target = F.when(F.lit(level) < ratio, F.least(F.lit(level) * F.col("weight") / 100, cap.cast("double"))).otherwise(cap.cast("double"))
    return df.withColumn("target", target)


def uniform(id_col: Column, seed: str, more: Column | None = None) -> Column:
    """A number in (0, 1) from a keyed hash of the id (and of ``more``): 48 bits of SHA-256."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit("null")), *([] if more is None else [F.lit("|"), more]))
    return (F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _head(rows: DataFrame, cell: Column, need: str) -> DataFrame:
    """For each source the first cell in which the running sum of sizes reaches what is needed: source, cell, words before it."""
    sums = rows.groupBy("source", need, cell.alias("cell")).agg(F.sum("size").alias("words"))
    by = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("run", F.sum("words").over(by)).where(F.col("run") >= F.col(need))
    return run.groupBy(F.col("source").alias("h_source")).agg(F.min(F.struct("cell", (F.col("run") - F.col("words")).alias("before"))).alias("h")).select("h_source", "h.cell", "h.before")


def _within_tie(tied: DataFrame) -> DataFrame:
    """``tied`` (source, rid, take): rows that are alike, of which each source takes ``take``; gives each source's greatest taken rid.

    Rows are counted by the part of the table that they stand in (the high bits of rid), and only the rows of one part are sorted.
    """
    part = F.shiftright("rid", 33)
    by = Window.partitionBy("source").orderBy("part")
    sums = tied.groupBy("source", "take", part.alias("part")).agg(F.count("*").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(by) - F.col("n")).where((F.col("before") < F.col("take")) & (F.col("take") <= F.col("before") + F.col("n")))
    sums = sums.select(F.col("source").alias("p_source"), "part", (F.col("take") - F.col("before")).alias("nth"))
    rows = tied.join(sums, F.col("source").eqNullSafe(F.col("p_source")) & (part == F.col("part")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("rid"))).where("k = nth")
    return rows.select(F.col("source").alias("r_source"), F.col("rid").alias("last_rid"))


def allocate(docs: DataFrame, size: str = "size", source: str = "source", id_col: str = "doc_id", weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_copies: int = MAX_COPIES, seed: str = SEED, draw: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs`` (id, source, size): its source_size, target and ``copies``, 0 to ``max_copies``.

    ``draw`` names a string column that joins the id in the key of a row's random number, such as a digest of the text (see ``sized``); without it rows of one id (or without
    id) draw the same number.  Rows alike in id, draw and size are taken up to the target, not all or none.  Columns in ``keep`` are passed on.
    Documents of size 0 get no copy; null sizes count as 0.  An empty table gives no rows.  ``docs`` is read once and written with its numbers.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source).alias("source"), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("size"),
        uniform(F.col(id_col), seed, F.col(draw) if draw else None).alias("u"), F.monotonically_increasing_id().alias("rid"), *[F.col(c).alias(f"k_{c}") for c in keep],
    )
    base = materialize(base, "mix-base")
    d = base.drop(*[f"k_{c}" for c in keep])
    root = F.floor(F.sqrt(F.col("size").cast("double"))).cast("long")
    stats = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(root * F.col("size")).alias("rooted"))
    t = targets(stats, weights, budget_percent, max_copies)
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = materialize(t.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources").withColumnRenamed("source", "t_source")
    pi = F.col("need") * root / F.col("rooted")  # sums to need / mean size over the source, before the cut at 1
    # rank = odds(u) / odds(pi), put on (0, 1) by q / (1 + q)
    q = F.when(pi >= 1, F.lit(0.0)).otherwise((F.col("u") / (1 - F.col("u"))) / (pi / (1 - pi)))

    def ranked(rows: DataFrame) -> DataFrame:
        rows = rows.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
        return rows.withColumn("rank", F.when((F.col("size") > 0) & (F.col("need") > 0), q / (1 + q)))

    open_ = ranked(d).where("rank is not null")
    coarse, fine = F.floor(F.col("rank") * CELLS), F.floor(F.col("rank") * (CELLS * CELLS))
    h1 = materialize(_head(open_, coarse, "need"), "mix-head").withColumnRenamed("cell", "cell1").withColumnRenamed("before", "before1")
    same = F.col("source").eqNullSafe(F.col("h_source"))
    in1 = materialize(open_.join(h1, same & (coarse == F.col("cell1"))).withColumn("need1", F.col("need") - F.col("before1")).select("source", "id", "size", "rank", "rid", "need1"), "mix-cell")
    h2 = materialize(_head(in1, fine, "need1"), "mix-head").withColumnRenamed("cell", "cell2").withColumnRenamed("before", "before2")
    in2 = in1.join(h2, same & (fine == F.col("cell2"))).withColumn("need2", F.col("need1") - F.col("before2")).select("source", "id", "size", "rank", "rid", "need2")
    alike = in2.groupBy("source", "need2", "rank", "id", "size").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(F.col("n") * F.col("size")).over(by) - F.col("n") * F.col("size")
    # a document in which the target falls is in where that comes nearer to the target
    take = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("need2") - before) / F.col("size") + 0.5)))
    place = F.struct(*PLACE)
    cut = alike.withColumn("take", take.cast("long")).where("take > 0").groupBy(F.col("source").alias("c_source")).agg(
        F.max(F.when(F.col("take") == F.col("n"), place)).alias("last"), F.max(F.when(F.col("take") < F.col("n"), F.struct(*PLACE, "take"))).alias("tie"))
    cut = materialize(cut, "mix-cut")
    tie = F.struct(*[F.col(f"tie.{c}").alias(c) for c in PLACE])
    tied = in2.join(cut.where("tie is not null"), F.col("source").eqNullSafe(F.col("c_source")) & place.eqNullSafe(tie)).select("source", "rid", "tie.take")
    cuts = h1.join(h2.withColumnRenamed("h_source", "s2"), F.col("h_source").eqNullSafe(F.col("s2")), "left").drop("s2")
    cuts = cuts.join(cut, F.col("h_source").eqNullSafe(F.col("c_source")), "left").join(_within_tie(tied), F.col("h_source").eqNullSafe(F.col("r_source")), "left")
    cuts = materialize(cuts.select("h_source", "cell1", "cell2", "last", tie.alias("tie"), "last_rid"), "mix-cuts")
    out = ranked(base).join(cuts, same, "left")
    inside = F.coalesce(place <= F.col("last"), F.lit(False)) | F.coalesce(place.eqNullSafe(F.col("tie")) & (F.col("rid") <= F.col("last_rid")), F.lit(False))
    # no cell reached the need (rounding of the last word): the whole source is in
    extra = F.when(F.col("rank").isNull(), False).when(F.col("cell1").isNull(), True).when(coarse != F.col("cell1"), coarse < F.col("cell1")).when(
        fine != F.col("cell2"), fine < F.col("cell2")).otherwise(inside)
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + F.when(extra, 1).otherwise(0), F.lit(max_copies))).otherwise(0).cast("int")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), *[F.col(f"k_{c}").alias(c) for c in keep])


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words of the text (null: 0), and ``draw``, its digest: documents of one id but different texts, or without id, draw numbers of their own."""
    return docs.withColumn("size", F.size(spaced_words(text_or_empty(text))).cast("long")).withColumn("draw", F.md5(text_or_empty(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return allocate(docs, draw="draw").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def oracle() -> str:
    w = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    n = len(WEIGHTS)
    return f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS draw, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * floor(sqrt(size))::BIGINT)::BIGINT AS rooted FROM d GROUP BY source),
a AS (SELECT *, ({w})[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {n}] AS weight, source_size * {MAX_COPIES} AS cap, (sum(source_size) OVER ())::BIGINT * {BUDGET_PERCENT} AS budget FROM s),
b AS (SELECT *, coalesce(sum(cap) OVER p, 0)::BIGINT AS cut, (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::BIGINT AS remain FROM a
      WINDOW p AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CASE WHEN (budget - cut * 100) / remain < cap / weight * 100 THEN (budget - cut * 100) / remain END AS lv FROM b),
t AS (SELECT source, source_size, rooted, coalesce(least(max(lv) OVER () * weight / 100, cap::DOUBLE), cap::DOUBLE) AS target FROM l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT doc_id, d.source, size, source_size, target, whole, target - whole * source_size AS need, (target - whole * source_size) * floor(sqrt(size))::BIGINT / rooted AS pi,
        (('0x' || substr(sha256('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || draw), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r} AS u
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
q AS (SELECT *, CASE WHEN size > 0 AND need > 0 THEN CASE WHEN pi >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (pi / (1 - pi)) END END AS q FROM r),
k AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q / (1 + q), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS run FROM q)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN least(whole + CASE WHEN run - size / 2 <= need THEN 1 ELSE 0 END, {MAX_COPIES}) ELSE 0 END * size)::BIGINT AS taken FROM k"""
