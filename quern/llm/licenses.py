"""License scan by diagonal voting, with DataFrame operations only.

Every text becomes its rolling word k-grams (k = 3).  They are joined to the k-grams of
license templates; each match votes for the offset diagonal ``document position - template
position``.  Votes are added up per diagonal, neighbouring diagonals (a few words put in or
left out) are merged into spans, and a span is verified by the share of template words
that its matches cover and by its length in the document.

One pass over the text: each text also sends an end marker that always matches, so that
the one shuffle carries a row for each document and the matches, never text or all grams.
The template table is a constant of this module (its size is checked before the broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, ascii_lower, table, text_or_empty, values

K = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Holds a separator, so no word can be equal to it.
END = "\x00end"

#: Exact phrases of the contract.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Passages of public license texts and notices, 3 to 60 words each.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
]
#: Share of a template's words that a span must cover; shorter templates must match whole.
MIN_COVERAGE, FUZZY_FROM = 0.75, 8
#: A span may be this much longer than its template, and diagonals this far apart merge.
MAX_STRETCH, SLACK_SHARE = 1.3, 0.2
MAX_TEMPLATE_WORDS, MAX_BROADCAST_GRAMS = 60, 100_000


def rows_of(base=None, templates=None) -> list[tuple]:
    """(tpl, kind, label, m, slack, least, words): kind 'end' is the end marker, 'base' an exact phrase."""
    out = [(0, "end", "", 1, 0, 1.0, (END, None, None))]
    for kind, given in (("base", BASE if base is None else base), ("method", TEMPLATES if templates is None else templates)):
        for label, phrase in given:
            w = phrase.split()
            if not K <= len(w) <= MAX_TEMPLATE_WORDS:
                raise ValueError(f"a template needs {K} to {MAX_TEMPLATE_WORDS} words: {phrase!r}")
            fuzzy = kind == "method" and len(w) >= FUZZY_FROM
            out.append((len(out), kind, label, len(w), int(SLACK_SHARE * len(w)) if fuzzy else 0, MIN_COVERAGE if fuzzy else 1.0, tuple(w)))
    return out


def grams_of(rows: list[tuple]) -> list[tuple]:
    """(tpl, tpos, w0, w1, w2) for every k-gram of every template."""
    return [(r[0], p, *r[6][p : p + K]) for r in rows for p in range(len(r[6]) - K + 1)]


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", base=None, templates=None) -> tuple[DataFrame, DataFrame]:
    """Spans of licenses in every text, and one end row for each row of ``docs``.

    Returns one DataFrame of spans: rid (row of the input), id_col, kind, label, start, stop,
    coverage, verified.  Rows of kind 'end' have the number of words as ``start``.
    Null text counts as empty; null or repeated ids are fine, as rows are told apart by rid.
    """
    spark = docs.sparkSession
    rows = rows_of(base, templates)
    grams = grams_of(rows)
    tpl = values(spark, [r[:6] for r in rows], {"tpl": "int", "kind": "string", "label": "string", "m": "int", "slack": "int", "least": "double"})
    g = values(spark, grams, {"tpl": "int", "tpos": "int", "t0": "string", "t1": "string", "t2": "string"}).withColumn("h", F.xxhash64("t0", "t1", "t2"))
    g = g.join(tpl, "tpl")
    if len(grams) <= MAX_BROADCAST_GRAMS:
        g = F.broadcast(g)
    w = F.col("__w")
    n = F.size(w)
    words = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("id"),
        F.concat(F.array_remove(F.split(ascii_lower(text_or_empty(text)), SEPARATORS), ""), F.array(F.lit(END))).alias("__w"),
    )
    each = words.select("rid", "id", F.posexplode(F.arrays_zip(w.alias("w0"), F.slice(w, 2, n).alias("w1"), F.slice(w, 3, n).alias("w2"))).alias("pos", "g"))
    each = each.select("rid", "id", "pos", F.xxhash64("g.w0", "g.w1", "g.w2").alias("h"), "g.w0", "g.w1", "g.w2")
    hits = (
        each.join(g, "h")
        .where("w0 = t0 and w1 <=> t1 and w2 <=> t2")
        .select("rid", "id", "tpl", "kind", "label", "m", "slack", "least", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diag"))
        .repartition("rid")  # once: every step below groups within rid
    )
    votes = hits.groupBy("rid", "id", "tpl", "kind", "label", "m", "slack", "least", "diag").agg(
        F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    by = Window.partitionBy("rid", "tpl").orderBy("diag")
    spans = (
        votes.withColumn("gap", F.col("diag") - F.lag("diag").over(by))
        .withColumn("grp", F.sum(F.when(F.col("gap") <= F.col("slack"), 0).otherwise(1)).over(by))
        .groupBy("rid", "id", "tpl", "kind", "label", "m", "least", "grp")
        .agg(F.bit_or("mask").alias("mask"), F.min("lo").alias("start"), (F.max("hi") + K).alias("stop"))
    )
    covered = F.expr("bit_count(mask | shiftleft(mask, 1) | shiftleft(mask, 2))").cast("double")
    return spans.select(
        "rid", F.col("id").alias(id_col), "kind", "label", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
        F.when(F.col("kind") == "end", 0.0).otherwise(covered / F.col("m")).alias("coverage"),
        ((F.col("kind") != "end") & (covered / F.col("m") >= F.col("least")) & (F.col("stop") - F.col("start") <= F.lit(MAX_STRETCH) * F.col("m"))).alias("verified"),
    )


def license_report(docs: DataFrame, text: str = "text", id_col: str = "doc_id", base=None, templates=None) -> DataFrame:
    """One row for each row of ``docs``: counts and places of the base phrases, labels and a score.

    No text or no words: n_words 0, no labels ('' and ''), null places, score 0.
    The score is the best coverage of a verified span, 1 for a whole template.
    """
    spans = scan(docs, text, id_col, base, templates)
    is_base = F.expr("kind = 'base' and verified")
    names = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return (
        spans.groupBy("rid", id_col)
        .agg(
            F.max(F.when(F.col("kind") == "end", F.col("start"))).alias("n_words"),
            F.count(F.when(is_base, 1)).alias("n_base"),
            F.min(F.when(is_base, F.col("start"))).alias("first_word"),
            F.max(F.when(is_base, F.col("start"))).alias("last_word"),
            names(is_base).alias("base_labels"),
            names(F.col("verified")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("verified"), F.col("coverage"))), F.lit(0.0)).alias("score"),
        )
        .drop("rid")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def oracle() -> str:
    rows = rows_of()
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    tpl = ", ".join("(" + ", ".join(map(lit, r[:6])) + ")" for r in rows[1:])
    grams = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in grams_of(rows)[1:])
    return f"""
WITH tpl(tpl, kind, label, m, slack, least) AS (VALUES {tpl}),
gram(tpl, tpos, w0, w1, w2) AS (VALUES {grams}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
e AS (SELECT rid, w, unnest(range(0, greatest(len(w) - 2, 0))) AS pos FROM d),
hit AS (SELECT e.rid, g.tpl, e.pos, g.tpos, e.pos - g.tpos AS diag FROM e JOIN gram g ON e.w[pos + 1] = g.w0 AND e.w[pos + 2] = g.w1 AND e.w[pos + 3] = g.w2),
vote AS (SELECT rid, tpl, diag, bit_or(1::BIGINT << tpos) AS mask, min(pos) AS lo, max(pos) AS hi FROM hit GROUP BY ALL),
gap AS (SELECT v.*, t.slack, diag - lag(diag) OVER (PARTITION BY rid, tpl ORDER BY diag) AS gap FROM vote v JOIN tpl t USING (tpl)),
grp AS (SELECT *, sum(CASE WHEN gap <= slack THEN 0 ELSE 1 END) OVER (PARTITION BY rid, tpl ORDER BY diag) AS grp FROM gap),
span AS (SELECT rid, tpl, grp, bit_or(mask) AS mask, min(lo) AS start, max(hi) + {K} AS stop FROM grp GROUP BY rid, tpl, grp),
ok AS (SELECT s.rid, t.kind, t.label, s.start, bit_count(mask | (mask << 1) | (mask << 2)) / t.m::DOUBLE AS coverage
       FROM span s JOIN tpl t USING (tpl)
       WHERE bit_count(mask | (mask << 1) | (mask << 2)) / t.m::DOUBLE >= t.least AND stop - start <= {MAX_STRETCH} * t.m),
r AS (SELECT rid, count(*) FILTER (kind = 'base') AS n_base, min(start) FILTER (kind = 'base') AS first_word, max(start) FILTER (kind = 'base') AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base') AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM ok GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (rid)"""
