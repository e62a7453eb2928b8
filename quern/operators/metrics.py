"""Robustness metrics: outcomes of samples, paired with the clean ones, and their aggregates.

Samples: dataset_name, sample_id, corruption_name, corruption_level (both null when clean), task, gold_label, n_options,
corruption_applied.  Records: the same key, raw_response and ``seq`` (the order of loading).  Samples and records are read once: outcomes carry whether their
sample's clean form was right, ``facts`` counts everything by bucket in one aggregate, and all reports re-aggregate these few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import allowed_letters, gold_label, parse_label, response_text

KEY = ["dataset_name", "sample_id", "corruption_name", "corruption_level"]


def first_records(records: DataFrame) -> DataFrame:
    """The first record of each key in the order of loading; an aggregate, so combined before the shuffle."""
    return records.groupBy(*KEY).agg(F.min(F.struct("seq", "raw_response")).alias("r")).select(*KEY, F.col("r.raw_response").alias("raw_response"))


def outcomes(samples: DataFrame, records: DataFrame) -> DataFrame:
    """Samples with has_response, correct and parse_failed; a clean sample without a response counts as a failed parse."""
    r = first_records(records).select(*[F.col(c).alias(f"r_{c}") for c in KEY], "raw_response", F.lit(True).alias("found"))
    on = F.lit(True)
    for c in KEY:
        on = on & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    df = samples.join(r, on, "left").drop(*[f"r_{c}" for c in KEY])
    parsed = parse_label(response_text(F.col("raw_response")), F.col("task"), allowed_letters(F.col("n_options")))
    df = df.withColumn("has_response", F.coalesce("found", F.lit(False))).withColumn("parsed", F.when(F.col("has_response"), parsed))
    is_clean = F.col("corruption_name").isNull()
    out = df.select(
        *KEY, is_clean.alias("is_clean"), F.coalesce("corruption_applied", F.lit(True)).alias("applied"), "has_response",
        F.coalesce(F.col("parsed.label") == gold_label(F.col("task"), F.col("gold_label")), F.lit(False)).alias("correct"),
        F.when(F.col("has_response"), F.col("parsed.label").isNull()).otherwise(is_clean).alias("parse_failed"), F.col("parsed.status").alias("parse_status"),
    )
    clean_correct = F.max(F.col("is_clean") & F.col("correct")).over(Window.partitionBy("dataset_name", "sample_id"))  # the levels of one sample
    return out.withColumn("clean_correct", clean_correct)


def paired(out: DataFrame) -> DataFrame:
    """Perturbed outcomes with clean_correct of their sample."""
    return out.where("not is_clean")


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def share(num: Column, den: Column, percent: bool = True) -> Column:
    """num / den, in percent by default; null where den is 0."""
    return F.when(den != 0, num.cast("double") / den * (100.0 if percent else 1.0))


MEASURES = ["eligible", "applied", "not_applied", "responses", "api_errors", "parse_failures", "correct", "crr_den", "crr_num", "all_correct", "all_failed", "missing"]


def facts(out: DataFrame) -> DataFrame:
    """Counts by dataset, strategy and level (both null for clean samples): a few rows that every report starts from."""
    c, answered = F.col, F.col("applied") & F.col("has_response")
    conds = [F.lit(True), c("applied"), ~c("applied"), answered, c("applied") & ~c("has_response"), answered & c("parse_failed"), answered & c("correct"), answered & c("clean_correct"), answered & c("clean_correct") & c("correct"),
             c("correct"), c("parse_failed"), ~c("has_response")]
    return out.groupBy("dataset_name", "corruption_name", "corruption_level").agg(*[_n(x).alias(n) for n, x in zip(MEASURES, conds, strict=True)])


def clean_metrics(facts: DataFrame) -> DataFrame:
    """Per dataset: total, correct, parse failures, accuracy and failure rate in percent."""
    g = facts.where("corruption_name is null").select("dataset_name", F.col("eligible").alias("total"), F.col("all_correct").alias("correct"), F.col("all_failed").alias("parse_fail"))
    return g.withColumn("accuracy_pct", share(F.col("correct"), F.col("total"))).withColumn("parse_fail_pct", share(F.col("parse_fail"), F.col("total")))


def bucket_metrics(facts: DataFrame) -> DataFrame:
    """Per dataset, strategy and level; CRR is null where no clean sample was correct."""
    c, g = F.col, facts.where("corruption_name is not null").drop("all_correct", "all_failed", "missing")
    return (
        g.withColumn("crr", share(c("crr_num"), c("crr_den"), False))
        .withColumn("success_rate", F.coalesce(share(c("applied"), c("eligible"), False), F.lit(0.0)))
        .withColumn("parse_failure_rate", F.coalesce(share(c("parse_failures"), c("responses"), False), F.lit(0.0)))
    )


def strategy_metrics(facts: DataFrame) -> DataFrame:
    """Per strategy: macro CRR (mean over buckets where it is defined), success rate and accuracy drop, in percent."""
    c, every = F.col, Window.partitionBy()  # over the few rows of facts
    clean = lambda n: F.sum(F.when(c("corruption_name").isNull(), c(n))).over(every)
    rows = facts.withColumn("clean_pct", share(clean("all_correct"), clean("eligible"))).where("corruption_name is not null").withColumn("crr", share(c("crr_num"), c("crr_den"), False))
    g = rows.groupBy("corruption_name").agg(
        (F.sum("crr") / F.count("crr") * 100.0).alias("macro_crr_pct"), share(F.sum("applied"), F.sum("eligible")).alias("success_pct"), share(F.sum("correct"), F.sum("responses")).alias("accuracy_pct"), F.max("clean_pct").alias("clean_pct")
    )
    return g.withColumn("drop_pct", c("clean_pct") - c("accuracy_pct")).drop("clean_pct")


def record_counts(records: DataFrame) -> DataFrame:
    """Clean and perturbed records."""
    clean = F.col("corruption_name").isNull()
    return records.agg(F.count_if(clean).alias("clean"), F.count_if(~clean).alias("corrupted"))


def overall_failures(facts: DataFrame, records: DataFrame) -> DataFrame:
    """Failed parses over received records: overall, clean, perturbed; and the overall rate with missing clean rows in the denominator too."""
    c, clean = F.col, F.col("corruption_name").isNull()
    f = facts.agg(F.sum(F.when(clean, c("all_failed"))).alias("cf"), F.sum(F.when(clean, c("missing"))).alias("missing"), F.sum(F.when(~clean, c("parse_failures"))).alias("pf"))
    one = f.crossJoin(F.broadcast(record_counts(records).select((c("clean") + c("corrupted")).alias("n"), c("clean").alias("nc"))))  # one row each
    return one.select(
        share(c("cf") + c("pf"), c("n")).alias("overall_pct"), share(c("cf"), c("nc")).alias("clean_pct"), share(c("pf"), c("n") - c("nc")).alias("corrupted_pct"), share(c("cf") + c("pf"), c("n") + c("missing")).alias("bounded_pct")
    )


def rollup(facts: DataFrame) -> DataFrame:
    """Micro measures at four grains in one pass over the counts."""
    by = ["dataset_name", "corruption_name", "corruption_level"]
    sums = [F.sum(n).alias(n) for n in ("eligible", "applied", "responses", "correct")]
    return facts.where("corruption_name is not null").groupingSets([by, by[:2], by[1:2], []], *by).agg(*sums)


def markdown(clean: DataFrame, strategies: DataFrame) -> str:
    """A small report; both tables are a row for each dataset or strategy, in their order."""
    show = lambda x: "nan" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x)
    lines = []
    for title, df, by in (("Clean", clean, "dataset_name"), ("Strategies", strategies, "corruption_name")):
        lines += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join(map(show, r)) + " |" for r in df.orderBy(by).collect()] + [""]
    return "\n".join(lines)
