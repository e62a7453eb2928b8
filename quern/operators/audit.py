"""Audits and gates: violations as rows, expectations as rows, and one assertion that raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import GateFailed
from ..functions.text import has_line_separator
from ..schema import LEVELS, STRATEGIES


def change_stats(df: DataFrame, by: list[str], count: str = "change_count") -> DataFrame:
    """n, mean (4 places), median, least and greatest number of operations."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(count), 4).alias("mean"), F.percentile(count, 0.5).alias("median"), F.min(count).alias("least"), F.max(count).alias("most"))


def monotone(stats: DataFrame, by: list[str]) -> DataFrame:
    """Whether means don't fall from level to level."""
    at = lambda level: F.max(F.when(F.col("level") == level, F.col("mean")))
    g = stats.groupBy(*by).agg(*[at(x).alias(x) for x in LEVELS])
    return g.withColumn("monotone", (F.col("low") <= F.col("medium")) & (F.col("medium") <= F.col("high")))


def level_steps(stats: DataFrame, by: list[str]) -> DataFrame:
    """Each level's mean less the mean of the level before."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return stats.withColumn("step", F.col("mean") - F.lag("mean").over(Window.partitionBy(*by).orderBy(rank))).select(*by, "level", "mean", "step")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than one row, and rows beyond the first."""
    g = df.groupBy(*keys).count()
    return g.agg(F.count_if(F.col("count") > 1).alias("groups"), F.coalesce(F.sum(F.greatest(F.col("count") - 1, F.lit(0))), F.lit(0)).alias("extra"))


def label_histogram(df: DataFrame, dataset: str, label: str) -> DataFrame:
    """Rows by dataset and label, by dataset, and in all."""
    return df.rollup(dataset, label).agg(F.count("*").alias("n"))


def strategy_sets(perturbed: DataFrame) -> DataFrame:
    """How many levels and strategies each sample has."""
    return perturbed.groupBy("dataset_name", "sample_id").agg(F.countDistinct("corruption_level").alias("levels"), F.countDistinct("corruption_name").alias("strategies"))


def audit_dataset(clean: DataFrame, perturbed: DataFrame, expected: DataFrame, strategies: list[str] = STRATEGIES, unchanged: tuple[str, ...] = ("gold_label", "clean_payload"), split: str = "test", language: str = "zh") -> DataFrame:
    """(dataset_name, sample_id, rule) for each rule that a dataset (sample_id null), a sample or a row breaks.

    clean: dataset_name, sample_id, split, language, ``unchanged``, clean_payload.  perturbed: the same with corruption_name, corruption_level, path_name, path_level (from the file's
    path), corrupted_payload, corruption_applied, change_count.  expected: dataset_name, n.
    """
    none, c = F.lit(None).cast("string"), F.col
    per = clean.groupBy("dataset_name").agg(
        F.count("*").alias("rows"), F.countDistinct("sample_id").alias("ids"), F.count_if(~c("split").eqNullSafe(split) | ~c("language").eqNullSafe(language)).alias("foreign"))
    per = expected.join(per, "dataset_name", "left")
    rules = [F.when(~c("rows").eqNullSafe(c("n")), "clean_count"), F.when(c("ids") < c("rows"), "repeated_clean_id"), F.when(c("foreign") > 0, "split_or_language")]
    found = [per.select("dataset_name", none.alias("sample_id"), F.explode(F.array_compact(F.array(*rules))).alias("rule"))]

    there = perturbed.groupBy("dataset_name", c("path_name").alias("name"), c("path_level").alias("level")).agg(F.count("sample_id").alias("k"))
    want = expected.select("dataset_name", F.explode(F.array(*map(F.lit, strategies))).alias("name")).withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))
    files = want.join(there, ["dataset_name", "name", "level"], "left")
    rule = F.when(c("k").isNull(), F.concat_ws("/", F.lit("missing_file"), "name", "level")).when(c("k") == 0, F.concat_ws("/", F.lit("empty_file"), "name", "level"))
    found.append(files.select("dataset_name", none.alias("sample_id"), rule.alias("rule")).where("rule is not null"))

    names = [*dict.fromkeys([*unchanged, "clean_payload"])]
    own = clean.groupBy(c("dataset_name").alias("c_dataset"), c("sample_id").alias("c_id")).agg(F.min(F.struct(*names)).alias("c"))  # a repeated clean id is reported above
    rows = perturbed.where("sample_id is not null").join(own, (c("dataset_name") == c("c_dataset")) & (c("sample_id") == c("c_id")), "left")
    known, changed = c("c_id").isNotNull(), F.lit(False)
    for n in unchanged:
        changed = changed | ~c(n).eqNullSafe(c(f"c.{n}"))
    row_rules = F.array_compact(F.array(
        F.when(~known, "unknown_sample"),
        F.when(known & ~(c("corruption_name").eqNullSafe(c("path_name")) & c("corruption_level").eqNullSafe(c("path_level"))), "path_mismatch"),
        F.when(known & changed, "clean_field_changed"),
        F.when(known & c("corrupted_payload").eqNullSafe(c("c.clean_payload")), "nothing_changed"),
        F.when(known & ~(c("corruption_applied").eqNullSafe(True) & (F.coalesce("change_count", F.lit(0)) > 0)), "invalid_flags"),
        F.when(known & has_line_separator(F.struct("corrupted_payload", *unchanged)), "line_separator"),
    ))
    found.append(rows.select("dataset_name", "sample_id", F.explode(row_rules).alias("rule")))

    g = rows.where(known).groupBy("dataset_name", "sample_id").agg(
        F.count("*").alias("k"), F.countDistinct("path_level").alias("levels"), F.countDistinct("corruption_name").alias("strategies"), F.min("corruption_name").alias("strategy"))
    sets = F.array_compact(F.array(F.when(c("levels") != len(LEVELS), "levels_missing"), F.when(c("k") > c("levels"), "repeated_level"), F.when(c("strategies") != 1, "several_strategies")))
    found.append(g.select("dataset_name", "sample_id", F.explode(sets).alias("rule")))
    totals = g.groupBy("dataset_name").agg(F.count("*").alias("ids"), F.count_if(c("strategies") == 1).alias("assigned"), F.countDistinct(F.when(c("strategies") == 1, c("strategy"))).alias("names"))
    totals = expected.join(totals, "dataset_name", "left")
    whole = [F.when(~c("ids").eqNullSafe(c("n")), "perturbed_count"), F.when(~c("assigned").eqNullSafe(c("n")), "assignment_count"), F.when(~c("names").eqNullSafe(F.lit(len(strategies))), "strategies_missing")]
    found.append(totals.select("dataset_name", none.alias("sample_id"), F.explode(F.array_compact(F.array(*whole))).alias("rule")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def reconcile(loaded: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Loaded against expected counts (column n): OK, MISMATCH, MISSING or UNEXPECTED for each key."""
    a, b = loaded.groupBy(*keys).agg(F.count("*").alias("loaded")), expected.groupBy(*keys).agg(F.sum("n").alias("expected"))
    df = a.join(b, keys, "full")
    status = F.when(F.col("expected").isNull(), "UNEXPECTED").when(F.col("loaded").isNull(), "MISSING").when(F.col("loaded") == F.col("expected"), "OK").otherwise("MISMATCH")
    return df.withColumn("status", status)


def gate(df: DataFrame, checks: dict[str, tuple]) -> DataFrame:
    """(name, expected, actual, ok) for checks name -> (aggregate column, expected)."""
    row = df.agg(*[c.cast("long").alias(n) for n, (c, _) in checks.items()])
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).cast("long").alias("expected"), F.col(n).alias("actual"), F.col(n).eqNullSafe(F.lit(e)).alias("ok")) for n, (_, e) in checks.items()])
    return row.select(F.inline(parts))


def assert_empty(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raises with a few rows where there is any violation."""
    rows = violations.limit(show).collect()
    if rows:
        raise GateFailed(f"{what}: {[r.asDict() for r in rows]}")


def sum_success(stats: DataFrame, by: list[str]) -> DataFrame:
    """Expected records: the ``success`` of file statistics (by..., file_stats: a JSON list of objects or an object of objects), and how many files there are."""
    one = "struct<file_key: string, success: bigint>"
    entries = F.when(F.col("file_stats").rlike(r"^\s*\["), F.from_json("file_stats", f"array<{one}>")).otherwise(
        F.transform(F.map_entries(F.from_json("file_stats", "map<string, struct<success: bigint>>")), lambda e: F.struct(e["key"].alias("file_key"), e["value"]["success"].alias("success"))))
    rows = stats.select(*by, F.explode_outer(entries).alias("e"))
    return rows.groupBy(*by).agg(F.coalesce(F.sum("e.success"), F.lit(0)).alias("expected"), F.count_distinct("e.file_key").alias("files"))


def within(keys: DataFrame, known: DataFrame, on: str, what: str | None = None) -> DataFrame:
    """Keys that are not among the known ones; raises if ``what`` names them and there are any."""
    lost = keys.select(on).join(known.select(on), on, "left_anti").distinct()
    if what:
        assert_empty(lost, what)
    return lost


def overlap(a: DataFrame, b: DataFrame, keys: list[str], what: str | None = None) -> DataFrame:
    """Keys that are in both; raises if ``what`` names them and there are any."""
    both = a.select(*keys).intersect(b.select(*keys))
    if what:
        assert_empty(both, what)
    return both


def recovery_gate(outcomes: DataFrame, candidates: DataFrame, expected: dict[str, int], expected_by_bucket: DataFrame) -> DataFrame:
    """(name, expected, actual, ok) of a recovery.  outcomes: request_key, status.  candidates: is_clean, dataset_name, bucket, selected_key.  ``expected``: observed_records, candidate_clean,
    candidate_corrupted; ``expected_by_bucket``: bucket, n, for clean datasets and for strategies with levels.  Every record must be recovered, by a key of its own.
    """
    c = F.col
    n = expected["observed_records"]
    seen = gate(outcomes, {"observed_records": (F.count("*"), n), "exact_matches": (F.count_if(c("status") == "recovered"), n), "zero_matches": (F.count_if(c("status") == "unmatched"), 0), "multiple_matches": (F.count_if(c("status") == "ambiguous"), 0)})
    pool = gate(candidates, {"candidate_clean": (F.count_if(c("is_clean")), expected["candidate_clean"]), "candidate_corrupted": (F.count_if(~c("is_clean")), expected["candidate_corrupted"])})
    again = [gate(duplicate_keys(df, [k]), {f"duplicate_{name}_keys": (F.max("groups"), 0)}) for name, df, k in (("observed", outcomes, "request_key"), ("selected", candidates.where("selected_key is not null"), "selected_key"))]
    buckets = expected_by_bucket.join(candidates.groupBy("bucket").agg(F.count("*").alias("actual")), "bucket", "left")
    actual = F.coalesce("actual", F.lit(0))
    out = seen.unionByName(pool).unionByName(again[0]).unionByName(again[1])
    return out.unionByName(buckets.select(F.concat(F.lit("bucket "), "bucket").alias("name"), c("n").cast("long").alias("expected"), actual.alias("actual"), (actual == c("n")).alias("ok")))
