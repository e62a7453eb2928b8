"""Runs strategies over whole tables: one assigned strategy for each row with a fallback, or every strategy, and whole samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import redact
from ..functions.plan import opaque
from ..schema import LEVELS, PAYLOAD, STRATEGIES
from .assign import assign_balanced, eligible
from .calls import still_clean
from .strategies import BASE_SEED, perturb, works

TEXT_FIELDS = ["text_a", "text_b", "context"]


def perturb_assigned(df: DataFrame, text: str | Sequence[str] = "text_a", base_seed: int = BASE_SEED, unit: str = "letter") -> DataFrame:
    """``df`` (dataset_name, sample_id, texts, strategy) at each level by its own strategy; see ``perturb``."""
    return perturb(df, F.col("strategy"), text, base_seed, unit)


def alternatives(eligible: Column, used: Column) -> Column:
    """Eligible strategies, the least used first (``used``: strategy -> count), then by name."""
    rank = F.transform(eligible, lambda n: F.struct(F.coalesce(F.element_at(used, n), F.lit(0)).alias("n"), n.alias("name")))
    return F.transform(F.array_sort(rank), lambda r: r["name"])


def used_counts(assigned: DataFrame) -> DataFrame:
    """(dataset, used): how often each strategy is assigned in a dataset, as a map of seven entries at most."""
    n = assigned.where("strategy is not null").groupBy("dataset_name", "strategy").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("dataset_name").alias("dataset")).agg(F.map_from_entries(F.collect_list(F.struct("strategy", "n"))).alias("used"))


def with_fallback(df: DataFrame, text: str | Sequence[str] = "text_a", unit: str = "letter") -> DataFrame:
    """``strategy`` as assigned where it finds a place in a text; else the other eligible strategy that does and is least assigned in the dataset (then by name).

    A strategy with a place makes an edit at every level, so a row is changed at all levels or at none.  ``df`` is read for the counts and again for the rows.
    """
    rows = df if "__fit" in df.columns else df.withColumn("__fit", fitting(text, unit))
    rows = rows.join(used_counts(df).select(F.col("dataset").alias("__d"), F.col("used").alias("__used")), F.col("dataset_name").eqNullSafe(F.col("__d")), "left")
    other = F.get(F.filter(alternatives(F.col("eligible"), F.col("__used")), lambda n: F.array_contains("__fit", n)), 0)
    return rows.withColumn("strategy", opaque(F.when(F.array_contains("__fit", F.col("strategy")), F.col("strategy")).otherwise(other))).drop("__d", "__used", "__fit")


def fitting(text: str | Sequence[str] = "text_a", unit: str = "letter") -> Column:
    """Strategies that find a place in a text, in one look at each."""
    fields = [F.coalesce(F.col(t), F.lit("")) for t in ([text] if isinstance(text, str) else text)]

    def fits(name: str) -> Column:
        out = works(name, fields[0], unit)
        for t in fields[1:]:
            out = out | works(name, t, unit)
        return out

    return opaque(F.array_compact(F.array(*[F.when(fits(n), F.lit(n)) for n in STRATEGIES])))


def run_assigned(df: DataFrame, text: str | Sequence[str] = "text_a", unit: str = "letter") -> DataFrame:
    """One strategy for each row, three levels of it: the whole perturbed table.  ``df`` is read several times and should be a table, with one row of each dataset_name and sample_id.

    Strategies are given out without the texts, which meet their row's strategy in one join and are sorted and numbered nowhere.
    """
    fields = [F.col(t) for t in ([text] if isinstance(text, str) else text)]
    narrow = df.select("dataset_name", "sample_id", eligible(fields, unit).alias("eligible"), fitting(text, unit).alias("__fit"))
    chosen = with_fallback(assign_balanced(narrow), text, unit).select(F.col("dataset_name").alias("__dataset"), F.col("sample_id").alias("__id"), "eligible", "strategy")
    rows = df.join(chosen, F.col("dataset_name").eqNullSafe(F.col("__dataset")) & F.col("sample_id").eqNullSafe(F.col("__id"))).drop("__dataset", "__id")
    return perturb_assigned(rows, text, unit=unit)


def run_every(df: DataFrame, text: str | Sequence[str] = "text_a", unit: str = "letter", targets: str | None = None, kind: str | None = None) -> DataFrame:
    """Every strategy at every level on every row, in one pass: 21 rows for each."""
    each = df.withColumn("strategy", F.explode(F.array(*map(F.lit, STRATEGIES))))
    return perturb(each, F.col("strategy"), text, unit=unit, targets=targets, kind=kind)


def status_counts(run: DataFrame) -> DataFrame:
    """Applied, not applied and invalid rows by strategy and level."""
    n = lambda s: F.count_if(F.col("status") == s)
    return run.groupBy("strategy", "level").agg(F.count("*").alias("n"), n("APPLIED").alias("applied"), n("NOT_APPLIED").alias("not_applied"), n("INVALID").alias("invalid"))


def perturb_samples(samples: DataFrame, strategy: str | Column, levels: Sequence[str] = LEVELS, base_seed: int = BASE_SEED, unit: str = "han") -> DataFrame:
    """Whole samples (the SAMPLE schema, clean) at each level: corrupted payload, traces, counts and status filled in; a sample that is perturbed already is an error.

    Samples that are not changed have no corrupted payload and no traces, but the reason.
    """
    name = F.lit(strategy) if isinstance(strategy, str) else strategy
    p = F.col("clean_payload")
    rows = samples.withColumns({"sample_id": still_clean(F.col("corruption_name"), F.col("sample_id")), "__kind": p["payload_kind"], "__name": name} | {f"__{f}": p[f] for f in TEXT_FIELDS})
    rows = rows.withColumnsRenamed({f"__{f}": f for f in TEXT_FIELDS})
    made = perturb(rows, strategy if isinstance(strategy, str) else F.col("__name"), TEXT_FIELDS, base_seed, unit, levels, "target_fields", "__kind")
    applied = F.col("status") == "APPLIED"
    payload = F.struct(*[(F.col(f"corrupted.{f.name}") if f.name in TEXT_FIELDS else p[f.name]).alias(f.name) for f in PAYLOAD])
    trace = lambda ops: F.when(applied, F.struct(F.col("__name").alias("corruption_name"), F.col("level").alias("corruption_level"), F.col("seed").alias("seed"), ops.alias("ops")))
    new = {
        "corrupted_payload": F.when(applied, payload), "corruption_name": F.col("__name"), "corruption_level": F.col("level"), "corruption_seed": F.col("seed"), "corruption_applied": applied,
        "internal_change_trace": trace(F.col("ops")), "public_redacted_trace": trace(redact(F.col("ops"))),
    }
    new |= {"change_count": F.col("change_count"), "failure_reason": F.col("failure_reason")}
    return made.select(*[new.get(c, F.col(c)).alias(c) for c in samples.columns], "status")
