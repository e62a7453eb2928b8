"""Rules that a sample must obey, as an array of broken ones for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRecord
from ..functions.labels import coerce_int, star_polarity
from ..schema import DATASETS, FIELDS_OF, KIND_OF, LABELS_OF, LEVELS, STRATEGIES, TASK_OF
from .calls import illegal_targets

# fixed values: the label projection of the rating dataset
PROJECTION = ("asap_polarity", "1.0.0", "accepted")
NOT_PROJECTED = "not_applicable"


def _map(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def _rules() -> list[tuple[str, Column]]:
    """(name, where it is broken); null counts as not broken, so conditions say what null means."""
    c = F.col
    clean, bad, targets, op_fields = c("clean_payload"), c("corrupted_payload"), c("target_fields"), F.transform("internal_change_trace.ops", lambda o: o["field"])
    kind, ops, choice, rated = clean["payload_kind"], c("internal_change_trace.ops"), c("benchmark_task_type") == "multiple_choice_mrc", c("dataset_name") == "asap"
    trace, public, index = c("internal_change_trace"), c("public_redacted_trace"), c("gold_label").try_cast("int")
    space = F.lit(False)
    for task, labels in LABELS_OF.items():
        space = F.when(c("benchmark_task_type") == task, c("gold_label").isin(labels)).otherwise(space)
    empty = lambda *names: [c(n).isNull() for n in names]
    every = lambda conds: F.array_min(F.array(*[F.coalesce(x, F.lit(False)) for x in conds]))
    applied, count = F.coalesce("corruption_applied", F.lit(False)), F.coalesce("change_count", F.lit(0))
    is_clean = c("corruption_name").isNull()
    state = ("corruption_level", "corruption_seed", "corrupted_payload", "internal_change_trace", "public_redacted_trace", "failure_reason")
    good_clean = every([*empty(*state), ~applied, count == 0])
    good_success = every([*[~x for x in empty(*state[:5])], c("failure_reason").isNull(), count > 0])
    good_failure = every([*[~x for x in empty("corruption_level", "corruption_seed", "failure_reason")], bad.isNull(), count == 0])
    star = coerce_int(c("source_gold_label"))
    return [
        ("blank_id", F.length(F.trim(F.coalesce("sample_id", F.lit("")))) == 0),
        ("split_not_test", ~c("split").eqNullSafe("test")),
        ("language_not_zh", ~c("language").eqNullSafe("zh")),
        ("unknown_dataset", ~F.coalesce(c("dataset_name").isin(DATASETS), F.lit(False))),
        ("task_mismatch", ~c("benchmark_task_type").eqNullSafe(_map(c("dataset_name"), TASK_OF))),
        ("payload_kind_mismatch", ~kind.eqNullSafe(_map(c("benchmark_task_type"), KIND_OF))),
        ("corrupted_kind_mismatch", bad.isNotNull() & ~bad["payload_kind"].eqNullSafe(kind)),
        ("no_target_field", F.size(F.coalesce(targets, F.array().cast("array<string>"))) == 0),
        ("repeated_target_field", F.size(F.array_distinct(targets)) < F.size(targets)),
        ("illegal_target_field", F.size(illegal_targets(targets, kind)) > 0),
        ("label_outside_space", ~choice & ~F.coalesce(space, F.lit(False))),
        ("choice_index_outside", choice & ~F.coalesce((index >= 0) & (index < F.size(clean["options"])), F.lit(False))),
        ("choice_text_mismatch", choice & ~c("gold_label_text").eqNullSafe(F.when(index >= 0, F.get(clean["options"], index)))),
        ("choice_targets", choice & ~targets.eqNullSafe(F.array(F.lit("context")))),
        ("choice_question_changed", choice & bad.isNotNull() & ~bad["question"].eqNullSafe(clean["question"])),
        ("choice_options_changed", choice & bad.isNotNull() & ~bad["options"].eqNullSafe(clean["options"])),
        ("projection_without_need", ~rated & (c("label_projection_name").isNotNull() | c("label_projection_version").isNotNull() | ~c("label_projection_status").eqNullSafe(NOT_PROJECTED))),
        ("projection_identity", rated & ~every([c(f"label_projection_{n}") == v for n, v in zip(("name", "version", "status"), PROJECTION, strict=True)])),
        ("projection_star", rated & ~F.coalesce(star.isin(1, 2, 4, 5), F.lit(False))),
        ("projection_polarity", rated & star.isin(1, 2, 4, 5) & ~c("gold_label").eqNullSafe(star_polarity(star))),
        ("unknown_strategy", ~is_clean & ~F.coalesce(c("corruption_name").isin(STRATEGIES), F.lit(False))),
        ("unknown_level", c("corruption_level").isNotNull() & ~F.coalesce(c("corruption_level").isin(LEVELS), F.lit(False))),
        ("clean_state", is_clean & ~good_clean),
        ("success_state", ~is_clean & applied & ~good_success),
        ("failure_state", ~is_clean & ~applied & ~good_failure),
        ("trace_length", trace.isNotNull() & (F.size(ops) != count)),
        ("trace_foreign_field", F.exists(op_fields, lambda x: ~F.array_contains(targets, x))),
        ("trace_identity", trace.isNotNull() & ~is_clean & ~every([trace["corruption_name"] == c("corruption_name"), trace["corruption_level"] == c("corruption_level"), trace["seed"] == c("corruption_seed")])),
        ("public_trace_length", trace.isNotNull() & public.isNotNull() & (F.size(public["ops"]) != F.size(ops))),
        ("op_end_before_start", F.exists(ops, lambda o: o["end"] < o["start"])),
        ("op_index_gap", ~F.forall(F.transform(ops, lambda o, i: o["op_index"] == i), lambda x: x)),
    ]


def dimensions(spark: SparkSession) -> DataFrame:
    """dataset_name, task, payload_kind, fields, labels: one row for each dataset; no labels where answers are options."""
    lists = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")" if xs else "cast(array() as array<string>)"
    rows = [f"('{d}', '{t}', '{KIND_OF[t]}', {lists(FIELDS_OF[KIND_OF[t]])}, {lists(LABELS_OF.get(t, []))})" for d, t in TASK_OF.items()]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v(dataset_name, task, payload_kind, fields, labels)")


def validate(samples: DataFrame) -> DataFrame:
    """Samples (the SAMPLE schema) with ``violations``, the names of broken rules in a fixed order; empty for a valid sample."""
    return samples.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in _rules()])))


def assert_valid(samples: DataFrame, show: int = 5) -> DataFrame:
    """``samples`` again; raises with a few examples where a rule is broken (one pass over the table)."""
    found = validate(samples).where(F.size("violations") > 0).select("dataset_name", "sample_id", "violations").limit(show).collect()
    if found:
        raise InvalidRecord(f"broken rules: {[tuple(r) for r in found]}")
    return samples
