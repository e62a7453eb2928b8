"""Adapters from raw source records to standardized rows, in three states: ACCEPTED, EXCLUDED, INVALID."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import coerce_int, decode, star_polarity, star_status
from ..functions.text import is_blank, strip
from ..schema import LABEL_TEXT, LABELS_OF

OUT = ["sample_id", "dataset_name", "text_a", "text_b", "gold_label", "gold_label_text", "status", "reason"]


def _states(df: DataFrame, dataset: str, reasons: list[tuple[Column, str]], excluded: Column | None = None) -> DataFrame:
    """Reasons are tried in order; a row without any is accepted, or excluded where ``excluded`` holds."""
    reason = F.lit(None).cast("string")
    for cond, name in reversed(reasons):
        reason = F.when(cond, name).otherwise(reason)
    ex = F.lit(False) if excluded is None else F.coalesce(excluded, F.lit(False))
    df = df.withColumn("dataset_name", F.lit(dataset)).withColumn("reason", reason)
    return df.withColumn("status", F.when(F.col("reason").isNotNull(), "INVALID").when(ex, "EXCLUDED").otherwise("ACCEPTED"))


def adapt_pair(df: DataFrame, dataset: str, id_col: str, a: str | list[str], b: str | list[str], label: str) -> DataFrame:
    """Two texts and a label; a list of names is tried in order, blank values passed over."""
    first = lambda names: F.coalesce(*[F.when(~is_blank(F.col(n)), strip(F.col(n))) for n in ([names] if isinstance(names, str) else names)])
    task = {"pawsx_zh": "pair_paraphrase", "lcqmc": "question_matching", "xnli_zh": "nli"}[dataset]
    gold = F.lower(strip(F.col(label).cast("string"))) if task == "nli" else coerce_int(F.col(label).cast("string")).cast("string")
    df = df.select(strip(F.col(id_col).cast("string")).alias("sample_id"), first(a).alias("text_a"), first(b).alias("text_b"), gold.alias("gold_label"))
    df = df.withColumn("gold_label_text", decode(F.col("gold_label"), LABEL_TEXT[dataset]) if dataset in LABEL_TEXT else F.col("gold_label"))
    bad = ~F.coalesce(F.col("gold_label").isin(LABELS_OF[task]), F.lit(False))
    return _states(df, dataset, [(is_blank(F.col("sample_id")), "missing_id"), (F.col("text_a").isNull(), "missing_text_a"), (F.col("text_b").isNull(), "missing_text_b"), (bad, "invalid_label")]).select(*OUT)


def adapt_rating(df: DataFrame, id_col: str, review: str, star: str) -> DataFrame:
    """Star ratings as polarity: 3 stars excluded, other numbers than 1 to 5 invalid."""
    n = coerce_int(F.col(star).cast("string"))
    df = df.select(F.col(id_col).cast("string").alias("sample_id"), strip(F.col(review)).alias("text_a"), F.lit(None).cast("string").alias("text_b"), star_polarity(n).alias("gold_label"), star_polarity(n).alias("gold_label_text"), n.alias("__n"))
    state = star_status(F.col("__n"))
    return _states(df, "asap", [(is_blank(F.col("sample_id")), "missing_id"), (is_blank(F.col("text_a")), "missing_text_a"), (F.coalesce(state == "INVALID", F.lit(True)), "invalid_label")], state == "EXCLUDED").select(*OUT)


def adapt_choice(df: DataFrame, id_col: str, context: str, question: str, options: str, answer: str) -> DataFrame:
    """Multiple choice: options are trimmed and blank ones dropped; the answer's first match is the gold index."""
    opts = F.filter(F.transform(F.col(options), strip), lambda o: F.length(o) > 0)
    df = df.select(F.col(id_col).cast("string").alias("sample_id"), strip(F.col(context)).alias("context"), strip(F.col(question)).alias("question"), opts.alias("options"), strip(F.col(answer)).alias("gold_label_text"))
    at = F.array_position("options", F.col("gold_label_text"))
    df = df.withColumn("gold_label", F.when(at > 0, (at - 1).cast("string")))
    rules = [(is_blank(F.col("sample_id")), "missing_id"), (is_blank(F.col("context")), "missing_context"), (is_blank(F.col("question")), "missing_question"), (F.coalesce(F.size("options"), F.lit(0)) < 2, "too_few_options"), (F.col("gold_label").isNull(), "invalid_label")]
    return _states(df, "c3", rules).select("sample_id", "dataset_name", "context", "question", "options", "gold_label", "gold_label_text", "status", "reason")


def drop_placeholders(df: DataFrame, a: str = "text_a", b: str = "text_b", mark: str = "NS") -> DataFrame:
    return df.where(~(F.coalesce(F.col(a), F.lit("")).contains(mark) | F.coalesce(F.col(b), F.lit("")).contains(mark)))


def flatten_choice(df: DataFrame, subset: str) -> DataFrame:
    """One row for each question of nested records (doc, context array, questions array<struct<question, choice, answer>>)."""
    text = F.array_join(F.transform("context", strip), "\n")
    each = df.select("doc", text.alias("context"), F.posexplode("questions").alias("qidx", "q"))
    return each.select(F.concat(F.lit(f"c3-{subset}-test-"), F.col("doc").cast("string"), F.lit("-"), F.col("qidx").cast("string")).alias("sample_id"), "context", "q.question", F.col("q.choice").alias("options"), "q.answer")


def envelope(df: DataFrame, dataset: str, version: str, task: str, split: str = "test", language: str = "zh") -> DataFrame:
    """The common columns of standardized rows around a payload struct, from sample_id, gold_label, gold_label_text and text columns."""
    fields = [c for c in ("text_a", "text_b", "context", "question", "options") if c in df.columns]
    kind = {"pair_paraphrase": "pair", "nli": "pair", "question_matching": "pair", "multiple_choice_mrc": "mrc"}.get(task, "single_text")
    targets = {"pair": ["text_a", "text_b"], "mrc": ["context"], "single_text": ["text_a"]}[kind]
    return df.select(
        F.lit("1").alias("schema_version"), F.when(is_blank(F.col("sample_id")), F.raise_error(F.lit("blank sample_id"))).otherwise(F.col("sample_id")).alias("sample_id"), F.col("sample_id").alias("source_sample_id"),
        F.lit(dataset).alias("dataset_name"), F.lit(version).alias("dataset_version"), F.lit(split).alias("split"), F.lit(language).alias("language"), F.lit(task).alias("task_type"), F.lit(kind).alias("payload_kind"),
        F.struct(F.lit(kind).alias("payload_kind"), *[F.col(c) for c in fields]).alias("clean_payload"), F.col("gold_label").alias("source_gold_label"), "gold_label", "gold_label_text", F.array(*map(F.lit, targets)).alias("target_fields"),
    )
