"""Record schemas and the closed value spaces of samples."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values
DATASETS = ["pawsx_zh", "xnli_zh", "c3", "lcqmc", "asap"]
TASK_OF = {"pawsx_zh": "pair_paraphrase", "xnli_zh": "nli", "c3": "multiple_choice_mrc", "lcqmc": "question_matching", "asap": "sentiment_polarity"}
KIND_OF = {"pair_paraphrase": "pair", "nli": "pair", "question_matching": "pair", "multiple_choice_mrc": "mrc", "sentiment_polarity": "single_text", "sentiment_rating": "single_text"}
FIELDS_OF = {"pair": ["text_a", "text_b"], "single_text": ["text_a"], "mrc": ["context"]}
LABELS_OF = {
    "pair_paraphrase": ["0", "1"],
    "question_matching": ["0", "1"],
    "nli": ["entailment", "neutral", "contradiction"],
    "sentiment_polarity": ["positive", "negative"],
    "sentiment_rating": ["1", "2", "3", "4", "5"],
}
LABEL_TEXT = {"pawsx_zh": {"0": "different_meaning", "1": "paraphrase"}, "lcqmc": {"0": "not_matched", "1": "matched_intent"}}
STRATEGIES = ["homo", "del", "swap", "vis", "add_noise", "red_char", "red_word"]
ALIASES = {"tpwr": "homo", "vscr": "vis", "cr": "red_char", "wr": "red_word", "muni": "add_noise"}
LEVELS = ["low", "medium", "high"]
SAFE_METADATA = ["candidate_count", "unicode_category"]

PAYLOAD = T.StructType([T.StructField(n, T.StringType()) for n in ("payload_kind", "text_a", "text_b", "context", "question")] + [T.StructField("options", T.ArrayType(T.StringType()))])
OP = T.StructType([
    T.StructField("op_index", T.LongType()), T.StructField("op_type", T.StringType()), T.StructField("field", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("original", T.StringType()), T.StructField("replacement", T.StringType()), T.StructField("unit_kind", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
PUBLIC_OP = T.StructType([f for f in OP if f.name not in ("original", "replacement")])


def _trace(op: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("corruption_name", T.StringType()), T.StructField("corruption_level", T.StringType()), T.StructField("seed", T.LongType()), T.StructField("ops", T.ArrayType(op))])


SAMPLE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("sample_id", "source_sample_id", "dataset_name", "dataset_version", "split", "benchmark_task_type", "language")],
    T.StructField("clean_payload", PAYLOAD), T.StructField("corrupted_payload", PAYLOAD),
    *[T.StructField(n, T.StringType()) for n in ("source_gold_label", "gold_label", "gold_label_text")], T.StructField("target_fields", T.ArrayType(T.StringType())),
    *[T.StructField(n, T.StringType()) for n in ("label_projection_name", "label_projection_version", "label_projection_status", "corruption_name", "corruption_level")],
    T.StructField("corruption_seed", T.LongType()), T.StructField("corruption_applied", T.BooleanType()), T.StructField("change_count", T.LongType()),
    T.StructField("internal_change_trace", _trace(OP)), T.StructField("public_redacted_trace", _trace(PUBLIC_OP)),
    T.StructField("failure_reason", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("schema_version", T.StringType()),
])

RECORD = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("request_key", "dataset_name", "sample_id", "sample_uid", "model", "corruption", "level", "corruption_status")],
    T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
    T.StructField("raw_response", T.StringType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("error", T.StringType()),
])
