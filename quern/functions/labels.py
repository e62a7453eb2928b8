"""Labels: coercion, decoding, projections and the strict parse of model responses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LABELS_OF
from .text import fold_width, strip

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# fixed values: what a model may add after a label
SUFFIX = r"[ \t\r\n]+(?:答案[:：]?|</?s>?|<\|(?:endoftext|eot_id)\|>)"


def coerce_int(value: Column) -> Column:
    """A number or numeric string, truncated; null for anything else."""
    return value.try_cast("double").try_cast("int")


def decode(label: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def star_polarity(star: Column) -> Column:
    """1 and 2 negative, 4 and 5 positive, 3 null (excluded); other numbers null (invalid)."""
    return F.when(star.isin(1, 2), "negative").when(star.isin(4, 5), "positive")


def star_status(star: Column) -> Column:
    return F.when(star.isin(1, 2, 4, 5), "ACCEPTED").when(star == 3, "EXCLUDED").otherwise("INVALID")


def letter(index: Column) -> Column:
    return F.substring(F.lit(LETTERS), index.cast("int") + 1, F.lit(1))


def allowed_letters(n: Column) -> Column:
    """The letters of n options; four where there are none."""
    return F.substring(F.lit(LETTERS), F.lit(1), F.when(F.coalesce(n, F.lit(0)) <= 0, 4).otherwise(n).cast("int"))


def options_block(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(letter(i), F.lit(". "), o)), "\n")


def gold_label(task: Column, gold: Column) -> Column:
    """The gold label as parses are compared to it: a letter for multiple choice."""
    return F.when(task == "multiple_choice_mrc", letter(gold.try_cast("int"))).otherwise(gold.cast("string"))


def response_text(raw: Column) -> Column:
    """The text of a raw response: choices[0].message.content, else content, else the string itself, else ''."""
    return F.coalesce(F.get_json_object(raw, "$.choices[0].message.content"), F.get_json_object(raw, "$.content"), F.when(~F.coalesce(raw.rlike(r"^\s*[\[{]"), F.lit(False)), raw), F.lit(""))


def normalize(raw: Column) -> Column:
    return strip(fold_width(F.coalesce(raw, F.lit(""))))


def legacy_normalize(raw: Column) -> Column:
    """The older normal form of labels: trimmed and in lower case."""
    return F.lower(strip(raw.cast("string")))


def raw_label(raw: Column) -> Column:
    """A response's text as a label without any parse: trimmed, null if nothing is left."""
    return F.nullif(strip(raw), F.lit(""))


def task_of(df: DataFrame, *names: str) -> Column:
    """The task of a sample from whichever of the columns is there and filled first."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None).cast("string"))


def _failure(text: Column) -> Column:
    return (
        F.when(text == "", "failure_empty")
        .when(text.rlike(r"(?U)\s"), "failure_multiple_tokens")
        .when(text.rlike(r"^(?i:[abcd])") & (F.length(text) > 1), "failure_prefix")
        .when(text.rlike(r"[^\p{L}\p{N}_]"), "failure_punctuation")
        .otherwise("failure_invalid_label")
    )


def _exact(text: Column, labels: list[str], lower: bool) -> Column:
    body = "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))
    found = F.regexp_extract(text, ("(?i)" if lower else "") + rf"^({body})(?:{SUFFIX})?\z", 1)
    return F.nullif(F.lower(found) if lower else found, F.lit(""))


def parse_label(raw: Column, task: Column, letters: Column | None = None) -> Column:
    """Struct (label, status) of the strict parse; a null task gives the status failure_no_task.

    ``letters``: the letters allowed for multiple choice (default ABCD).
    """
    text = normalize(raw)
    out = F.lit(None).cast("string")
    for name, labels in LABELS_OF.items():
        out = F.when(task == name, _exact(text, labels, labels[0].isalpha())).otherwise(out)
    allowed = F.lit("ABCD") if letters is None else letters
    choice = F.regexp_extract(text, rf"^([A-Z])(?:{SUFFIX})?\z", 1)
    out = F.when(task == "multiple_choice_mrc", F.when((choice != "") & (F.instr(allowed, choice) > 0), choice)).otherwise(out)
    return F.struct(out.alias("label"), F.when(task.isNull(), "failure_no_task").when(out.isNotNull(), "success").otherwise(_failure(text)).alias("status"))
