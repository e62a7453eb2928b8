"""Calls of a model, as an operator: any callable that takes messages, or a table of known responses."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "__UNKNOWN__"


def call_model(requests: DataFrame, client: Callable[[list[dict]], str], retries: int = 3, wait: float = 0.5) -> DataFrame:
    """request_key, raw_response, error, attempts for each request (request_key, messages).

    A failing call is tried again after wait * 2^n seconds, but not after an error that another try won't mend (``CallError.transient``); a record whose tries fail has an empty
    response and the error's name.  Errors that are no ``CallError`` count as transient.
    A retried task calls again: records are told apart by request_key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, messages in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n in range(retries + 1):
                    try:
                        rows.append((key, client(json.loads(messages)), None, n + 1))
                        break
                    except Exception as e:  # noqa: BLE001  the log keeps the kind of every failure
                        if n == retries or not getattr(e, "transient", True):
                            rows.append((key, "", type(e).__name__, n + 1))
                            break
                        time.sleep(wait * 2**n)
            yield pa.RecordBatch.from_pylist([dict(zip(("request_key", "raw_response", "error", "attempts"), r, strict=True)) for r in rows], schema=pa.schema([("request_key", pa.string()), ("raw_response", pa.string()), ("error", pa.string()), ("attempts", pa.int32())]))

    return requests.select("request_key", F.to_json("messages").alias("m")).mapInArrow(run, "request_key string, raw_response string, error string, attempts int")


def mock_model(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Responses (request_key, response) of a table; other requests get a fixed unknown answer."""
    return requests.join(known.select("request_key", "response"), "request_key", "left").withColumn("response", F.coalesce("response", F.lit(UNKNOWN)))


def response_body(content: Column) -> Column:
    """A response of the usual shape around the text of an answer, as JSON."""
    message = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    return F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))


def log_record(**members: Column) -> Column:
    """A log line as JSON: members in the order given, those that are null left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]))


def log_identity(df: DataFrame) -> DataFrame:
    """``df`` with corruption, level and corruption_status as the log has them: 'clean' and 'n/a' for clean samples; APPLIED where the payload was changed, else NOT_APPLIED."""
    clean = F.col("corruption_name").isNull()
    changed = F.coalesce(F.col("corruption_applied"), F.lit(False)) & (F.coalesce(F.col("change_count"), F.lit(0)) > 0)
    status = F.when(~clean, F.when(changed, "APPLIED").otherwise("NOT_APPLIED"))
    return df.withColumns({"corruption": F.coalesce("corruption_name", F.lit("clean")), "level": F.coalesce("corruption_level", F.lit("n/a")), "corruption_status": status})
