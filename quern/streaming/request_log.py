"""The request log: append, skip what is done, and the same as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def done_keys(log: DataFrame, retry_errors: bool = True) -> DataFrame:
    """Keys that need no new request: logged ones, without failed calls unless ``retry_errors`` is off."""
    rows = log.where(F.col("request_key").isNotNull())
    if retry_errors:
        rows = rows.where(~F.coalesce("is_error", F.lit(False)))
    return rows.select("request_key").distinct()


def pending(requests: DataFrame, log: DataFrame, retry_errors: bool = True) -> DataFrame:
    return requests.join(done_keys(log, retry_errors), "request_key", "left_anti")


def first_per_key(log: DataFrame, order: str = "event_id") -> DataFrame:
    """The first record of each key; an aggregate, so combined before the shuffle."""
    rest = [c for c in log.columns if c not in ("request_key", order)]
    return log.groupBy("request_key").agg(F.min(F.struct(order, *rest)).alias("r")).select("request_key", *[F.col(f"r.{c}").alias(c) for c in (order, *rest)])


def ingest(stream: DataFrame, path: str, checkpoint: str, time: str = "ts", late: str = "1 hour") -> StreamingQuery:
    """Appends a stream of records to a Parquet log, once for each request_key within the watermark; runs until what is there is read."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["request_key"])

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")  # a repeated epoch replaces itself

    return once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_errors(stream: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Requests and failures for each time window, late records within the watermark included."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width))
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("is_error")).alias("errors")).select(F.col("window.start").alias("start"), "n", "errors")
