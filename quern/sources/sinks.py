"""Writers: record lines, partitioned perturbed rows, sidecars, manifests and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MissingField


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One compact JSON record for each line; other than ASCII stays as it is, null members are left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("dataset_name", "corruption_name", "corruption_level"), files_per_bucket: int | None = None, order: tuple[str, ...] = ("sample_id",)) -> None:
    """One folder for each bucket.  Rows go to folders without a shuffle, sorted by bucket and ``order`` within each task; with ``files_per_bucket`` they are first spread over so many tasks for each bucket."""
    order = tuple(c for c in order if c in df.columns)
    if files_per_bucket:
        df = df.withColumn("__s", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_bucket))).repartition(*by, "__s").drop("__s")
    df.sortWithinPartitions(*by, *order).write.partitionBy(*by).parquet(path)


SIDECAR = ["run_id", "request_key", "sample_uid", "sample_id", "dataset_name", "split", "is_clean", "corruption_name", "corruption_level", "corruption_seed", "messages_hash", "model", "prompt_version", "status", "record_id"]


def sidecar(df: DataFrame, run_id: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """The identity of each record; run_id is that of the run.  A missing column is an error unless it is named as optional (then null)."""
    if lost := [c for c in SIDECAR if c != "run_id" and c not in df.columns and c not in optional]:
        raise MissingField(f"no column {', '.join(lost)}")
    have = {c: F.col(c) for c in df.columns} | {"run_id": F.lit(run_id)}
    return df.select([have.get(c, F.lit(None).cast("string")).alias(c) for c in SIDECAR])


def write_sidecar(df: DataFrame, path: str, run_id: str, optional: tuple[str, ...] = ()) -> None:
    sidecar(df, run_id, optional).write.json(path)


def manifest(df: DataFrame, by: str, **policy: str) -> DataFrame:
    """One row: total, counts by ``by`` and the policy, as JSON."""
    g = df.groupBy(by).agg(F.count("*").alias("n"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(by).cast("string"), F.lit("null")), "n"))))
    row = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), counts.alias("counts"))
    return row.select(F.to_json(F.struct("total", "counts", *[F.lit(v).alias(k) for k, v in sorted(policy.items())])).alias("manifest"))


# fixed values: members of a provenance record, in order
PROVENANCE = [
    "dataset", "canonical_source_url", "resolved_url", "retrieved_at", "http_status", "content_length", "sha256", "file_name", "file_size", "official_split", "expected_fields", "observed_fields",
    "expected_row_count", "observed_row_count", "license_access_note", "code_commit", "notes",
]


def provenance(rows: DataFrame, files: DataFrame, expected_fields: list[str], expected_row_count: int | None = None, http_status: int = 200, notes: str = "", **known: str) -> DataFrame:
    """A record for each file a dataset came in (``files``: file_name, file_size, sha256), with what was read (``rows``) and when (UTC); ``known``: the members that only the caller knows."""
    if lost := {"dataset", "canonical_source_url", "resolved_url", "official_split", "license_access_note", "code_commit"} - set(known):
        raise MissingField(f"no value for {', '.join(sorted(lost))}")
    given = {k: F.lit(v) for k, v in known.items()} | {
        "retrieved_at": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"), "http_status": F.lit(http_status), "content_length": F.col("file_size"),
        "expected_fields": F.array(*map(F.lit, expected_fields)), "observed_fields": F.array(*map(F.lit, rows.columns)), "expected_row_count": F.lit(expected_row_count).cast("long"), "notes": F.lit(notes),
    }
    counted = files.select("file_name", "file_size", "sha256").crossJoin(F.broadcast(rows.agg(F.count("*").alias("observed_row_count"))))  # one row
    return counted.select([given.get(c, F.col(c)).alias(c) for c in PROVENANCE])
