"""Readers of samples, logs and raw sources.  Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import DuplicateKey, InvalidRecord, MissingField
from ..functions.text import is_blank
from ..operators.adapters import flatten_choice
from ..schema import ALIASES, LEVELS, RECORD, SAMPLE, STRATEGIES
from .layout import file_bucket

KEY = ("dataset_name", "sample_id", "corruption_name", "corruption_level")


def bad_lines(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """(file, reason, line) of lines that are blank, no JSON of the schema, or without a required value."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = lines.withColumn("r", F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"}))
    missing = F.lit(False)
    for n in required:
        missing = missing | F.col(f"r.{n}").isNull() | (F.col(f"r.{n}").cast("string") == "")
    reason = F.when(is_blank(F.col("value")), "blank_line").when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "no_json").when(missing, "missing_value")
    return lines.select("file", reason.alias("reason"), F.left("value", F.lit(200)).alias("line")).where("reason is not null")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = SAMPLE, strict: bool = True, required: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """One record for each line.  Strict: blank lines (also of white space alone), bad JSON and records without a ``required`` value raise; else blank and bad lines are left out.

    Spark drops blank lines silently, so a strict read first passes over the raw lines.
    """
    if strict:
        if bad := bad_lines(spark, path, schema, tuple(r for r in required if r in schema.names)).limit(3).collect():
            raise (MissingField if all(r.reason == "missing_value" for r in bad) else InvalidRecord)(f"{path}: {[tuple(r) for r in bad]}")
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return _parsed(spark.read.text(path), schema).select("r.*").drop("_bad")


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``lines`` (value) with r, the record of a line; blank lines and bad JSON are left out, whatever columns are read later."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return lines.withColumn("r", F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"})).where("r is not null and r._bad is null")


def unique(df: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """``df`` again; raises with examples where a key occurs twice, in whatever files."""
    again = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if again:
        raise DuplicateKey(f"keys that occur twice: {[tuple(r)[:-1] for r in again]}")
    return df


def read_keyed(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], corruption_name: str | None = None, corruption_level: str | None = None) -> DataFrame:
    """Records, read strictly, whose keys must be there and unique over all files below ``path``; strategy and level may be given for all of them."""
    df = read_jsonl(spark, path, schema, required=tuple(keys))
    given = {n: F.lit(v) for n, v in (("corruption_name", corruption_name), ("corruption_level", corruption_level)) if v is not None}
    return unique(df.withColumns(given) if given else df, keys)


def files_below(spark: SparkSession, path: str, pattern: str = "*.jsonl*") -> list[str]:
    """Paths of files below a folder, or the path itself: a listing, no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return sorted(r.path for r in files.select("path").collect())


def clean_files(spark: SparkSession, path: str) -> list[str]:
    """The clean files of a folder: all_clean.jsonl if it is there, else every *_clean.jsonl; a path to a file is that file."""
    names = files_below(spark, path)
    whole = [n for n in names if n.rsplit("/", 1)[-1].startswith("all_clean.jsonl")]
    found = whole or [n for n in names if "_clean.jsonl" in n.rsplit("/", 1)[-1]] or (names if len(names) == 1 else [])
    if not found:
        raise InvalidRecord(f"no clean file in {path}")
    return found


def read_layout(spark: SparkSession, clean: str, perturbed: str, schema: T.StructType) -> DataFrame:
    """Clean samples and those below strategy/level or dataset/strategy/level files, with strategy and level from the path; old names become the present ones.

    Unknown strategies or levels in a path raise when they are read; a key that occurs twice, in one file or several, raises at once.
    """
    parts = F.reverse(F.split(F.regexp_replace(F.col("_metadata.file_path"), r"\.jsonl(\.gz)?$", ""), "/"))
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), parts[1]), parts[1])
    checked = lambda value, known: F.when(value.isin(known), value).otherwise(F.raise_error(F.concat(F.lit("unknown in a path: "), value)))
    one = spark.read.schema(schema).option("mode", "FAILFAST").json(clean_files(spark, clean)).withColumns({"corruption_name": F.lit(None).cast("string"), "corruption_level": F.lit(None).cast("string")})
    two = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(perturbed)
    two = two.withColumns({"corruption_name": checked(name, STRATEGIES), "corruption_level": checked(parts[0], LEVELS)})
    return unique(one.unionByName(two, allowMissingColumns=True), KEY)


def layout_counts(samples: DataFrame) -> DataFrame:
    """Clean, perturbed and all samples."""
    clean = F.col("corruption_name").isNull()
    return samples.agg(F.count_if(clean).alias("clean"), F.count_if(~clean).alias("corrupted"), F.count("*").alias("total"))


def with_identity(records: DataFrame) -> DataFrame:
    """``records``, where one without dataset or id raises when it is read."""
    gone = F.col("dataset_name").isNull() | F.col("sample_id").isNull()
    return records.withColumn("dataset_name", F.when(gone, F.raise_error(F.lit("a record without dataset_name or sample_id"))).otherwise(F.col("dataset_name")))


def load_order() -> Column:
    """The place of a row of files: by path, then by the block of the file, then by the place in it; however Spark deals blocks to tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_log(spark: SparkSession, path: str, run_id: str | None = None, schema: T.StructType = RECORD) -> DataFrame:
    """Inference records; the bucket in the file name overrides the record's, and ``seq`` is their order.  Bad JSON, records without identity and files of unknown names raise when they are read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl", 1)
    b = file_bucket(stem, None if run_id is None else F.lit(run_id))
    known = lambda value: F.when(b["unknown"], F.raise_error(F.concat(F.lit("unknown log file: "), stem))).otherwise(value)
    return with_identity(df.withColumns({"corruption_name": known(b["strategy"]), "corruption_level": known(b["level"]), "seq": load_order()}))


def read_request_keys(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Logged request keys and, of legacy records without one, sample ids.  Bad lines are left out."""
    df = read_jsonl(spark, path, T.StructType([T.StructField("request_key", T.StringType()), T.StructField("sample_id", T.StringType())]), strict=False)
    return df.where("request_key is not null").select("request_key").distinct(), df.where("request_key is null and sample_id is not null").select("sample_id").distinct()


def expected_rows(df: DataFrame, expected: int | None) -> DataFrame:
    """``df`` again; raises where it has another number of rows."""
    if expected is not None and (n := df.count()) != expected:
        raise InvalidRecord(f"{n} rows, {expected} were expected")
    return df


def read_rows(spark: SparkSession, path: str, schema: T.StructType, expected: int | None = None) -> DataFrame:
    """Records, read strictly, of which there must be as many as expected."""
    return expected_rows(read_jsonl(spark, path, schema), expected)


def only_language(df: DataFrame, language: str | None = "zh", column: str = "language") -> DataFrame:
    return df if language is None else df.where(F.col(column) == language)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, language: str | None = "zh", column: str = "language") -> DataFrame:
    """Tab-separated values with a header; quoted values may hold tabs and line breaks."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
    return only_language(df, language, column)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated values; a byte order mark at the start of a file is not part of its first column's name."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("multiLine", "true").option("escape", '"').csv(path)


def positional_ids(df: DataFrame, file: str, row: str, prefix: str = "lcqmc-test-", out: str = "id") -> DataFrame:
    """``df`` with ids from each row's place, in the order of files and of the rows (0, 1, ...) in each: five digits, more where they are needed.

    Rows are counted by file, and only the counts of files are summed in one task.
    """
    counts = df.groupBy(F.col(file).alias("__f")).agg((F.max(row) + 1).alias("__n"))
    before = counts.select("__f", (F.sum("__n").over(Window.orderBy("__f")) - F.col("__n")).alias("__b"))  # a row for each file
    place = (F.col("__b") + F.col(row)).cast("string")
    digits = F.when(F.length(place) < 5, F.lpad(place, 5, "0")).otherwise(place)
    return df.join(before, F.col(file) == F.col("__f")).withColumn(out, F.concat(F.lit(prefix), digits)).drop("__f", "__b")


def read_pairs_parquet(spark: SparkSession, path: str, label: str = "label") -> DataFrame:
    """Pairs with an integer label from ``label`` or ``score``; where there is no id column rows get ids from their place."""
    df = spark.read.parquet(path)
    name = label if label in df.columns else "score"
    text = [("sentence1", "question1"), ("sentence2", "question2")]
    cols = [F.coalesce(*[F.col(c) for c in pair if c in df.columns]).alias(pair[0]) for pair in text]
    if "id" in df.columns:
        return df.select(F.col("id").cast("string").alias("id"), *cols, F.col(name).cast("int").alias("label"))
    rows = df.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"), *cols, F.col(name).cast("int").alias("label"))
    return positional_ids(rows, "__file", "__row").select("id", "sentence1", "sentence2", "label")


def read_nested_choices(spark: SparkSession, path: str, subset: str) -> DataFrame:
    """Files that hold one array of [context array, question array, id] records of mixed types: parsed as variants."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.parse_json("value").alias("v"))
    each = whole.select(F.explode(F.variant_get("v", "$", "array<variant>")).alias("r"))
    flat = each.select(F.variant_get("r", "$[2]", "string").alias("doc"), F.variant_get("r", "$[0]", "array<string>").alias("context"), F.variant_get("r", "$[1]", "array<struct<question: string, choice: array<string>, answer: string>>").alias("questions"))
    return flatten_choice(flat, subset)


MANIFEST = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("dry_run", T.BooleanType()), T.StructField("api_model", T.StringType()), T.StructField("created_at", T.StringType())])


def run_id_of(body: Column, file_name: Column) -> Column:
    """The run's id in its manifest, or the manifest's file name without its ending."""
    return F.coalesce(F.nullif(body, F.lit("")), F.regexp_extract(file_name, r"^(.*?)(?:_manifest)?(?:\.json)?$", 1))


def read_run_catalog(spark: SparkSession, path: str, bad: bool = False) -> DataFrame:
    """Run manifests: run_id from the body, else from the file name.  Manifests that aren't JSON are left out; ``bad`` gives the names of just these."""
    files = spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_name").alias("name"))
    if bad:
        full = T.StructType([*MANIFEST.fields, T.StructField("_bad", T.StringType())])
        return files.withColumn("r", F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"})).where("r is null or r._bad is not null").select("name")
    return _parsed(files, MANIFEST).select(run_id_of(F.col("r.run_id"), F.col("name")).alias("run_id"), "r.dry_run", "r.api_model", "r.created_at")


def without_dry_runs(catalog: DataFrame) -> DataFrame:
    return catalog.where(~F.coalesce("dry_run", F.lit(False)))


def only_real_run(catalog: DataFrame, run_id: str | None = None) -> str:
    """The run of that id, or the only one that is no dry run."""
    rows = [r.run_id for r in (catalog.where(F.col("run_id") == run_id) if run_id else without_dry_runs(catalog)).limit(2).collect()]
    if len(rows) != 1:
        raise InvalidRecord(f"{'no' if not rows else 'more than one'} run to choose")
    return rows[0]


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def verify_files(spark: SparkSession, path: str, expected: DataFrame | dict[str, str]) -> DataFrame:
    """(name, sha256, ok) of files against expected SHA-256 sums by name; ``expected``: a table (name, expected), or a small dict."""
    if isinstance(expected, dict):
        expected = spark.createDataFrame(list(expected.items()), "name string, expected string")
    df = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), content_hash(F.col("content")).alias("sha256"))
    return df.join(expected.select("name", "expected"), "name", "left").select("name", "sha256", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)).alias("ok"))
