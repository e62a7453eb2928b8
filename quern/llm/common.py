"""Helpers that the operators share: the shared folder, literal tables and word columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between words for every operator but the licence scan (see ``licenses``).
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may go without that setting (tests): it gets a temporary folder, one for each application.  On a cluster
    a machine's own folder would lose rows, so an unset one is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quern-")
        path = _LOCAL[context.applicationId]
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/quern/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the reread table: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` (a small number of narrow columns) with ``name``: each row's place from 0 in the order of ``by`` over the whole table.

    Rows are dealt by ranges and numbered within each; only the counts of ranges are summed in one task.  ``by`` should tell rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("__p", F.shiftright("__m", 33)).withColumn("__k", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy(F.col("__p").alias("__q")).agg(F.count("*").alias("__n"))
    before = counts.select("__q", (F.sum("__n").over(Window.orderBy("__q")) - F.col("__n")).alias("__b"))  # a row for each range
    return rows.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__b") + F.col("__k")).drop("__m", "__p", "__k", "__q", "__b")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values(spark: SparkSession, rows: list[tuple], schema: dict[str, str]) -> DataFrame:
    """A table of literals, planned as a local relation: no RDD and no Python worker."""
    names = list(schema)
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in schema.items())).where("false")
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return spark.sql(
        "SELECT " + ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in schema.items()) + f" FROM VALUES {body} AS t({', '.join(names)})"
    )


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does exactly that where every character is ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def spaced_words(text: Column) -> Column:
    """The words of ``text`` between ASCII white space, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even when ``body`` uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]
